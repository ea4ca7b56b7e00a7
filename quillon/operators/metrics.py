"""Counts, confidences, totals and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lines import count_words
from .mining import words_mean

#: The steps whose confidences make up a phase.
PHASES = {3: (3, 4, 5, 6, 7, 8), 4: (12, 13), 5: (9, 10, 11), 6: (7, 8), 7: (14, 15)}


def document_metrics(lines: Column) -> Column:
    """A struct of lines, words, characters and their means a line."""
    n = F.size(lines)
    words = F.aggregate(lines, F.lit(0), lambda acc, x: acc + count_words(x))
    chars = F.aggregate(lines, F.lit(0), lambda acc, x: acc + F.length(x)) + n - 1
    per = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    return F.struct(n.alias("lines"), words.alias("words"), chars.alias("chars"), per(words).alias("words_per_line"), per(chars).alias("chars_per_line"))


def page_totals(pages: Column) -> Column:
    """Of structs (index, markdown, tables, images): words, characters, whether there are tables or images, the text."""
    text = F.array_join(F.transform(pages, lambda p: p["markdown"]), "\n\n---\n\n")
    total = lambda f: F.aggregate(pages, F.lit(0), lambda acc, p: acc + f(p["markdown"]))
    return F.struct(
        F.size(pages).alias("pages"), total(count_words).alias("words"), total(F.length).alias("chars"), F.exists(pages, lambda p: F.size(p["tables"]) > 0).alias("has_tables"),
        F.exists(pages, lambda p: F.size(p["images"]) > 0).alias("has_images"), text.alias("text"),
    )


def phase_confidence(steps: Column, phase: int) -> Column:
    """The mean confidence of a phase's steps; steps is a map from step number to confidence."""
    return words_mean([F.try_element_at(steps, F.lit(s)) for s in PHASES[phase]])


def overall_confidence(hints: Column, boundary: Column, phases: list[Column], review: Column) -> Column:
    """The mean of all that is known, each phase counting; 0 if nothing is."""
    return F.coalesce(words_mean([hints, boundary, *phases, review]), F.lit(0.0))


def tracker_confidence(hints: Column, boundary: Column, phases: list[Column], review: Column) -> Column:
    """The same, but the phases count once, as their mean."""
    return F.coalesce(words_mean([hints, boundary, words_mean(phases), review]), F.lit(0.0))


def fallbacks(boundary_by_model: Column, review_by_model: Column) -> Column:
    no = lambda c: F.coalesce((~c).cast("int"), F.lit(0))
    return no(boundary_by_model) + no(review_by_model)


def totals_by(validated: DataFrame, valid: str = "valid", reason: str = "reason", section: str = "section") -> DataFrame:
    """One row: how many were judged, the share that passed (1 if none), and maps of failures by reason and section."""
    bad = validated.filter(~F.col(valid))
    maps = lambda c, name: bad.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name))
    head = validated.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg(F.col(valid).cast("double")), F.lit(1.0)).alias("pass_rate"))
    return head.crossJoin(maps(reason, "by_reason")).crossJoin(maps(section, "by_section"))  # one row each


def telemetry_summary(events: DataFrame, kind: str = "event_type", value: str = "value", done: str = "completed", fallback: str = "fallback") -> DataFrame:
    """One row: events, the share of completions that didn't fail (1 if none), mean confidence, share of fallbacks."""
    completed, failed = F.count_if(F.col(kind) == done), F.count_if(F.col(kind) == "failed")
    return events.agg(
        F.count(F.lit(1)).alias("total"), F.when(completed + failed > 0, completed / (completed + failed)).otherwise(1.0).alias("success_rate"), F.avg(F.col(value).try_cast("double")).alias("avg_confidence"),
        F.when(completed > 0, F.count_if(F.col(kind) == fallback) / completed).otherwise(0.0).alias("fallback_rate"),
    )


def progress_percent(phase: Column, done: Column, total: Column) -> Column:
    """Of an OCR run: its phase, and of its pages those done."""
    processing = F.when(total > 0, 0.3 + 0.6 * done / total).otherwise(0.6)
    return F.when(phase == "preparing", 0.1).when(phase == "uploading", 0.3).when(phase == "processing", processing).otherwise(0.95)


def cleaning_progress(statuses: Column, chunk: Column | None = None, chunks: Column | None = None) -> Column:
    """The share of enabled steps that are over, with the running step's chunks as its own share."""
    enabled = F.filter(statuses, lambda s: s != "skipped")
    over = F.size(F.filter(enabled, lambda s: s.isin("completed", "failed")))
    part = F.lit(0.0) if chunk is None else F.when(F.exists(enabled, lambda s: s == "running") & (chunks > 0), chunk / chunks).otherwise(0.0)
    return F.when(F.size(enabled) > 0, (over + part) / F.size(enabled)).otherwise(0.0)


def compare_texts(a: Column, b: Column) -> Column:
    """A struct: differences in words and lines, Levenshtein similarity, share of common lines, and whether they pass as equal."""
    longest = F.greatest(F.length(a), F.length(b))
    similarity = F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)
    x, y = F.split(a, "\n", -1), F.split(b, "\n", -1)
    structure = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    words = F.abs(count_words(a) - count_words(b))
    return F.struct(words.alias("word_delta"), F.abs(F.size(x) - F.size(y)).alias("line_delta"), similarity.alias("similarity"), structure.alias("structure"), ((similarity >= 0.95) & (words < 50)).alias("passes"))
