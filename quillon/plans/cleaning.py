"""The cleaning plan: sixteen steps over a table of documents.

Each step is a function from DataFrame to DataFrame on the columns doc_id, title, lines and audit; disabled
steps are left out of the plan.  All are column expressions, so a document stays one row and the plan is one narrow
stage without an exchange.  Values that a step uses more than once are columns of their own.

Sections are removed only if their boundary passes the checks of place, size and confidence and then the
check of content.  A provider may propose boundaries; one that fails a check, or is missing, is
replaced by the detectors.  A proposal without lines means that there is nothing to remove.  Proposals are columns
(`PROPOSALS`, `LISTS`, `NOTES`, `METADATA`); a rewriter, a function on a text, serves steps 13 and 14, and each passage
that it returns with other words is left as it was.  Each step writes an audit row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.chars import clean_character_lines
from ..functions.citations import remove_footnote_markers, without_citations
from ..functions.estimates import reduction, tokens
from ..functions.lines import count_words, count_words_in, join_lines, let, relined, split_lines
from ..functions.markdown import count_semantic_words_in
from ..functions.metadata import FIELDS, blank, merged
from ..functions.replies import metadata as metadata_reply
from ..functions.segments import TRIGGER, protecting, shield
from ..operators import boundaries as b
from ..operators.mining import without_running
from ..operators.removal import drop_matching, remove_range, remove_range_except, remove_ranges, strict_page_numbers
from ..operators.services import disabled_steps
from ..operators.structure import assemble, chapters, content_flags, long_paragraphs, parts, reflowed as reflowed_text, strip_metadata
from ..operators.validation import boundary_reason, review_counts, step_anomaly, verify_content
from ..sources.providers import Provider, rewritten
from .config import STEPS, Settings

AUDIT = "array<struct<step:int,changes:int,lines:int,confidence:double,anomaly:string>>"
#: A column that a provider may add for a section: struct<start:int,end:int,confidence:double>.
PROPOSALS = {"frontMatter": "front_proposal", "tableOfContents": "toc_proposal", "backMatter": "back_proposal", "index": "index_proposal"}


#: Columns with an array of proposed ranges, and with a service's reply on bibliographic data.
LISTS, NOTES, METADATA = "lists_proposal", "notes_proposal", "metadata_reply"
#: Fields of such a reply that bear the names of ours.
REPLIED = ("subtitle", "author", "publisher", "language", "genre", "isbn")
RANGES = "array<struct<start:int,end:int,confidence:double>>"


def _noted(df: DataFrame, step: int, confidence: Column | None = None, changes: Column | None = None) -> DataFrame:
    """An audit row for a step that leaves the lines as they are."""
    entry = F.struct(F.lit(step).alias("step"), (F.lit(0) if changes is None else changes).cast("int").alias("changes"), F.size("lines").alias("lines"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"), F.lit(None).cast("string").alias("anomaly"))
    return df.withColumn("audit", F.concat("audit", F.array(entry).cast(AUDIT)))


def _logged(df: DataFrame, step: int, lines: Column, confidence: Column | None = None, changes: Column | None = None, detected: Column | None = None) -> DataFrame:
    before = F.col("lines")
    if "off" in df.columns:  # steps that the kind of content rules out
        lines = F.when(F.array_contains("off", F.lit(step)), before).otherwise(lines)
    df = df.withColumn("__after", lines)
    counted = F.when(F.col("lines") == F.col("__after"), 0).otherwise(F.size(F.array_except("lines", "__after")) + F.size(F.array_except("__after", "lines"))) if changes is None else changes
    df, n = df.withColumn("__n", counted), F.col("__n")
    c = F.lit(None).cast("double") if confidence is None else confidence
    entry = F.struct(F.lit(step).alias("step"), n.cast("int").alias("changes"), F.size("__after").alias("lines"), c.alias("confidence"), step_anomaly(step, F.size(before), F.size("__after"), n, detected).alias("anomaly"))
    return df.withColumn("audit", F.concat("audit", F.array(entry).cast(AUDIT))).withColumn("lines", F.col("__after")).drop("__after", "__n")


def page_numbers(df: DataFrame, s: Settings) -> DataFrame:
    return _logged(df, 3, drop_matching(F.col("lines"), strict_page_numbers() if s.strict_roman else fixed.PAGE_NUMBERS))


def headers_footers(df: DataFrame, s: Settings) -> DataFrame:
    return _logged(df, 4, without_running(F.col("lines")))


def decided(df: DataFrame, section: str, detected: Column, s: Settings) -> Column:
    """A struct (start, end, confidence) of what may be removed, null for nothing.

    detected is the detectors' answer; it counts without further checks where no proposal was made or the
    proposal failed one.
    """
    if PROPOSALS[section] not in df.columns:
        return detected
    p, n = F.col(PROPOSALS[section]), F.size("lines")
    reason = boundary_reason(F.lit(section), p["start"], p["end"], p["confidence"], n)
    start = F.coalesce(p["start"], F.lit(0))
    ok = verify_content(section, F.col("lines"), start, p["end"], s.strict_headers)["valid"]
    taken = F.struct(start.alias("start"), F.coalesce(p["end"], n - 1).alias("end"), p["confidence"].alias("confidence"))
    return F.when(p.isNull() | ~reason.isin("valid", "no_boundary"), detected).when(reason == "no_boundary", None).when(ok, taken).otherwise(detected)


def _range(point: Column, start: Column, end: Column) -> Column:
    return F.when(point.isNotNull(), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), point["confidence"].alias("confidence")))


def _cut(df: DataFrame, step: int, section: str, detected: Column, s: Settings, kept: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    df = df.withColumn("__cut", decided(df, section, detected, s))
    cut = F.col("__cut")
    lines = F.col("lines")
    if kept is None:
        out = remove_range(lines, cut["start"], cut["end"])
    else:
        zone = kept(cut["start"], cut["end"])
        out = F.when(cut.isNull(), lines).otherwise(remove_range_except(lines, cut["start"], cut["end"], F.filter(F.array(zone), lambda z: z.isNotNull())))
    return _logged(df, step, out, cut["confidence"], detected=cut.isNotNull()).drop("__cut")


def front_matter(df: DataFrame, s: Settings) -> DataFrame:
    df, end = df.withColumn("__at", b.front_matter_end(F.col("lines"))), F.col("__at")
    kept = None if s.table_of_contents else lambda a, z: b.toc_zone(F.col("lines"), a, z)
    return _cut(df, 5, "frontMatter", _range(end, F.lit(0), end["line"]), s, kept).drop("__at")


def table_of_contents(df: DataFrame, s: Settings) -> DataFrame:
    df, start = df.withColumn("__at", b.toc_start(F.col("lines"))), F.col("__at")
    end = F.when(start.isNotNull(), b.toc_end(F.col("lines"), start["line"]))
    return _cut(df, 6, "tableOfContents", _range(start, start["line"], end), s).drop("__at")


def back_matter(df: DataFrame, s: Settings) -> DataFrame:
    df, start = df.withColumn("__at", b.back_matter(F.col("lines"))), F.col("__at")
    kept = None if s.index else lambda a, z: b.index_zone(F.col("lines"), a, z)
    return _cut(df, 7, "backMatter", _range(start, start["line"], F.size("lines") - 1), s, kept).drop("__at")


def index(df: DataFrame, s: Settings) -> DataFrame:
    df, start = df.withColumn("__at", b.index_start(F.col("lines"))), F.col("__at")
    return _cut(df, 8, "index", _range(start, start["line"], F.size("lines") - 1), s).drop("__at")


def _ranges(found: Column, confidence: float | None = None) -> Column:
    return F.transform(found, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), (r["confidence"] if confidence is None else F.lit(confidence)).alias("confidence"))).cast(RANGES)


def _checked(section: str, proposed: Column, detected: Column, s: Settings) -> Column:
    """Those of proposed ranges that pass the checks of place and content; the detectors' where none does."""
    lines, n = F.col("lines"), F.size("lines")

    def holds(r: Column) -> Column:
        placed = boundary_reason(F.lit(section), r["start"], r["end"], r["confidence"], n) == "valid"
        return F.when(placed, verify_content(section, lines, r["start"], r["end"], s.strict_headers)["valid"]).otherwise(False)

    return let(lambda good: F.when(F.size(good) > 0, good).otherwise(detected), F.filter(F.coalesce(_ranges(proposed), F.array().cast(RANGES)), holds))


def auxiliary_lists(df: DataFrame, s: Settings) -> DataFrame:
    lines = F.col("lines")
    df = df.withColumn("__headed", b.auxiliary_lists(lines))
    found = F.when(F.size("__headed") > 0, _ranges(F.col("__headed"))).otherwise(_ranges(b.headerless_lists(lines)))
    df = df.withColumn("__found", _checked("auxiliaryLists", F.col(LISTS), found, s) if LISTS in df.columns else found)
    mean = F.aggregate("__found", F.lit(0.0), lambda acc, x: acc + x["confidence"]) / F.nullif(F.size("__found"), F.lit(0))
    return _logged(df, 9, remove_ranges(lines, F.col("__found")), mean).drop("__found", "__headed")


def _on_text(df: DataFrame, step: int, change: Callable[[Column], Column], confidence: float | None = None) -> DataFrame:
    out = relined(change(join_lines(F.col("lines"))))
    return _logged(df, step, out, None if confidence is None else F.lit(confidence))


def citations(df: DataFrame, s: Settings) -> DataFrame:
    return _on_text(df, 10, lambda t: protecting(t, shield(), without_citations, TRIGGER))


def footnotes(df: DataFrame, s: Settings) -> DataFrame:
    """Markers, then sections of notes; both count as changes of the step."""
    marked = lambda t: protecting(t, shield(), lambda x: remove_footnote_markers(x)["text"], TRIGGER)
    df = df.withColumn("__left", relined(marked(join_lines(F.col("lines")))))
    left = F.col("__left")
    found = _ranges(b.notes_sections(left), 0.9)
    df = df.withColumn("__notes", _checked("footnotesEndnotes", F.col(NOTES), found, s) if NOTES in df.columns else found)
    return _logged(df, 11, remove_ranges(left, F.col("__notes"))).drop("__left", "__notes")


def characters(df: DataFrame, s: Settings) -> DataFrame:
    return _logged(df, 12, clean_character_lines(F.col("lines"), shield(code=False), TRIGGER))


def reflowed(df: DataFrame, s: Settings, rewriter: Provider | None = None) -> DataFrame:
    """Headings become paragraphs of their own first, as joined to their text they'd be lost to step 15."""
    apart = lambda x: F.when(x.contains("#"), F.regexp_replace(x, r"(?m)^(#{1,6}\s.*)$", "\n$1\n")).otherwise(x)
    joined = lambda t: protecting(t, shield(math=False), lambda x: reflowed_text(apart(x)), "[|`]")
    if rewriter is None:
        return _on_text(df, 13, joined, 0.9)
    df = rewritten(df.withColumn("__text", join_lines(F.col("lines"))), rewriter, "__text", "__new")
    return _logged(df, 13, split_lines(F.coalesce("__new", joined(F.col("__text")))), F.lit(0.9)).drop("__text", "__new")


def paragraph_length(df: DataFrame, s: Settings, rewriter: Provider | None = None) -> DataFrame:
    """Without a rewriter the text stays, and paragraphs that are too long are no change; with one they are rewritten."""
    most = max(s.max_paragraph_words, 1)
    if rewriter is None:
        return _noted(df.withColumn("long_paragraphs", F.size(long_paragraphs(join_lines(F.col("lines")), most))), 14)
    df = rewritten(df.withColumn("__text", join_lines(F.col("lines"))), rewriter, "__text", "__new", least_words=most)
    return _logged(df, 14, split_lines(F.coalesce("__new", F.col("__text"))), F.lit(0.9)).drop("__text", "__new")


def analyzed(df: DataFrame, s: Settings) -> DataFrame:
    """Step 1: the kind of content."""
    return _noted(df, 1, F.col("flags.confidence"))


def extract_metadata(df: DataFrame, s: Settings) -> DataFrame:
    """Step 2: a title from the document's name, and what a service's reply (METADATA) has beyond it."""
    known = blank(F.col("title"))
    if METADATA not in df.columns:
        return _noted(df.withColumn("meta", known), 2)
    df = df.withColumn("__reply", metadata_reply(F.col(METADATA)))
    fields = [(F.col(f"__reply.{f}") if f in REPLIED else F.lit(None).cast("string")).alias(f) for f in FIELDS]
    given = F.struct(F.col("__reply.title").alias("title"), *fields, F.lit(None).cast("int").alias("chapters"), F.lit(None).cast("boolean").alias("has_parts"))
    df = df.withColumn("meta", F.when(F.col("__reply").isNotNull(), merged(known, given)).otherwise(known))
    return _noted(df, 2, F.when(F.col("__reply").isNotNull(), 0.9)).drop("__reply")


def structured(df: DataFrame, s: Settings) -> DataFrame:
    lines = F.col("lines")
    df = df.withColumn("__chapters", F.size(chapters(lines))).withColumn("__parts", F.size(parts(lines)) > 0)
    meta = F.col("meta") if "meta" in df.columns else blank(F.col("title"))
    meta = F.struct(*[meta[f].alias(f) for f in ("title", *FIELDS)], F.col("__chapters").alias("chapters"), F.col("__parts").alias("has_parts"))
    text = assemble(strip_metadata(join_lines(lines)), meta, s.metadata_format, s.chapter_style if s.chapters else "none", s.end_style)
    return _logged(df, 15, relined(text), changes=F.col("__chapters")).drop("__chapters", "__parts")


FUNCTIONS = {1: analyzed, 2: extract_metadata, 3: page_numbers, 4: headers_footers, 5: front_matter, 6: table_of_contents, 7: back_matter, 8: index, 9: auxiliary_lists, 10: citations, 11: footnotes, 12: characters, 13: reflowed, 14: paragraph_length, 15: structured}


def clean(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", title: Column | None = None, rewriter: Provider | None = None) -> DataFrame:
    """doc_id, title, text, original_words, cleaned_words, reduction_pct, tokens, primary_type, score, severity, confidence, audit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    proposals = [c for c in (*PROPOSALS.values(), LISTS, NOTES, METADATA) if c in docs.columns]
    df = docs.select(F.col(id_col).alias("doc_id"), (F.concat(F.lit("Document "), F.col(id_col).cast("string")) if title is None else title).alias("title"), split_lines(text).alias("lines"), F.array().cast(AUDIT).alias("audit"), *proposals)
    lines = F.col("lines")
    df = df.withColumns({"flags": content_flags(join_lines(F.array_distinct(lines))), "__words": count_words_in(lines)})  # no word of the flags spans lines
    df = df.withColumn("before", count_semantic_words_in(lines, join_lines(lines), F.col("__words")))
    if settings.by_content:
        df = df.withColumn("off", disabled_steps(F.col("flags.primary_type")))
    for step in settings.enabled():
        if step in FUNCTIONS:
            df = FUNCTIONS[step](df, settings, *([rewriter] if step in (13, 14) else []))
    out = df.withColumn("text", join_lines(F.col("lines")))
    heavy = F.lit(settings.heavy) | F.col("flags.is_academic")
    out = out.withColumn("__left", count_words(F.col("text")))
    judged = out.withColumn("review", review_counts(F.col("__words"), F.col("__left"), heavy))
    known = F.filter(F.transform(F.filter("audit", lambda a: a["step"].between(3, 15)), lambda a: a["confidence"]), lambda c: c.isNotNull())
    judged = judged.withColumns({"known": known, "after": count_semantic_words_in(F.col("lines"), F.col("text"), F.col("__left"))})
    mean = F.when(F.size("known") > 0, F.aggregate("known", F.lit(0.0), lambda acc, c: acc + c) / F.size("known"))
    judged = _noted(judged, 16, F.col("review.score"))
    return judged.select("doc_id", "title", "text", F.col("before").alias("original_words"), F.col("after").alias("cleaned_words"), reduction(F.col("before"), F.col("after")).alias("reduction_pct"), tokens(F.col("text"), F.col("__left")).alias("tokens"), F.col("flags.primary_type").alias("primary_type"), F.col("review.score").alias("score"), F.col("review.severity").alias("severity"), mean.alias("confidence"), "audit")


def audit_rows(cleaned: DataFrame) -> DataFrame:
    """doc_id, step, name, changes, lines, confidence, anomaly."""
    names = F.create_map(*[F.lit(x) for p in STEPS.items() for x in p])
    rows = cleaned.select("doc_id", F.explode_outer("audit").alias("a")).filter(F.col("a").isNotNull())  # outer: see line_view
    return rows.select("doc_id", "a.step", names[F.col("a.step")].alias("name"), "a.changes", "a.lines", "a.confidence", "a.anomaly")
