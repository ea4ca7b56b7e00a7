"""Tokens, costs, durations, sizes, confidence bands and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lines import count_words

#: Money is decimal: dollars for a page, and for a token read and written.
PAGE_COST, TOKEN_IN, TOKEN_OUT = "0.001", "0.000003", "0.000015"


def tokens(text: Column, words: Column | None = None) -> Column:
    """The mean of a quarter of the characters and 1.3 a word (counted here unless known), rounded half up, 1 at least; 0 for no text."""
    mean = (F.length(text) / 4.0 + (count_words(text) if words is None else words) * 1.3) / 2.0
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor(mean + 0.5).cast("int")))


def tokens_by_chars(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def page_cost(pages: Column) -> Column:
    return F.when(pages > 0, pages.cast("decimal(12,0)") * F.lit(PAGE_COST).cast("decimal(6,3)")).otherwise(F.lit(0)).cast("decimal(18,6)")


def clean_cost(tokens_in: Column, tokens_out: Column, total: Column) -> Column:
    """Of known counts; unknown ones are 40 and 60 percent of the total, cut to whole tokens."""
    known = (tokens_in > 0) | (tokens_out > 0)
    a = F.when(known, tokens_in).otherwise(F.floor(total * 0.4)).cast("decimal(12,0)")
    b = F.when(known, tokens_out).otherwise(F.floor(total * 0.6)).cast("decimal(12,0)")
    return (a * F.lit(TOKEN_IN).cast("decimal(9,6)") + b * F.lit(TOKEN_OUT).cast("decimal(9,6)")).cast("decimal(18,6)")


def reduction(before: Column, after: Column) -> Column:
    """Percent of the words that went; 0 if there were none."""
    return F.when(before > 0, (before - after) / before * 100.0).otherwise(F.lit(0.0))


def rating(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "very_high").when(confidence >= 0.75, "high").when(confidence >= 0.6, "moderate").when(confidence >= 0.4, "low").otherwise("very_low")


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def review_band(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.75, "good").when(score >= 0.6, "acceptable").when(score >= 0.4, "needs_review").otherwise("poor")


def shown_count(n: Column) -> Column:
    return F.concat(F.lit("~"), F.format_number(n, 0))


def shown_cost(cost: Column) -> Column:
    """Two decimals from a dollar on, else two to four."""
    four = F.format_number(cost.cast("decimal(18,4)"), 4)
    return F.concat(F.lit("$"), F.when(cost >= 1, F.format_number(cost, 2)).otherwise(F.regexp_replace(four, r"(\.\d\d)(\d?[1-9])?0*$", "$1$2")))


def shown_duration(seconds: Column) -> Column:
    whole = seconds.cast("int")
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).otherwise(F.format_string("%dm %ds", F.floor(whole / 60).cast("int"), whole % 60))


def shown_bytes(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n < 1e3, F.format_string("%.0f bytes", n)).when(n < 1e6, F.format_string("%.0f KB", n / 1e3)).when(n < 1e9, F.format_string("%.1f MB", n / 1e6)).otherwise(F.format_string("%.2f GB", n / 1e9))


def metric_row(label: str, value: Column, width: int = 22) -> Column:
    return F.concat(F.rpad(F.lit(label + ":"), width, " "), F.lit(" "), value.cast("string"), F.lit("\n"))


def remaining_seconds(elapsed: Column, pages_done: Column, docs_left: Column, pages_total: Column, docs_total: Column) -> Column:
    """Elapsed a page, for what is left at the (whole) mean of pages a document."""
    mean = F.when(docs_total > 0, F.floor(pages_total / docs_total)).otherwise(F.lit(0))
    return F.when(pages_done > 0, elapsed / pages_done * docs_left * mean)
