"""Markdown as plain text, headings, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .chars import may_pair, remove_emphasis
from .lines import count_words, has_any, has_other_ends, join_lines, let, split_lines, trim_all


def _sub(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, text)


def to_plain(text: Column) -> Column:
    """For counting.  Links are unwrapped before images, so an image leaves its alternative text after `!`."""
    return trim_all(_unmarked(text))


def _unmarked(text: Column) -> Column:
    """Each pattern is tried only where a character that it needs occurs."""
    line = lambda x: F.when(x.startswith("#"), F.regexp_replace(x, r"^#{1,6}\s+", "")).otherwise(x)
    text = let(lambda t: F.when(t.contains("#") | has_other_ends(t), join_lines(F.transform(split_lines(t), line))).otherwise(t), text)
    where = lambda t, found, pattern, to: let(lambda x: F.when(has_any(x, found), F.regexp_replace(x, pattern, to)).otherwise(x), t)
    for found, pattern, to in (("](", r"\[([^\]]+)\]\([^)]+\)", "$1"), ("![", r"!\[.*?\]\(.*?\)", ""), ("`", r"`([^`]+)`", "$1"), ("  ", "  +", " ")):
        text = where(remove_emphasis(text) if found == "](" else text, found, pattern, to)
    return text


def count_semantic_words(text: Column) -> Column:
    """Blanks at the ends are no words."""
    return count_words(_unmarked(text))


def count_semantic_words_in(lines: Column, text: Column, words: Column) -> Column:
    """`count_semantic_words` of a text whose lines and words are known: without marks of other kinds, the heading marks are what doesn't count."""
    marked = lambda t: may_pair(t, "*") | may_pair(t, "_") | has_any(t, "](", "`")
    headings_ = F.size(F.filter(lines, lambda x: x.startswith("#") & x.rlike(r"^#{1,6}\s+")))
    return let(lambda t: F.when(marked(t), count_semantic_words(t)).otherwise(words - headings_), text)


def cleaned_plain(text: Column) -> Column:
    """A cleaned document without its metadata block, markers and formatting."""
    return trim_all(
        _sub(
            text, (r"^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"---\n[\s\S]*?\n---\n?", ""),
            (r"\*\*\*\s*<!--.*?-->", ""), (r"<CHAPTER>.*?</CHAPTER>", ""), (r"<!--\s*CHAPTER:.*?-->", ""),
        )
    )


def page_plain(text: Column) -> Column:
    return trim_all(_sub(text, (r"(?m)^#{1,6}\s*", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"__(.+?)__", "$1"), (r"_(.+?)_", "$1"), (r"\[(.+?)\]\(.+?\)", "$1"), (r"!\[.*?\]\(.+?\)", "")))


def strip_markdown(text: Column) -> Column:
    """For export; only a heading at the very beginning loses its mark."""
    return _sub(text, (r"^#{1,6}\s*", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"__(.+?)__", "$1"), (r"_(.+?)_", "$1"), (r"\[(.+?)\]\(.+?\)", "$1"))


def headings(text: Column, page: Column | None = None) -> Column:
    """Structs (level, text, page) of the lines that begin with one to four # and a space."""
    page = F.lit(None).cast("int") if page is None else page.cast("int")
    marked = F.filter(split_lines(text), lambda x: x.rlike(r"^#{1,4} "))
    return F.transform(marked, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#+) ", 1)).alias("level"), F.regexp_replace(x, r"^#{1,4} ", "").alias("text"), page.alias("page")))


def table_rows(table: Column) -> Column:
    """Rows of |...| lines without separator rows."""
    return F.size(F.filter(F.split(table, "\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^\|[\s\-:|]+\|$")))


def table_columns(table: Column) -> Column:
    first = F.get(F.filter(F.split(table, "\n"), lambda x: F.trim(x).startswith("|")), 0)
    return F.coalesce(F.size(F.filter(F.split(first, r"\|"), lambda x: F.trim(x) != "")), F.lit(0))
