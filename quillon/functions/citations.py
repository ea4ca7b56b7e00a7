"""Citations and footnote markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed
from .lines import beyond_ascii, count_changes, has_any, join_lines, let, split_lines, trim
from .segments import DOI_OR_DECIMAL, protecting


def remove_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """A struct of the text without the patterns' matches, one after the other, and their number."""

    def step(t, n, rest):
        if not rest:
            return F.struct(t.alias("text"), n.alias("n"))
        return let(lambda x, k: step(x, k, rest[1:]), F.regexp_replace(t, rest[0], ""), n + F.regexp_count(t, F.lit(rest[0])))

    done = step(text, F.lit(0), list(patterns))
    return let(lambda r: F.struct(F.when(r["n"] > 0, F.regexp_replace(r["text"], "  +", " ")).otherwise(r["text"]).alias("text"), r["n"].alias("n")), done)


def _where(text: Column, test: str, change) -> Column:
    return let(lambda t: F.when(t.rlike(test), change(t)).otherwise(t), text)


def _without(text: Column, patterns: Sequence[str]) -> Column:
    removed = lambda t: reduce(lambda c, p: F.regexp_replace(c, p, ""), patterns, t)
    return let(lambda t, out: F.when(out != t, F.regexp_replace(out, "  +", " ")).otherwise(t), text, removed(text))


def is_bibliography(line: Column) -> Column:
    t = trim(line)
    words = reduce(lambda a, b: a | b, [t.contains(w) for w in fixed.BIBLIOGRAPHY_WORDS])
    shape = t.rlike(r"\(\d{4}\)\s*\.") | t.rlike(r"\d{4}\s*[.,]?\s*$") | words | (t.contains("_") & t.contains("."))
    periods = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) >= 3
    return (F.length(t) > 20) & t.rlike(r"^[A-Z][a-zA-Z'\-]+,\s+[A-Z]") & (shape | periods)


def clean_orphans(text: Column) -> Column:
    """What citations leave behind, in this order; a text without the characters that the patterns need is left at once.

    Without an opening parenthesis only the patterns that need none are tried, each where it can match.
    """
    blanks = " \t\n\x0b\x0c\r"
    needs = {r",\s*,": (",,", *(f"{b}," for b in blanks)), r"\s+,": tuple(f"{b}," for b in blanks), r";\s*\)": (")",), "  +": ("  ",)}
    pairs = (*fixed.ORPHANS, ("  +", " "))
    few = lambda t: reduce(lambda c, p: let(lambda x: F.when(has_any(x, *needs[p[0]]), F.regexp_replace(x, p[0], p[1])).otherwise(x), c), [p for p in pairs if p[0] in needs], t)
    return let(lambda t: F.when(t.contains("("), reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, t)).otherwise(few(t)), text)


def _one_line(line: Column, patterns: Sequence[str]) -> Column:
    change = lambda ps: protecting(line, DOI_OR_DECIMAL, lambda t: _without(t, ps))
    if not patterns:
        return change(fixed.CITATIONS)
    return let(lambda own: F.when(own != line, own).otherwise(change(fixed.CITATIONS)), change(patterns))


def remove_citations(text: Column, patterns: Sequence[str] = ()) -> Column:
    """A struct of the text without citations and the number of lines that changed.

    Bibliography lines stay, decimals and DOIs are never touched, and a document's own patterns come
    before the common ones, which serve where those find nothing.
    """
    return let(lambda t, done: F.struct(done.alias("text"), count_changes(t, done).alias("n")), text, without_citations(text, patterns))


def without_citations(text: Column, patterns: Sequence[str] = ()) -> Column:
    """The text that `remove_citations` leaves, without counting."""
    # ibid and cit are looked for from one letter on before the words are, as a choice would be tried at every character.
    words = lambda x: x.rlike("[Ii](?:[Bb][Ii][Dd]|(?<=[Cc][Ii])[Tt])") & x.rlike(r"(?i:ibid|op\.?\s*cit|loc\.?\s*cit)")
    might = lambda x: has_any(x, "(", "[") | (beyond_ascii(x) & x.rlike("[²³¹⁰-⁹]")) | words(x)
    lines = F.transform(split_lines(text), lambda x: F.when(~might(x) | is_bibliography(x) if not patterns else is_bibliography(x), x).otherwise(_one_line(x, patterns)))
    for mark, pattern in (("(", r"\(\s*\)"), ("[", r"\[\s*\]")):
        lines = let(lambda t, m=mark, p=pattern: F.when(t.contains(m), F.regexp_replace(t, p, "")).otherwise(t), join_lines(lines) if mark == "(" else lines)
    return clean_orphans(lines)


def remove_footnote_markers(text: Column, pattern: str | None = None) -> Column:
    """A struct of the text without markers and their number."""
    if pattern:
        return remove_patterns(text, [pattern, *fixed.FOOTNOTE_MARKERS])
    return let(lambda t: F.when(_marked(t), remove_patterns(t, fixed.FOOTNOTE_MARKERS)).otherwise(F.struct(t.alias("text"), F.lit(0).alias("n"))), text)


def _marked(text: Column) -> Column:
    return has_any(text, *"[^*") | (beyond_ascii(text) & text.rlike("[¹²³⁰-⁹†‡§¶‖]"))


def count_citations(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in fixed.CITATIONS])
