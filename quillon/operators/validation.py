"""Whether a section may be removed: its place, size and confidence first, then its content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions import fixed
from ..functions.lines import count_words, join_lines, let, trim, window_of

# Of each kind of section, how early it may begin, how late it may end, the greatest share of lines,
# the least confidence, the fewest lines, and what must be known.
LIMITS = {
    "frontMatter": {"max_end": 0.40, "max_share": 0.40, "min_conf": 0.60, "min_lines": 3, "needs": "end"},
    "tableOfContents": {"max_end": 0.35, "max_share": 0.20, "min_conf": 0.60, "min_lines": 5, "needs": "both"},
    "index": {"min_start": 0.60, "max_share": 0.25, "min_conf": 0.65, "min_lines": 10, "needs": "start"},
    "backMatter": {"min_start": 0.50, "max_share": 0.45, "min_conf": 0.70, "min_lines": 5, "needs": "start"},
    "auxiliaryLists": {"max_end": 0.40, "max_share": 0.15, "min_conf": 0.65, "min_lines": 3, "needs": "both"},
    "footnotesEndnotes": {"max_share": 0.12, "early_share": 0.05, "min_conf": 0.70, "min_lines": 4, "needs": "both"},
    "other": {"max_share": 0.50, "min_conf": 0.50, "needs": "any"},
}


def _judged(section: str, start: Column, end: Column, confidence: Column, n: Column) -> Column:
    rule = LIMITS[section]
    needs = rule["needs"]
    missing = {"end": end.isNull(), "start": start.isNull(), "both": start.isNull() | end.isNull(), "any": start.isNull() & end.isNull()}[needs]
    first = F.lit(0) if needs == "end" else F.coalesce(start, F.lit(0)) if needs == "any" else start
    last = F.coalesce(end, n - 1)
    size, total = last - first + 1, n.cast("double")
    bad = [(missing, "no_boundary")]
    if needs == "any":
        outside = ((start.isNotNull() & ((start < 0) | (start >= n))) | (end.isNotNull() & ((end < 0) | (end >= n))), "out_of_bounds")
        bad += [outside, (start.isNotNull() & end.isNotNull() & (start > end), "inverted"), (start.isNotNull() & end.isNotNull() & (size / total > rule["max_share"]), "too_large")]
    elif needs == "both":
        bad += [(start > end, "inverted"), ((start < 0) | (end >= n), "out_of_bounds")]
    elif needs == "end":
        bad += [((end < 0) | (end >= n), "out_of_bounds")]
    else:
        bad += [((start < 0) | (start >= n), "out_of_bounds")]
    if "max_end" in rule:
        bad.append((end / total > rule["max_end"], "too_late"))
    if "min_start" in rule:
        bad.append((start / total < rule["min_start"], "too_early"))
    if needs != "any":
        share = F.when(start / total < 0.5, F.lit(rule["early_share"])).otherwise(F.lit(rule["max_share"])) if "early_share" in rule else F.lit(rule["max_share"])
        bad.append((size / total > share, "too_large"))
    if "min_lines" in rule:
        bad.append(((end if needs == "end" else size) < rule["min_lines"], "too_small"))
    bad.append((confidence < rule["min_conf"], "low_confidence"))
    return reduce(lambda other, b: F.when(b[0], b[1]).otherwise(other), reversed(bad), F.lit("valid"))


def boundary_reason(section: Column, start: Column, end: Column, confidence: Column, n: Column) -> Column:
    """`valid`, `no_boundary` (which is valid too, but removes nothing), or the first reason against a boundary."""
    c = _judged("other", start, end, confidence, n)
    for name in LIMITS:
        if name != "other":
            c = F.when(section == name, _judged(name, start, end, confidence, n)).otherwise(c)
    return F.when(start.isNull() & end.isNull(), "no_boundary").otherwise(c)


def _headers(lines: Column, first: int | None, names: tuple[str, ...], strict: bool) -> Column:
    """The names that occur in the upper-cased first lines; as whole lines only if strict."""
    part = lines if first is None else F.slice(lines, 1, first)
    names = tuple(dict.fromkeys(names))
    if strict:
        plain = F.transform(part, lambda x: F.upper(F.regexp_replace(trim(x), r"^#{1,6}\s*", "")))
        return F.filter(F.array(*[F.lit(x.upper()) for x in names]), lambda h: F.array_contains(plain, h))
    return let(lambda text: F.filter(F.array(*[F.lit(x.upper()) for x in names]), lambda h: F.contains(text, h)), F.upper(join_lines(part)))


def _holding(pattern: str):
    return lambda x: x.rlike(pattern)


def _any(lines: Column, patterns: tuple[str, ...], flags: str = "") -> Column:
    return F.exists(lines, lambda x: reduce(lambda a, b: a | b, [x.rlike(flags + p) for p in patterns]))


def _how_many(lines: Column, patterns: tuple[str, ...], flags: str = "") -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [F.exists(lines, _holding(flags + p)).cast("int") for p in patterns])


def _lines(lines: Column, patterns: tuple[str, ...], flags: str = "") -> Column:
    """How many matches the patterns have, a line counting once for each."""
    return reduce(lambda a, b: a + b, [F.size(F.filter(lines, _holding(flags + p))) for p in patterns])


def _verdict(reason: Column, confidence: Column) -> Column:
    return F.struct(reason.isNull().alias("valid"), F.when(reason.isNull(), confidence).otherwise(0.0).alias("confidence"), F.coalesce(reason, F.lit("verified")).alias("reason"))


def _confirm_back(part: Column, strict: bool) -> Column:
    found = F.size(_headers(part, 30, fixed.CONFIRM_BACK, strict))
    marked = _how_many(part, fixed.CONFIRM_BACK_PATTERNS)
    chapters = _any(part, fixed.CHAPTERS, "(?iu)")
    reason = F.when(chapters & (found == 0), "chapter_content").when((found == 0) & (marked == 0), "no_expected_headers")
    total = found + (marked + found)
    c = F.when(total >= 3, 0.9).when(total >= 2, 0.75).otherwise(0.6)
    return _verdict(reason, F.when(chapters, c * 0.7).otherwise(c))


def _confirm_index(part: Column, strict: bool) -> Column:
    header = F.size(_headers(part, 10, fixed.CONFIRM_INDEX, strict)) > 0
    entries = _lines(part, (fixed.CONFIRM_INDEX_ENTRY,))
    chapters = _any(part, fixed.CHAPTERS, "(?iu)")
    reason = F.when(chapters & ~header & (entries < 5), "chapter_content").when(~header & (entries < 10), "no_expected_headers")
    return _verdict(reason, F.when(header & (entries >= 20), 0.95).when(header & (entries >= 10), 0.85).when(entries >= 30, 0.75).otherwise(0.65))


def _confirm_front(part: Column, whole: Column) -> Column:
    text = join_lines(part)
    count = let(lambda t: F.size(F.filter(F.array(*[F.lit(x) for x in fixed.CONFIRM_FRONT]), lambda h: F.contains(t, h))), text)
    copyright_ = text.contains("©") | F.lower(text).contains("copyright") | F.lower(text).contains("all rights reserved")
    reason = F.when(_any(whole, fixed.CHAPTERS, "(?iu)"), "chapter_content")
    return _verdict(reason, F.when(copyright_ & text.contains("ISBN"), 0.9).when(copyright_ | (count >= 3), 0.8).when(count >= 1, 0.6).otherwise(0.4))


def _confirm_toc(part: Column, strict: bool) -> Column:
    header = F.size(_headers(part, None, fixed.CONFIRM_TOC, strict)) > 0
    entries = _lines(part, (fixed.CONFIRM_TOC_ENTRY, fixed.CONFIRM_TOC_LISTING))
    reason = F.when(~header & (entries < 5), "no_expected_headers")
    return _verdict(reason, F.when(header & (entries >= 10), 0.95).when(header & (entries >= 5), 0.85).when(entries >= 10, 0.7).otherwise(0.6))


def _listed(header: Column, entries: Column, chapters: Column) -> Column:
    c = F.when(header & (entries >= 5), 0.9).when(header & (entries >= 2), 0.8).when(entries >= 10, 0.7).when(header, 0.65).otherwise(0.5)
    return F.when(chapters, c * 0.7).otherwise(c)


def _confirm_list(part: Column, strict: bool) -> Column:
    header = (F.size(_headers(part, 10, fixed.CONFIRM_LIST, strict)) > 0) | _any(part, fixed.CONFIRM_LIST_PATTERNS)
    entries = _lines(part, fixed.LIST_ENTRIES, "(?iu)")
    chapters = _any(part, fixed.CHAPTERS, "(?iu)")
    prose = F.size(F.filter(part, lambda x: (F.length(trim(x)) > 100) & ~trim(x).contains("...") & ~trim(x).contains("\t")))
    reason = F.when(chapters & ~header & (entries < 3), "chapter_content").when((prose > 5) & ~header, "narrative_prose").when(~header & (entries < 5), "no_expected_headers")
    return _verdict(reason, _listed(header, entries, chapters))


def _confirm_notes(part: Column, strict: bool) -> Column:
    header = (F.size(_headers(part, 10, fixed.CONFIRM_NOTES, strict)) > 0) | _any(part, fixed.CONFIRM_NOTES_PATTERNS)
    entries = _lines(part, fixed.CONFIRM_NOTES_ENTRIES, "(?iu)")
    chapters = _any(part, fixed.CHAPTERS, "(?iu)")
    text = join_lines(part)
    prose = reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in fixed.NARRATIVE])
    reason = F.when(chapters & ~header, "chapter_content").when((prose > 3) & ~header & (entries < 5), "narrative_prose").when(~header & (entries < 5), "no_expected_headers")
    return _verdict(reason, _listed(header, entries, chapters))


def verify_content(section: str, lines: Column, start: Column, end: Column | None = None, strict_headers: bool = False, examined: int = 100) -> Column:
    """A struct (valid, confidence, reason) from at most 100 lines of a section, of which it must have five.

    By default a heading counts wherever its letters occur; strict_headers takes whole lines only.
    """
    n = F.size(lines)
    last = F.least(n - 1 if end is None else F.coalesce(end, n - 1), n - 1)
    whole = window_of(lines, start, last - start + 1)
    checks = {
        "backMatter": lambda part, _: _confirm_back(part, strict_headers), "index": lambda part, _: _confirm_index(part, strict_headers), "frontMatter": _confirm_front,
        "tableOfContents": lambda part, _: _confirm_toc(part, strict_headers), "auxiliaryLists": lambda part, _: _confirm_list(part, strict_headers), "footnotesEndnotes": lambda part, _: _confirm_notes(part, strict_headers),
    }
    fits = (start >= 0) & (start < n) & (last - start + 1 >= 5)
    fail = F.struct(F.lit(False).alias("valid"), F.lit(0.0).alias("confidence"), F.lit("insufficient_content").alias("reason"))
    checked = let(checks[section], F.slice(whole, 1, examined), whole) if section in checks else F.struct(F.lit(True).alias("valid"), F.lit(1.0).alias("confidence"), F.lit("not_applicable").alias("reason"))
    return F.when(F.coalesce(fits, F.lit(False)), checked).otherwise(fail)


def step_anomaly(step: int, before: Column, after: Column, changes: Column, detected: Column | None = None, calls: Column | None = None) -> Column:
    """What is odd about a step's effect (most severe first), from line counts before and after; null if nothing is."""
    out = F.lit(None).cast("string")
    if step == 15:
        out = F.when(changes == 0, "info: no chapters detected").otherwise(out)
    if step in (9, 10, 11) and calls is not None:
        out = F.when((changes == 0) & (calls > 0), "warning: patterns detected but nothing changed").otherwise(out)
    if step in (5, 6, 7, 8) and detected is not None:
        out = F.when((changes == 0) & detected, "warning: section detected but nothing removed").otherwise(out)
    if 3 <= step <= 11:
        out = F.when(after > before, "warning: a removal step added lines").otherwise(out)
    return F.when((before > 0) & ((before - after) / before > 0.5), "critical: over half of the lines removed").otherwise(out)


def review(original: Column, cleaned: Column, heavy: Column) -> Column:
    """A struct (score, severity) from the words that are left; heavy kinds of text may lose more."""
    return review_counts(count_words(original), count_words(cleaned), heavy)


def review_counts(a: Column, b: Column, heavy: Column) -> Column:
    """`review` from the words before and after."""
    ratio = b / F.greatest(a, F.lit(1))
    critical, warning = F.when(heavy, 0.35).otherwise(0.5), F.when(heavy, 0.6).otherwise(0.8)
    score = F.when(b < 10, 0.1).when(ratio < critical, 0.4).when(ratio < warning, 0.6).otherwise(0.7)
    return F.struct(score.alias("score"), F.when((b < 10) | (ratio < critical), "critical").when(ratio < warning, "warning").alias("severity"))
