"""Removing lines: by pattern, by value, by range."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions import fixed
from ..functions.lines import kept, let, trim
from ..functions.segments import in_any


def valid_patterns(patterns: Iterable[str]) -> list[str]:
    """Those that compile; a pattern that doesn't is skipped, as it would match nothing."""
    out = []
    for p in patterns:
        try:
            re.compile(re.sub(r"\\p\{\w+\}|\\x\{\w+\}|&&", ".", p))
            out.append(p)
        except re.error:
            pass
    return out


def matches_any(line: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern spans the whole trimmed line, ignoring case; never for a blank line."""
    t = trim(line)
    whole = "|".join(f"(?:{p})" for p in patterns)
    return (t != "") & t.rlike(f"(?iu)^(?:{whole})$")


def drop_matching(lines: Column, patterns: Sequence[str] = fixed.PAGE_NUMBERS) -> Column:
    patterns = valid_patterns(patterns)
    return kept(lines, lambda x: ~matches_any(x, patterns)) if patterns else lines


def strict_page_numbers() -> list[str]:
    """The page-number patterns without Roman numerals that are words too (did, mix, civil)."""
    roman = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
    out = []
    for p in fixed.PAGE_NUMBERS:
        p = p.replace("[ivxlcdm]+", f"(?!(?:i|mix|civil|did|dim|mild|mid|vivid|livid)\\b){roman}").replace("[IVXLCDM]+", f"(?!(?:i|mix)\\b){roman}")
        out.append(p)
    return out


def drop_exact(lines: Column, values: Column) -> Column:
    """Without lines that equal one of values when both are trimmed."""
    wanted = F.transform(values, trim)
    return F.filter(lines, lambda x: ~F.array_contains(wanted, trim(x)))


def range_reason(start: Column, end: Column, n: Column) -> Column:
    """Why a range can't be removed, null if it can."""
    return F.when(start < 0, "negative_start").when(start >= n, "beyond_end").when(F.least(end, n - 1) < start, "end_before_start")


def remove_range(lines: Column, start: Column, end: Column) -> Column:
    """Without an inclusive range; a bad one removes nothing."""
    ok = F.coalesce(range_reason(start, end, F.size(lines)).isNull() & start.isNotNull() & end.isNotNull(), F.lit(False))
    return F.when(ok, F.filter(lines, lambda x, i: (i < start) | (i > end))).otherwise(lines)


def remove_range_except(lines: Column, start: Column, end: Column, kept: Column) -> Column:
    """Without an inclusive range but for the zones in kept (structs of start and end); a line is kept once."""
    ok = F.coalesce(range_reason(start, end, F.size(lines)).isNull(), F.lit(False))
    return F.when(ok, F.filter(lines, lambda x, i: (i < start) | (i > end) | in_any(kept, i))).otherwise(lines)


def remove_ranges(lines: Column, ranges: Column) -> Column:
    """Without several inclusive ranges (structs of start and end); bad ones are skipped."""
    n = F.size(lines)
    good = F.filter(ranges, lambda r: range_reason(r["start"], r["end"], n).isNull())
    return let(lambda found: F.when(F.size(found) > 0, F.filter(lines, lambda x, i: ~in_any(found, i))).otherwise(lines), good)


def remove_ranges_report(lines: Column, ranges: Column) -> Column:
    """A struct of the lines left, how many went, the ranges taken and the ranges refused with a reason."""
    n = F.size(lines)
    left = remove_ranges(lines, ranges)
    judged = F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), range_reason(r["start"], r["end"], n).alias("reason")))
    return F.struct(
        left.alias("lines"), (n - F.size(left)).alias("removed"), F.filter(judged, lambda r: r["reason"].isNull()).alias("accepted"), F.filter(judged, lambda r: r["reason"].isNotNull()).alias("rejected")
    )


def pattern_lines(lines: Column, patterns: Sequence[str], most: int = 50) -> Column:
    """The first lines that hold a match of a pattern."""
    found = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in patterns])
    return F.slice(F.filter(lines, found), 1, most)
