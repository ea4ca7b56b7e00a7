"""Repairing characters: broken encodings, ligatures, OCR slips, dashes, quotes, Markdown marks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed
from .lines import beyond_ascii, has_any, has_other_ends, join_lines, let, once_each, relined, split_lines, trim
from .segments import CODE, protecting, triggered


def _replaced(text: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _sub(text: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, text)


def _where(text: Column, test: str, change) -> Column:
    """change where a pattern occurs; the text is evaluated once."""
    return let(lambda t: F.when(t.rlike(test), change(t)).otherwise(t), text)


def _with(text: Column, literals: Sequence[str], change) -> Column:
    """change where one of some literals occurs."""
    return let(lambda t: F.when(has_any(t, *literals), change(t)).otherwise(t), text)


def _beyond_ascii(text: Column, change) -> Column:
    """change for texts with other than ASCII characters."""
    return let(lambda t: F.when(beyond_ascii(t), change(t)).otherwise(t), text)


def fix_mojibake(text: Column) -> Column:
    """Broken encodings repaired, the longest first, so that none hides another."""
    one_of = lambda at: "[" + "".join(sorted({re.escape(k[at]) for k in fixed.MOJIBAKE})) + "]"
    broken = one_of(0) + one_of(1)  # two classes, as an alternative for each prefix would be tried at every character
    first = sorted({k[0] for k in fixed.MOJIBAKE})
    return _with(text, first, lambda s: _where(s, broken, lambda t: _replaced(t, sorted(fixed.MOJIBAKE.items(), key=lambda p: (-len(p[0]), p[0])))))


def expand_ligatures(text: Column) -> Column:
    return _beyond_ascii(text, lambda s: _with(s, list(fixed.LIGATURES), lambda t: _replaced(t, fixed.LIGATURES.items())))


def remove_invisible(text: Column) -> Column:
    return _beyond_ascii(text, lambda s: _with(s, fixed.INVISIBLE, lambda t: F.translate(t, fixed.INVISIBLE, "")))


def fix_ocr_digits(text: Column) -> Column:
    """O between digits becomes 0, from left to right, and l between digits or before one at a word's start becomes 1."""
    zero = r"(?:(?<=[\p{N}.,])|\G(?<=O))O(?=[O\p{N}.,]|\s|$|[\p{P}&&[^.,]])"
    one = r"(?<=[\p{N}.,])l(?=[\p{N}.,])|(?:(?<=\s)|^)l(?=\p{N})"
    # The letter comes first in the tests, as few characters are it.
    zeros = let(lambda t: F.when(t.contains("O") & t.rlike(r"O(?<=[\p{N}.,]O)"), F.regexp_replace(t, zero, "0")).otherwise(t), text)
    el = lambda t: t.rlike(r"l[\p{N}.,](?<=[\p{N}.,\s]l.)") | (t.startswith("l") & t.rlike(r"^l\p{N}"))
    return let(lambda t: F.when(el(t), F.regexp_replace(t, one, "1")).otherwise(t), zeros)


def _dash_remnants(line: Column) -> Column:
    return _with(line, "—", _long_remnants)


def _long_remnants(line: Column) -> Column:
    return _sub(line, (r"—\s+-", "—"), ("—-", "—"), (r"-\s+—", "—"), ("-—", "—"), ("——", "—"), (r"—\s+—", "—"), ("— - ", "— "), (" - —", " —"))


def normalize_dashes(lines: Column) -> Column:
    """Per line: one kind of long dash, set between spaces; rules of three marks stay."""
    return F.transform(lines, _normal_dashes)


def _normal_dashes(line: Column) -> Column:
    x = _replaced(_dash_remnants(line), (("--", "—"), ("―", "—")))
    x = _with(x, "—", lambda t: _sub(t, (r"(?<=\S)—", " —"), (r"—(?=\S)", "— ")))
    x = _with(_replaced(x, ((" – ", " — "), ("‒", "-"), ("‑", "-"))), ["  "], lambda t: F.regexp_replace(t, "  +", " "))
    marked = has_any(line, "-", "  ") | (beyond_ascii(line) & has_any(line, *"–—―‒‑"))
    return F.when(~marked | trim(line).isin("---", "***", "___"), line).otherwise(_dash_remnants(x))


def remove_decorative_dashes(lines: Column) -> Column:
    """Without lines of long dashes, page numbers between them, and runs of them inside lines."""
    return F.transform(F.filter(lines, lambda x: ~_decorative(x)), _undecorated)


def _decorative(x: Column) -> Column:
    might = x.contains("—") | x.contains("\n") | has_other_ends(x)
    return might & (trim(x).rlike(r"^[—\s]+$") | x.rlike(r"^\s*—\s*[\divxlcdmIVXLCDM]+\s*—\s*$"))


def _undecorated(x: Column) -> Column:
    return F.when(x.contains("—"), F.regexp_replace(x, r"(?:—\s*){2,}", "")).otherwise(x)


def normalize_quotes(text: Column) -> Column:
    found = lambda t: t.contains("`") | (beyond_ascii(t) & has_any(t, *"".join(fixed.QUOTES)))
    straight = lambda t: F.translate(t, "".join(fixed.QUOTES), "".join(to * len(those) for those, to in fixed.QUOTES.items()))
    return let(lambda t: F.when(found(t), straight(t)).otherwise(t), text)


def may_pair(text: Column, mark: str) -> Column:
    """Whether something stands between two of a mark, so that they may be emphasis; a text with one run of up to three has none."""
    between = lambda t: F.octet_length(t) - F.octet_length(F.substring_index(t, mark, 1)) - F.octet_length(F.substring_index(t, mark, -1))
    return let(lambda t: t.contains(mark) & let(lambda n: (n > 3) | ((n == 3) & ~t.contains(mark * 3)), between(t)), text)


def remove_emphasis(text: Column) -> Column:
    pairs = (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"(?<![*\n])\*([^*\n]+)\*(?!\*)", "$1"), (r"(?<![_\n])_([^_\n]+)_(?!_)", "$1")
    return let(lambda t: F.when(may_pair(t, "*") | may_pair(t, "_"), _sub(t, *pairs)).otherwise(t), text)


def normalize_whitespace(text: Column) -> Column:
    return _sub(text, ("\r\n?", "\n"), (r"(?m)[\s&&[^\n]]+$", ""), ("\n{4,}", "\n\n\n"))


def clean_characters(text: Column, removed: Sequence[str] = fixed.REMOVED_CHARACTERS) -> Column:
    """The whole chain; code is left alone.  Brackets become parentheses, other removed characters go."""
    return protecting(text, CODE, lambda t: _tidied(join_lines(_repaired(split_lines(t))), removed), "`")


#: What ends a line that an opening parenthesis of it may be the last sign of, so that a pair may span lines.
_OPEN_END = r"\([^\n0-9A-Za-z]*(?:\n|$)"


def clean_character_lines(lines: Column, protected: str, trigger: str) -> Column:
    """The lines of the joined lines after `clean_characters` outside of protected passages.

    Where nothing is protected and no mark may pair with one of another line, each different line is cleaned by itself.
    """

    def apart(t):
        marked = has_any(t, "*", "_", "`", "[") | has_other_ends(t) | triggered(t, trigger)
        return ~(marked | (t.contains("(") & t.rlike(_OPEN_END)))

    each = lambda x: let(lambda made: F.when(F.size(made) > 0, made).otherwise(F.array(F.lit(""))), _repaired(x, lambda line: _tidied(line, fixed.REMOVED_CHARACTERS)))
    whole = lambda x: relined(protecting(join_lines(x), protected, clean_characters, trigger))
    return let(lambda x, alone: F.when(alone, each(x)).otherwise(whole(x)), lines, let(apart, join_lines(F.array_distinct(lines))))


def _repaired(lines: Column, then: Callable[[Column], Column] = lambda x: x) -> Column:
    """Encodings, ligatures, slips and dashes, none of which looks beyond its line; decorative lines go."""

    def one(line):
        made = let(_normal_dashes, fix_ocr_digits(remove_invisible(expand_ligatures(fix_mojibake(line)))))
        return let(lambda x: F.when(~_decorative(x), then(_undecorated(x))), made)

    return F.filter(once_each(lines, one), lambda x: x.isNotNull())


def _tidied(t: Column, removed: Sequence[str]) -> Column:
    t = remove_emphasis(normalize_quotes(t))
    t = _with(t, ["!["], lambda x: F.regexp_replace(x, r"!\[.*?\]\(.*?\)", ""))
    t = _with(t, "[]", lambda x: F.translate(x, "[]", "()"))
    t = _replaced(t, [(c, "") for c in removed if c not in ("[", "]", "—")])
    return _with(_with(t, ["  "], lambda x: F.regexp_replace(x, "  +", " ")), "(", lambda x: F.regexp_replace(x, r"\(\s*\)", ""))
