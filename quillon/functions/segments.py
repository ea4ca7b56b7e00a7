"""Protected passages: a text is split into protected and plain parts, and only plain ones change.

No placeholder stands in the text meanwhile, so nothing can damage one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .lines import beyond_ascii, has_any, let

FENCED = r"```[a-zA-Z0-9]*\n[\s\S]*?```"
INLINE_CODE = r"`[^`\n]+`"
CODE = f"{FENCED}|{INLINE_CODE}"
#: At least two lines of |...| with a separator row; a block may begin with further rows.
TABLE = r"(?m)^[ \t]*\|.*\|[ \t]*$(?:\n[ \t]*\|.*\|[ \t]*$)*\n[ \t]*\|[\s\-:|]+\|[ \t]*$(?:\n[ \t]*\|.*\|[ \t]*$)*|(?m)^[ \t]*\|[\s\-:|]+\|[ \t]*$(?:\n[ \t]*\|.*\|[ \t]*$)+"
_SUPER, _SUB, _GREEK = "²³¹⁰-⁹", "₀-₉", "α-ωΑ-Ω"
MATH = "|".join(
    (
        rf"(?m)^.*[{_GREEK}].*=.*[{_SUPER}{_SUB}√∑∫].*$",
        rf"[-•]\s*[A-Za-z]+:.*[²³⁴-⁹]",
        rf"[Ww]here\s+[{_GREEK}][^.\n]*[²³⁴-⁹{_SUB}]",
        rf"[A-Z]\s*=\s*[a-zA-Zα-ω]+[{_SUPER}]",
        rf"(?:sin|cos|tan|log|ln|exp)[{_SUPER}]",
        rf"[a-zA-Z{_GREEK}][{_SUPER}]+",
    )
)
DOI_OR_DECIMAL = r"(?i:(?:doi:\s*)?10\.\d{4,}/[^\s]+)|\b\d+\.\d+\b"


#: Without one of these characters a text has no table, code or formula.
TRIGGER = rf"[|`{_SUPER}{_SUB}{_GREEK}]"


def protecting(text: Column, protected: str, change: Callable[[Column], Column], trigger: str | None = None) -> Column:
    """change applied to what lies between the matches of a pattern; a text without a trigger has none."""
    return let(lambda t: _protecting(t, protected, change, trigger), text)


def _protecting(text: Column, protected: str, change: Callable[[Column], Column], trigger: str | None) -> Column:
    parts = F.split(text, _choice(text, protected, "(?:{})"), -1)
    kept = F.regexp_extract_all(text, _choice(text, protected, "({})"), F.lit(0))
    if trigger:  # one part without a trigger, so change is in the plan once
        on = triggered(text, trigger)
        split = F.when(on, F.struct(parts.alias("parts"), kept.alias("kept"))).otherwise(F.struct(F.array(text).alias("parts"), F.array().cast("array<string>").alias("kept")))
    else:
        split = F.struct(parts.alias("parts"), kept.alias("kept"))
    changed = lambda s: F.zip_with(F.transform(s["parts"], lambda x: change(x)), s["kept"], lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(text.isNotNull(), F.array_join(let(changed, split), ""))


def triggered(text: Column, trigger: str) -> Column:
    """text.rlike(trigger); the characters of the common ones are looked for without decoding the text."""
    if trigger not in (TRIGGER, "`", "[|`]"):
        return text.rlike(trigger)
    found = has_any(text, *[c for c in "|`" if c in trigger])
    return found | (beyond_ascii(text) & text.rlike(trigger)) if trigger == TRIGGER else found


def _choice(text: Column, protected: str, form: str) -> Column:
    """A shield without the formulas for texts that have none of their characters; they are the costly part of it."""
    if not protected.endswith(f"|{MATH}"):
        return F.lit(form.format(protected))
    return F.when(beyond_ascii(text) & text.rlike(f"[{_SUPER}{_SUB}{_GREEK}]"), form.format(protected)).otherwise(form.format(protected.removesuffix(f"|{MATH}")))


def extracted(text: Column, protected: str) -> Column:
    """The protected passages in order."""
    return F.regexp_extract_all(text, F.lit(f"({protected})"), F.lit(0))


def shield(*, code: bool = True, math: bool = True, tables: bool = True) -> str:
    """One pattern for all protected kinds; the longer kinds come first."""
    return "|".join(p for p, on in ((TABLE, tables), (CODE, code), (MATH, math)) if on)


def table_blocks(lines: Column) -> Column:
    """Structs (start, end) of the runs of |...| lines that are tables: two lines or more, one of them a separator row."""
    row = lambda x: F.trim(x).rlike(r"^\|.*\|$")
    marks = F.transform(lines, lambda x, i: F.struct(i.alias("i"), row(x).alias("on"), F.trim(x).rlike(r"\|[\s\-:]+\|").alias("sep")))
    none = F.lit(None).cast("int")
    start = F.struct(none.alias("from"), F.lit(False).alias("sep"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    closed = lambda acc, end: F.when(acc["sep"] & (end > acc["from"]), F.concat(acc["out"], F.array(F.struct(acc["from"].alias("start"), end.alias("end"))))).otherwise(acc["out"])

    def step(acc, m):
        opened = F.struct(F.coalesce(acc["from"], m["i"]).alias("from"), (acc["sep"] | m["sep"]).alias("sep"), acc["out"].alias("out"))
        shut = F.struct(none.alias("from"), F.lit(False).alias("sep"), F.when(acc["from"].isNotNull(), closed(acc, m["i"] - 1)).otherwise(acc["out"]).alias("out"))
        return F.when(m["on"], opened).otherwise(shut)

    return F.aggregate(marks, start, step, lambda acc: F.when(acc["from"].isNotNull(), closed(acc, F.size(lines) - 1)).otherwise(acc["out"]))


def code_ranges(lines: Column) -> Column:
    """Structs (start, end) between ``` lines; one that isn't closed reaches to the last line."""
    found = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x).startswith("```"), i)), lambda i: i.isNotNull())
    return let(
        lambda fences, n: F.transform(
            F.filter(F.transform(fences, lambda i, k: F.struct(i.alias("i"), k.alias("k"))), lambda f: f["k"] % 2 == 0),
            lambda f: F.struct(f["i"].alias("start"), F.coalesce(F.get(fences, f["k"] + 1), n - 1).alias("end")),
        ),
        found,
        F.size(lines),
    )


def in_any(ranges: Column, line: Column) -> Column:
    return F.exists(ranges, lambda r: (line >= r["start"]) & (line <= r["end"]))
