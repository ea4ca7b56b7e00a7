"""Bibliographic data: rendering, titles from file names, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

FIELDS = ("subtitle", "author", "translator", "editor", "series", "series_number", "publisher", "publish_date", "edition", "isbn", "original_title", "original_language", "original_date", "language", "genre")
ORIGINAL = ("original_title", "original_language", "original_date")
#: How Markdown labels a field, in its order.
LABELS = {"subtitle": "Subtitle", "author": "Author", "translator": "Translator", "editor": "Editor", "publisher": "Publisher", "publish_date": "Published", "genre": "Genre"}
ORIGINAL_LABELS = {"original_title": "Original Title", "original_language": "Original Language", "original_date": "Original Date"}


def _given(meta: Column, name: str) -> Column:
    return F.nullif(meta[name], F.lit(""))


def yaml_value(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(value.rlike(r"[:#'\"\n\[\]{},&*!|>%@`]|^[ \-?]| $"), quoted).otherwise(value)


def is_translation(meta: Column) -> Column:
    return reduce(lambda a, b: a | b, [_given(meta, f).isNotNull() for f in (*ORIGINAL, "translator")])


def to_yaml(meta: Column) -> Column:
    """meta: a struct of title and FIELDS, with chapters (int) and has_parts (boolean)."""
    rows = [F.concat(F.lit("title: "), yaml_value(meta["title"]))]
    for f in FIELDS:
        row = F.concat(F.lit(f"{f}: "), yaml_value(_given(meta, f)))
        if f in ORIGINAL:
            row = F.when(is_translation(meta), row)
        if f == "series_number":
            row = F.when(_given(meta, "series").isNotNull(), row)
        rows.append(row)
    rows.append(F.when(meta["chapters"] > 0, F.concat(F.lit("chapters: "), meta["chapters"].cast("string"))))
    rows.append(F.when(meta["has_parts"], F.lit("has_parts: true")))
    return F.concat_ws("\n", F.lit("---"), *rows, F.lit("---"))


def to_json(meta: Column) -> Column:
    """Pretty, with sorted keys and without empty fields."""
    escape = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), c)
    rows = {f: F.concat(F.lit(f'  "{f}": "'), escape(_given(meta, f)), F.lit('"')) for f in FIELDS}
    rows["title"] = F.concat(F.lit('  "title": "'), escape(meta["title"]), F.lit('"'))
    rows["chapters"] = F.when(meta["chapters"] > 0, F.concat(F.lit('  "chapters": '), meta["chapters"].cast("string")))
    rows["has_parts"] = F.when(meta["has_parts"], F.lit('  "has_parts": true'))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *[rows[k] for k in sorted(rows)]), F.lit("\n}"))


def to_markdown(meta: Column) -> Column:
    rows = [F.concat(F.lit("**Title:** "), meta["title"])]
    rows += [F.concat(F.lit(f"**{label}:** "), _given(meta, f)) for f, label in LABELS.items()]
    number = _given(meta, "series_number")
    rows.append(F.concat(F.lit("**Series:** "), _given(meta, "series"), F.coalesce(F.concat(F.lit(" #"), number), F.lit(""))))
    rows += [F.concat(F.lit("**Edition:** "), _given(meta, "edition")), F.concat(F.lit("**ISBN:** "), _given(meta, "isbn"))]
    translated = is_translation(meta)
    rows += [F.when(translated, F.lit("")), F.when(translated, F.lit("*Originally published as:*"))]
    rows += [F.when(translated, F.concat(F.lit(f"**{label}:** "), _given(meta, f))) for f, label in ORIGINAL_LABELS.items()]
    return F.concat_ws("  \n", *rows)


def formatted(meta: Column, style: str) -> Column:
    return {"yaml": to_yaml, "json": to_json, "markdown": to_markdown}[style](meta)


def title_header(title: Column, subtitle: Column | None = None, author: Column | None = None, date: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    part = lambda c, before, after: F.coalesce(F.concat(F.lit(before), F.nullif(none if c is None else c, F.lit("")), F.lit(after)), F.lit(""))
    up = lambda c: None if c is None else F.upper(c)
    return F.concat(F.lit("# "), F.upper(title), part(up(subtitle), ": ", ""), part(up(author), " (", ")"), part(date, " [", "]"))


def title_from_filename(name: Column) -> Column:
    plain = F.trim(F.translate(F.regexp_replace(name, r"(?s)\.[^.]*$", ""), "_-", "  "))
    return F.when(plain == "", "Untitled Document").otherwise(plain)


def merged(meta: Column, other: Column) -> Column:
    """other's fields where it has them."""
    title = F.coalesce(F.nullif(other["title"], F.lit("")), meta["title"])
    return F.struct(title.alias("title"), *[F.coalesce(other[f], meta[f]).alias(f) for f in (*FIELDS, "chapters", "has_parts")])


def blank(title: Column, author: Column | None = None, chapters: Column | None = None, has_parts: Column | None = None) -> Column:
    """A metadata struct of which little is known."""
    none = F.lit(None).cast("string")
    fields = [(author if f == "author" and author is not None else none).alias(f) for f in FIELDS]
    return F.struct(title.alias("title"), *fields, (F.lit(None).cast("int") if chapters is None else chapters.cast("int")).alias("chapters"), (F.lit(None).cast("boolean") if has_parts is None else has_parts).alias("has_parts"))
