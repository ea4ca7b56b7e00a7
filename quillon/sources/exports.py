"""Exports: Markdown, JSON and plain text, the cleaning report, unique file names, batches."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.estimates import metric_row, rating
from ..functions.lines import count_words
from ..functions.markdown import headings, page_plain, strip_markdown

SCHEMA_VERSION = "1.1"
FORMATS = ("json", "markdown", "plain_text")
EXTENSIONS = {"json": "json", "markdown": "md", "plain_text": "txt"}
_RULE, _THIN = "═" * 63, "─" * 63


@dataclass(frozen=True)
class ExportOptions:
    metadata: bool = True
    front_matter: bool = True
    cost: bool = True
    time: bool = True
    report: bool = False
    pretty: bool = True


MINIMAL = ExportOptions(metadata=False, front_matter=False, cost=False, time=False, pretty=False)

#: Columns of a document to export: name, extension, size, mime, pages (array of structs index, markdown), model,
#: cost, seconds, completed (timestamp), text (cleaned, or null), original_words, confidence, steps (array of structs).


def _full(pages: str = "pages") -> Column:
    return F.array_join(F.transform(pages, lambda p: p["markdown"]), "\n\n---\n\n")


def _stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _best() -> Column:
    return F.coalesce("text", _full())


def report() -> Column:
    """The cleaning report in an HTML comment; a step counts as a success if it was enabled."""
    cleaned = count_words(_best())
    share = F.when(F.col("original_words") > 0, (F.col("original_words") - cleaned) / F.col("original_words") * 100).otherwise(0.0)
    signed = F.concat(F.format_number(cleaned, 0), F.lit("    ("), F.when(share >= 0, "−").otherwise("+"), F.format_string("%.1f", F.abs(share)), F.lit("%)"))
    steps = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("  Step "), F.format_string("%2d", s["step"]), F.lit(": "), F.rpad(s["name"], 28, " "), F.lit(" "), F.when(s["enabled"], "Success").otherwise("Skipped"))), "\n")
    score = F.concat((F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    parts = [
        F.lit(f"<!-- \n{_RULE}\nCLEANING REPORT\n{_RULE}\n\nDOCUMENT METRICS\n{_THIN}\n"), metric_row("Original Words", F.format_number("original_words", 0)), metric_row("Cleaned Words", signed),
        metric_row("Characters", F.format_number(F.length(_best()), 0)), metric_row("Est. Pages", F.concat(F.lit("~"), F.greatest(F.lit(1), F.floor(cleaned / 250)).cast("string"))),
        F.coalesce(F.concat(F.lit(f"\nPIPELINE CONFIDENCE\n{_THIN}\n"), metric_row("Score", score), metric_row("Level", rating(F.col("confidence")))), F.lit("")),
        F.lit(f"\nEXECUTED STEPS\n{_THIN}\n"), steps, F.lit(f"\n{_RULE}\n-->"),
    ]
    return F.concat(*parts)


def _with_report(text: Column, options: ExportOptions) -> Column:
    return F.concat(text, F.when(F.col("text").isNotNull(), F.concat(F.lit("\n\n"), report())).otherwise(F.lit(""))) if options.report else text


def to_markdown(options: ExportOptions = ExportOptions()) -> Column:
    rows = [
        F.concat(F.lit('source_file: "'), F.col("name"), F.lit("."), F.col("extension"), F.lit('"')), F.concat(F.lit("source_pages: "), F.size("pages").cast("string")),
        F.concat(F.lit('processed_date: "'), _stamp(F.col("completed")), F.lit('"')), F.concat(F.lit('processor: "'), F.col("model"), F.lit('"')),
    ]
    if options.time:
        rows.append(F.format_string("processing_time_seconds: %.1f", F.col("seconds").cast("double")))
    if options.cost:
        rows.append(F.concat(F.lit("api_cost_usd: "), F.regexp_replace(F.regexp_replace(F.col("cost").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")))
    rows += [F.concat(F.lit("word_count: "), count_words(_full()).cast("string")), F.concat(F.lit("character_count: "), F.length(_full()).cast("string"))]
    head = F.concat(F.lit("---\n"), F.concat_ws("\n", *rows), F.lit("\n---\n\n")) if options.front_matter and options.metadata else F.lit("")
    return _with_report(F.concat(head, _best()), options)


def to_plain(options: ExportOptions = ExportOptions()) -> Column:
    rule = F.lit("=" * 60 + "\n")
    plain = F.when(F.col("text").isNotNull(), strip_markdown(F.col("text"))).otherwise(F.array_join(F.transform("pages", lambda p: page_plain(p["markdown"])), "\n\n"))
    rows = [
        F.concat(F.lit("Source: "), F.col("name"), F.lit("."), F.col("extension"), F.lit("\n")), F.concat(F.lit("Pages: "), F.size("pages").cast("string"), F.lit("\n")),
        F.concat(F.lit("Words: "), count_words(_full()).cast("string"), F.lit("\n")), F.concat(F.lit("Processed: "), _stamp(F.col("completed")), F.lit("\n")),
    ]
    head = F.concat(rule, *rows, rule, F.lit("\n")) if options.metadata else F.lit("")
    return _with_report(F.concat(head, plain), options)


def to_json(options: ExportOptions = ExportOptions()) -> Column:
    """Schema 1.1 with sorted keys; cleaned text if there is some."""
    text = _best()
    page = lambda p: F.struct(p["index"].alias("index"), p["markdown"].alias("markdown"), page_plain(p["markdown"]).alias("plainText"), count_words(p["markdown"]).alias("wordCount"))
    content = F.struct(F.length(text).alias("characterCount"), text.alias("fullText"), F.transform("pages", page).alias("pages"), strip_markdown(text).alias("plainText"), count_words(text).alias("wordCount"))
    fields = {
        "content": content,
        "schemaVersion": F.lit(SCHEMA_VERSION),
        "source": F.struct(F.concat_ws(".", "name", "extension").alias("filename"), F.col("size").alias("fileSizeBytes"), F.col("mime").alias("mimeType"), F.size("pages").alias("pageCount")),
        "structure": F.struct(F.flatten(F.transform("pages", lambda p: headings(p["markdown"], p["index"]))).alias("headings")),
    }
    if options.metadata:
        known = [F.col("model").alias("model"), _stamp(F.col("completed")).alias("timestamp")]
        if options.time:
            known.insert(0, F.col("seconds").alias("durationSeconds"))
        if options.cost:
            known.insert(0, F.col("cost").alias("costUSD"))
        fields["processing"] = F.struct(*known)
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"pretty": "true"} if options.pretty else {})


RENDERERS = {"markdown": to_markdown, "json": to_json, "plain_text": to_plain}


def rendered(docs: DataFrame, formats: Sequence[str] = ("markdown",), options: ExportOptions = ExportOptions()) -> DataFrame:
    """Rows (id, format, filename, content) of the completed documents that have a result, formats in their order by name."""
    ready = docs.filter("status = 'completed' AND pages IS NOT NULL")
    made = F.array(*[F.struct(F.lit(f).alias("format"), F.concat_ws(".", "name", F.lit(EXTENSIONS[f])).alias("filename"), RENDERERS[f](options).alias("content")) for f in sorted(formats)])
    return unique_names(ready.select("id", "seq", F.explode(made).alias("m")).select("id", "seq", "m.*")).drop("seq")


def unique_names(files: DataFrame, name: str = "filename", order: str = "seq", slots: int = 64) -> DataFrame:
    """A name that came before gets -1, -2 and so on before its extension.

    Rows are counted by name and slot of the order, so a name that very many share is numbered in as many tasks as there
    are slots; the driver gets the ends of the slots.
    """
    ends = files.agg(F.percentile_approx(order, [k / slots for k in range(1, slots)], 10_000)).first()[0] or []
    slot = F.size(F.filter(F.array(*map(F.lit, sorted(set(ends)))).cast("array<double>"), lambda e: e < F.col(order)))
    dealt = files.withColumn("__slot", F.coalesce(slot, F.lit(0)))
    counts = dealt.groupBy(name, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(name, "__slot", (F.sum("__n").over(Window.partitionBy(name).orderBy("__slot")) - F.col("__n")).alias("__before"))
    numbered = dealt.withColumn("__k", F.row_number().over(Window.partitionBy(name, "__slot").orderBy(order)) - 1).join(before, [name, "__slot"])
    k = F.col("__k") + F.col("__before")
    again = F.concat(F.regexp_replace(F.col(name), r"(\.[^.]*)?$", ""), F.lit("-"), k.cast("string"), F.regexp_extract(name, r"(\.[^.]*)?$", 0))
    return numbered.withColumn(name, F.when(k == 0, F.col(name)).otherwise(again)).select(*files.columns)


def export_batch(docs: DataFrame, folder: str, formats: Sequence[str] = ("markdown",), options: ExportOptions = ExportOptions()) -> DataFrame:
    """Writes rendered documents as Parquet dealt by format; returns what was left out and why."""
    rendered(docs, formats, options).write.mode("overwrite").partitionBy("format").parquet(folder)
    return docs.filter("status <> 'completed' OR pages IS NULL").select("id", F.when(F.col("status") != "completed", F.concat(F.lit("status "), F.col("status"))).otherwise("no result").alias("reason"))


def preview(content: Column, chars: int = 2000) -> Column:
    return F.substring(content, 1, chars)
