"""Documents from files: validation as rows, text with a fallback of encodings, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_BYTES, MAX_PAGES = 100_000_000, 1000
# File extensions and their types.
TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "bmp": "image/bmp",
    "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "rtf": "application/rtf", "html": "text/html", "htm": "text/html", "json": "application/json", "xml": "application/xml", "csv": "text/csv",
}
OCR_TYPES = tuple(sorted({t for t in TYPES.values() if t == "application/pdf" or t.startswith("image/")}))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def mime_type(path: Column) -> Column:
    """By extension, null for types that aren't supported."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), extension(path))


def supported(paths: DataFrame, path_col: str = "path") -> DataFrame:
    return paths.filter(mime_type(F.col(path_col)).isNotNull())


def pathway(mime: Column) -> Column:
    """PDFs and images are read by OCR, everything else is cleaned directly."""
    return F.when(mime.isin(list(OCR_TYPES)), "ocr").otherwise("clean")


def problem(size: Column, mime: Column, pages: Column) -> Column:
    """The first reason against a file, null if it can be loaded."""
    return F.when(size.isNull(), "not_readable").when(size <= 0, "empty").when(size > MAX_BYTES, "too_large").when(mime.isNull(), "unsupported_type").when(pages > MAX_PAGES, "too_many_pages")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, else UTF-16 if it begins with its mark, else ASCII with what isn't ASCII replaced."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    marked = F.hex(F.substring(content, 1, 2)).isin("FEFF", "FFFE")
    ascii_ = F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[^\x00-\x7F]", "�")
    return F.when(marked, F.decode(content, "UTF-16")).otherwise(F.coalesce(utf8, ascii_))


def pdf_pages(content: Column) -> Column:
    """Page objects in a PDF's bytes, else the greatest /Count of its page trees; 1 if neither can be seen (compressed object streams hide them)."""
    text = F.decode(content, "ISO-8859-1")
    counted = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"/Count\s+(\d{1,6})"), F.lit(1)), lambda n: n.cast("int")))
    return F.greatest(F.regexp_count(text, F.lit(r"/Type\s*/Page[^s]")), F.coalesce(counted, F.lit(0)), F.lit(1))


def pdf_problem(content: Column) -> Column:
    """corrupted without a PDF's mark or end, encrypted with an encryption dictionary, else null."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(~F.substring(text, 1, 1024).contains("%PDF-") | ~text.contains("%%EOF"), "corrupted").when(text.rlike(r"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<"), "encrypted")


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, name, mime, size, pages, pathway, error, text): a bad file is a row with an error.

    Spark's reader lists no empty files, so `empty` arises only for tables of sizes from elsewhere.
    """
    raw = spark.read.format("binaryFile").load(path)
    mime = mime_type(F.col("path"))
    rows = raw.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), mime.alias("mime"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    rows = rows.withColumn("pages", F.when(F.col("mime") == "application/pdf", pdf_pages(F.col("content"))).otherwise(1))
    rows = rows.withColumn("error", F.coalesce(problem(F.col("size"), F.col("mime"), F.col("pages")), F.when(F.col("mime") == "application/pdf", pdf_problem(F.col("content"))))).withColumn("pathway", pathway(F.col("mime")))
    return rows.withColumn("text", F.when(F.col("error").isNull() & (F.col("pathway") == "clean"), decoded(F.col("content")))).drop("content")


def validated(files: DataFrame) -> DataFrame:
    return files.select("path", F.struct(F.col("error").isNull().alias("valid"), F.col("error").alias("reason")).alias("validation"))


def from_table(docs: DataFrame, id_col: str, text_col: str, name: Column | None = None) -> DataFrame:
    """Any table with text as imported documents: one page, no cost, completed."""
    from .pages import imported

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), (F.concat(F.lit("doc-"), F.col(id_col).cast("string")) if name is None else name).alias("name"), text.alias("text"), imported(text).alias("result"), F.lit("completed").alias("status"))


def take_slots(docs: DataFrame, slots: int, order: str = "seq") -> DataFrame:
    """As many documents as there are free slots, in order (the limit is the feature)."""
    return docs.orderBy(order).limit(max(0, slots))
