"""Pages: replies of OCR services as pages, and text that needs none."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.estimates import page_cost

REPLY = (
    "struct<model:string,pages:array<struct<index:int,markdown:string,"
    "tables:array<struct<id:string,markdown:string,html:string>>,"
    "images:array<struct<id:string,top_left_x:int,top_left_y:int,bottom_right_x:int,bottom_right_y:int,image_base64:string>>,"
    "dimensions:struct<width:int,height:int,dpi:int>>>>"
)
PAGES = "array<struct<index:int,markdown:string,tables:array<struct<id:string,markdown:string>>,images:array<struct<id:string>>>>"
DIRECT_MODEL = "direct-text-import"


def imported(text: Column) -> Column:
    """A result struct for text that was read directly."""
    page = F.struct(F.lit(0).alias("index"), text.alias("markdown"), F.array().cast("array<struct<id:string,markdown:string>>").alias("tables"), F.array().cast("array<struct<id:string>>").alias("images"))
    return F.struct(F.array(page).alias("pages"), F.lit(DIRECT_MODEL).alias("model"), F.lit(0).cast("decimal(18,6)").alias("cost"))


def request(kind: Column, address: Column, model: str = "ocr-latest", tables: str = "markdown", images: bool = False) -> Column:
    """The JSON payload that asks a service for a document's pages: documents by address, images by address or data."""
    by_kind = F.when(kind.startswith("image/"), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("document_url"), address.alias("image_url"))).otherwise(
        F.struct(F.lit("document_url").alias("type"), address.alias("document_url"), F.lit(None).cast("string").alias("image_url"))
    )
    return F.to_json(F.struct(by_kind.alias("document"), F.lit(images).alias("include_image_base64"), F.lit(model).alias("model"), F.lit(tables).alias("table_format")))


def data_url(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def from_reply(reply: Column) -> Column:
    """A result struct from a service's JSON reply: a table's Markdown, else its HTML; the cost follows from the pages."""
    r = F.from_json(reply, REPLY)
    tables = lambda p: F.transform(F.coalesce(p["tables"], F.array()), lambda t: F.struct(t["id"].alias("id"), F.coalesce(t["markdown"], t["html"], F.lit("")).alias("markdown")))
    images = lambda p: F.transform(F.coalesce(p["images"], F.array()), lambda i: F.struct(i["id"].alias("id")))
    pages = F.transform(r["pages"], lambda p: F.struct(p["index"].alias("index"), F.coalesce(p["markdown"], F.lit("")).alias("markdown"), tables(p).alias("tables"), images(p).alias("images")))
    return F.struct(pages.alias("pages"), r["model"].alias("model"), page_cost(F.size(r["pages"])).alias("cost"))


def http_error(status: Column) -> Column:
    """What a status code means, and null for success."""
    return (
        F.when(status.between(200, 299), None).when(status == 401, "invalid_key").when(status == 403, "forbidden").when(status == 404, "not_found").when(status == 413, "too_large")
        .when(status == 422, "unprocessable").when(status == 429, "rate_limited").when(status >= 500, "server_error").otherwise("bad_request")
    )


def retryable(error: Column) -> Column:
    return error.isin("rate_limited", "server_error", "timeout")
