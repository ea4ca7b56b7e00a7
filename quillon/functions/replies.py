"""Replies of language models as structured data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lines import let

REGION = "struct<type:string,lineRange:struct<start:int,end:int>,startLine:int,endLine:int,start:int,end:int,confidence:string,evidence:array<string>>"
PATTERN = "struct<detected:boolean,style:string,pattern:string,confidence:string,samples:array<string>>"
STRUCTURE = f"struct<detectedContentType:string,contentTypeConfidence:string,regions:array<{REGION}>,patterns:struct<pageNumbers:{PATTERN},citations:{PATTERN},footnoteMarkers:{PATTERN}>,overallConfidence:string,warnings:array<string>>"
BOUNDARY = "struct<startLine:int,endLine:int,confidence:string,notes:string>"
#: The shapes of replies, by what was asked.
SHAPES = {
    "structure": STRUCTURE,
    "content_type": "struct<contentType:string,confidence:string,reasoning:string,alternativeTypes:array<struct<type:string,confidence:string>>>",
    "patterns": f"struct<pageNumbers:{PATTERN},citations:{PATTERN},footnoteMarkers:{PATTERN}>",
    "boundary": BOUNDARY,
    "lists": "struct<lists:array<struct<type:string,startLine:int,endLine:int,confidence:string,header:string>>>",
    "citations": "struct<style:string,count:int,samples:array<string>,patterns:array<string>,confidence:string>",
    "footnotes": "struct<markerStyle:string,markerPattern:string,sections:array<struct<startLine:int,endLine:int,confidence:string>>,confidence:string>",
    "chapters": "struct<chapters:array<struct<line:int,title:string>>,parts:array<struct<line:int,title:string>>,confidence:string>",
    "metadata": "struct<title:string,subtitle:string,author:string,publisher:string,publishDate:string,language:string,genre:string,isbn:string>",
}


def json_of(reply: Column) -> Column:
    """From the first { to the last }, without a fence around; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))


def number(value: Column) -> Column:
    """A number that may have come as text."""
    return F.expr("null").cast("double") if value is None else value.try_cast("double")


def parsed(reply: Column, shape: str) -> Column:
    return F.from_json(json_of(reply), SHAPES[shape])


def regions(reply: Column) -> Column:
    """Structs (type, start, end, confidence, evidence) of a structure reply; those without lines are dropped."""
    found = F.transform(
        parsed(reply, "structure")["regions"],
        lambda r: F.struct(
            r["type"].alias("type"), F.coalesce(r["lineRange"]["start"], r["startLine"], r["start"]).alias("start"), F.coalesce(r["lineRange"]["end"], r["endLine"], r["end"]).alias("end"),
            F.coalesce(number(r["confidence"]), F.lit(0.5)).alias("confidence"), F.coalesce(r["evidence"], F.array().cast("array<string>")).alias("evidence"),
        ),
    )
    return F.coalesce(F.filter(found, lambda r: r["type"].isNotNull() & r["start"].isNotNull() & r["end"].isNotNull()), F.array().cast("array<struct<type:string,start:int,end:int,confidence:double,evidence:array<string>>>"))


def content_type(reply: Column) -> Column:
    """A struct (content_type, confidence, error): required fields that are missing are named."""

    def read(j: Column, p: Column) -> Column:
        error = F.when(j.isNull(), "no_json").when(p["contentType"].isNull(), "missing contentType").when(number(p["confidence"]).isNull(), "missing confidence")
        return let(lambda e: F.struct(F.when(e.isNull(), p["contentType"]).alias("content_type"), F.when(e.isNull(), number(p["confidence"])).alias("confidence"), e.alias("error")), error)

    return let(lambda j: let(read, j, F.from_json(j, SHAPES["content_type"])), json_of(reply))


def detected_pattern(reply: Column, name: str) -> Column:
    p = parsed(reply, "patterns")[name]
    return F.when(F.coalesce(p["detected"], F.lit(False)), F.struct(p["style"].alias("style"), p["pattern"].alias("pattern"), number(p["confidence"]).alias("confidence")))


def _range(r: Column, *more: Column) -> Column:
    return F.struct(r["startLine"].alias("start"), r["endLine"].alias("end"), F.coalesce(number(r["confidence"]), F.lit(0.5)).alias("confidence"), *more)


def boundary(reply: Column) -> Column:
    """A struct (start, end, confidence, notes) of a boundary reply, as `clean` takes for a proposal; null without JSON."""
    return let(lambda p: F.when(p.isNotNull(), _range(p, p["notes"].alias("notes"))), parsed(reply, "boundary"))


def lists(reply: Column) -> Column:
    """Structs (start, end, confidence, type, header) of a reply on auxiliary lists; those without lines are dropped."""
    found = F.transform(parsed(reply, "lists")["lists"], lambda r: _range(r, r["type"].alias("type"), r["header"].alias("header")))
    return F.filter(found, lambda r: r["start"].isNotNull() & r["end"].isNotNull())


def citation_style(reply: Column) -> Column:
    """A struct (style, count, samples, patterns, confidence)."""
    none = F.array().cast("array<string>")
    made = lambda p: F.struct(p["style"].alias("style"), F.coalesce(p["count"], F.lit(0)).alias("count"), F.coalesce(p["samples"], none).alias("samples"), F.coalesce(p["patterns"], none).alias("patterns"), F.coalesce(number(p["confidence"]), F.lit(0.5)).alias("confidence"))
    return let(lambda p: F.when(p.isNotNull(), made(p)), parsed(reply, "citations"))


def footnote_style(reply: Column) -> Column:
    """A struct (style, pattern, sections (start, end, confidence), confidence)."""
    made = lambda p: F.struct(p["markerStyle"].alias("style"), p["markerPattern"].alias("pattern"), F.filter(F.transform(p["sections"], lambda r: _range(r)), lambda r: r["start"].isNotNull()).alias("sections"), F.coalesce(number(p["confidence"]), F.lit(0.5)).alias("confidence"))
    return let(lambda p: F.when(p.isNotNull(), made(p)), parsed(reply, "footnotes"))


def chapter_list(reply: Column) -> Column:
    """A struct of chapters and parts, each structs (line, title) in the order of their lines."""
    inorder = lambda c: F.array_sort(F.filter(F.coalesce(c, F.array().cast("array<struct<line:int,title:string>>")), lambda x: x["line"].isNotNull()))
    return let(lambda p: F.when(p.isNotNull(), F.struct(inorder(p["chapters"]).alias("chapters"), inorder(p["parts"]).alias("parts"))), parsed(reply, "chapters"))


def metadata(reply: Column) -> Column:
    """The fields of a metadata reply, null without JSON or title."""
    return let(lambda p: F.when(p["title"].isNotNull(), p), parsed(reply, "metadata"))
