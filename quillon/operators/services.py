"""What surrounds the cleaning of documents: kinds of regions, limits by content, kept patterns, retries, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lines import let

# Kinds of regions by where they stand, and those that are removed by default.
FRONT_REGIONS = ("frontMatter", "titlePage", "copyrightPage", "dedication", "epigraph", "tableOfContents", "listOfFigures", "listOfTables", "listOfAbbreviations", "preface", "foreword", "introduction", "abstract")
CORE_REGIONS = ("coreContent", "chapter", "section", "partDivision")
BACK_REGIONS = ("backMatter", "appendix", "appendices", "notes", "bibliography", "glossary", "index", "colophon", "aboutAuthor", "acknowledgments")
REMOVED_REGIONS = ("frontMatter", "titlePage", "copyrightPage", "dedication", "tableOfContents", "listOfFigures", "listOfTables", "listOfAbbreviations", "index", "backMatter", "colophon", "aboutAuthor")
# Steps that a kind of content rules out, and how long its paragraphs may be (others: DEFAULT_WORDS).
DISABLED_STEPS = {"poetry": (13, 14), "drama": (13,), "legal": (10, 11), "academic": (10,), "technical": (10,)}
PARAGRAPH_WORDS = {"childrens": 100, "poetry": 50, "drama": 50, "legal": 300}
DEFAULT_WORDS = 250
PATTERN_SECONDS = 3600
EVENT_KINDS = ("cleaningStarted", "cleaningCompleted", "cleaningFailed", "fallbackUsed", "feedbackSubmitted", "issueReported")
MOST_EVENTS = 1000


def region_class(kind: Column) -> Column:
    """front, core, back, or other."""
    return F.when(kind.isin(*FRONT_REGIONS), "front").when(kind.isin(*CORE_REGIONS), "core").when(kind.isin(*BACK_REGIONS), "back").otherwise("other")


def removed_by_default(kind: Column) -> Column:
    return kind.isin(*REMOVED_REGIONS)


def region_bounds(regions: Column) -> Column:
    """Of structs (type, start, end): a struct (front_end, back_start), the last line of front and the first of back regions, null where there is none."""
    ends = lambda rs: F.array_max(F.transform(F.filter(rs, lambda r: region_class(r["type"]) == "front"), lambda r: r["end"]))
    starts = lambda rs: F.array_min(F.transform(F.filter(rs, lambda r: region_class(r["type"]) == "back"), lambda r: r["start"]))
    return let(lambda rs: F.struct(ends(rs).alias("front_end"), starts(rs).alias("back_start")), regions)


def disabled_steps(kind: Column) -> Column:
    """The steps that a kind of content rules out."""
    out = F.array().cast("array<int>")
    for k, steps in DISABLED_STEPS.items():
        out = F.when(kind == k, F.array(*[F.lit(s) for s in steps])).otherwise(out)
    return out


def paragraph_words(kind: Column) -> Column:
    out = F.lit(DEFAULT_WORDS)
    for k, n in PARAGRAPH_WORDS.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def fresh(cache: DataFrame, now: Column, seconds: int = PATTERN_SECONDS, at: str = "cached_at") -> DataFrame:
    """The kept patterns that aren't older than seconds, fractions of one included."""
    return cache.filter(now - F.col(at) <= F.make_dt_interval(secs=F.lit(seconds)))


def with_patterns(docs: DataFrame, cache: DataFrame, detect: Column, now: Column, seconds: int = PATTERN_SECONDS, id_col: str = "doc_id", order: str | None = None) -> DataFrame:
    """docs with a column patterns: kept ones (doc_id, patterns, cached_at; the latest counts) that are fresh, else detect; from_cache says which.

    Null patterns are none.  Of patterns kept at the same time the least of a column order counts, if one is named.
    """
    latest = F.col("cached_at") if order is None else F.struct("cached_at", (-F.col(order)).alias("order"))
    kept = fresh(cache, now, seconds).filter(F.col("patterns").isNotNull()).groupBy("doc_id").agg(F.max_by("patterns", latest).alias("__kept")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(kept, docs[id_col] == kept["__id"], "left")
    return joined.withColumn("from_cache", F.col("__kept").isNotNull()).withColumn("patterns", F.coalesce("__kept", detect)).drop("__kept", "__id")


def retried(session: DataFrame) -> DataFrame:
    """Failed documents are pending again, without their error."""
    failed = F.col("status") == "failed"
    out = session.withColumn("error", F.when(~failed, F.col("error"))) if "error" in session.columns else session
    return out.withColumn("status", F.when(failed, "pending").otherwise(F.col("status")))


def next_batch(session: DataFrame, paused: bool = False, cancelled: bool = False) -> DataFrame:
    """The pending documents in their order; none while paused or cancelled."""
    return session.filter((F.col("status") == "pending") & F.lit(not (paused or cancelled))).orderBy("seq")


def events_of(cleaned: DataFrame, at: Column, mode: str = "V3", seconds: Column | None = None, fallback: Column | None = None) -> DataFrame:
    """(doc_id, timestamp, event_type, pipeline_mode, data) for cleaned documents: started, and completed or failed (a null text).

    data is a map of strings with numbers in fixed forms, as events are compared as text.
    """
    none = F.lit(None).cast("string")
    done = F.map_from_arrays(
        F.array(*map(F.lit, ("confidence", "duration", "usedFallback"))),
        F.array(F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), F.format_string("%.1f", F.lit(0.0) if seconds is None else seconds), F.coalesce((F.lit(False) if fallback is None else fallback).cast("string"), none)),
    )
    started = F.struct(F.lit(EVENT_KINDS[0]).alias("event_type"), F.create_map(F.lit("wordCount"), F.col("original_words").cast("string")).alias("data"))
    ended = F.when(F.col("text").isNull(), F.struct(F.lit(EVENT_KINDS[2]).alias("event_type"), F.create_map(F.lit("error"), F.lit("no text")).alias("data"))).otherwise(F.struct(F.lit(EVENT_KINDS[1]).alias("event_type"), done.alias("data")))
    rows = cleaned.select("doc_id", at.alias("timestamp"), F.explode(F.array(started, ended)).alias("e"))
    return rows.select("doc_id", "timestamp", "e.event_type", F.lit(mode).alias("pipeline_mode"), "e.data")


def recorded(events: DataFrame, folder: str) -> None:
    """Appends events to a Parquet table."""
    events.write.mode("append").parquet(folder)
