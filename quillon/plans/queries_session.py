"""Queries on sessions, files, costs, events and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import estimates
from ..operators import metrics, sessions
from ..sources import documents, exports, pages

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A session made of the pages table.
_SESSION = """s AS (SELECT page_id AS seq, concat('d', page_id) AS id, concat('File ', page_id % 40) AS name, CASE page_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'completed' END AS status,
page_id % 7 AS pages, (page_id % 7) * 0.001 AS cost, page_id % 6 >= 4 AS in_library, page_id % 6 = 5 AS cleaned, coalesce(url, '') AS text FROM pages)"""


def session(spark, sf_dir):
    p = F.col("page_id")
    status = F.when(p % 6 == 0, "pending").when(p % 6 == 1, "processing").when(p % 6 == 2, "failed").otherwise("completed")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        p.alias("seq"), F.concat(F.lit("d"), p.cast("string")).alias("id"), F.concat(F.lit("File "), (p % 40).cast("string")).alias("name"), status.alias("status"), (p % 7).alias("pages"), estimates.page_cost(p % 7).alias("cost"), (p % 6 >= 4).alias("in_library"), (p % 6 == 5).alias("cleaned"), F.coalesce("url", F.lit("")).alias("text")
    )


_VIEWS_SQL = ", ".join(f"count(*) FILTER (WHERE {c}) AS {name}" for name, c in sessions.VIEWS.items())


@query(f"WITH {_SESSION} SELECT {_VIEWS_SQL} FROM s")
def session_badges(spark, sf_dir):
    """P11, P12."""
    return sessions.badges(session(spark, sf_dir))


@query(f"WITH {_SESSION} SELECT id, name FROM s WHERE in_library AND (contains(lower(name), 'ile 1') OR contains(lower(text), '/fr/'))")
def library_search(spark, sf_dir):
    """P13, T1."""
    found = sessions.search(sessions.view(session(spark, sf_dir), "library"), "ILE 1")
    both = found.unionByName(sessions.search(sessions.view(session(spark, sf_dir), "library"), "/FR/")).distinct()
    return sessions.ordered(both, [("name", True)]).select("id", "name")


@query(f"WITH {_SESSION} SELECT id, CASE WHEN in_library THEN 'complete' WHEN cleaned THEN 'processing' WHEN status IN ('pending', 'failed', 'cancelled') THEN 'pending' ELSE 'processing' END AS stage FROM s")
def workflow_stages(spark, sf_dir):
    """P14."""
    return session(spark, sf_dir).select("id", sessions.stage(F.col("in_library"), F.col("cleaned"), F.col("status")).alias("stage"))


@query(f"WITH {_SESSION} SELECT CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(cost) AS DOUBLE) AS cost, count(*) FILTER (WHERE cost > 0) AS processed, count(*) FILTER (WHERE status = 'completed' AND NOT cleaned) AS read_only, count(*) FILTER (WHERE cleaned) AS cleaned_docs FROM s")
def session_totals(spark, sf_dir):
    """G12, G13, G15."""
    return sessions.totals(session(spark, sf_dir)).withColumn("cost", F.col("cost").cast("double"))


@query(f"WITH {_SESSION}, u AS (SELECT * FROM s WHERE seq % 10 = 0) SELECT id, CASE WHEN seq % 10 = 0 THEN 'cancelled' ELSE status END AS status, seq % 10 = 3 OR in_library AS in_library FROM s WHERE seq % 13 <> 0")
def session_changes(spark, sf_dir):
    """Documents removed, updated and put into the library."""
    s = session(spark, sf_dir)
    out = sessions.removed(s, s.filter("seq % 13 = 0").select("id"))
    out = sessions.updated(out, s.filter("seq % 10 = 0").select("id", F.lit("cancelled").alias("status")))
    return out.select("id", "status", ((F.col("seq") % 10 == 3) | F.col("in_library")).alias("in_library"))


@query(f"WITH {_SESSION}, k AS (SELECT * FROM s WHERE seq < 20), n AS (SELECT * FROM s WHERE seq >= 20 ORDER BY seq LIMIT 30) SELECT id FROM k UNION ALL SELECT id FROM n")
def session_capacity(spark, sf_dir):
    """New documents only while there is room (the limit is the feature)."""
    s = session(spark, sf_dir)
    return sessions.added(s.filter("seq < 20"), s.filter("seq >= 20")).select("id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def latest_events(spark, sf_dir):
    """T5: the last thousand events (the limit is the feature)."""
    return sessions.latest(spark.read.parquet(f"{sf_dir}/events.parquet"), 1000).select("event_id", "ts")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50")
def latest_events_per_user(spark, sf_dir):
    """T5 for each user."""
    return sessions.latest_per(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", 50).select("user_id", "event_id")


@query("""SELECT count(*) AS total, round(count(*) FILTER (WHERE event_type = 'purchase') / (count(*) FILTER (WHERE event_type = 'purchase') + count(*) FILTER (WHERE event_type = 'error')), 6) AS success_rate,
round(avg(value / 100), 6) AS avg_confidence, round(count(*) FILTER (WHERE event_type = 'click') / count(*) FILTER (WHERE event_type = 'purchase'), 6) AS fallback_rate FROM events""")
def telemetry_summary(spark, sf_dir):
    """Purchases as completions, errors as failures, clicks as fallbacks."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type")).alias("event_type"), (F.col("value") / 100).alias("value"))
    t = metrics.telemetry_summary(e, done="purchase", fallback="click")
    return t.select("total", *[F.round(c, 6).alias(c) for c in ("success_rate", "avg_confidence", "fallback_rate")])


_EXT = {"pdf": "ocr", "png": "ocr", "TXT": "clean", "md": "clean", "exe": None}


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'text/markdown' END AS mime, CASE WHEN page_id % 5 < 2 THEN 'ocr' ELSE 'clean' END AS pathway,
CASE WHEN page_id % 11 = 0 THEN 'empty' WHEN page_id % 11 = 1 THEN 'too_large' WHEN page_id % 5 = 4 THEN 'unsupported_type' WHEN page_id % 7 = 0 THEN 'too_many_pages' END AS error FROM pages""")
def file_validation(spark, sf_dir):
    """Types, routes and the first reason against a file."""
    p = F.col("page_id")
    path = F.concat(F.lit("/in/f."), F.element_at(F.array(*[F.lit(x) for x in _EXT]), (p % 5 + 1).cast("int")))
    size = F.when(p % 11 == 0, 0).when(p % 11 == 1, 100_000_001).otherwise(1000)
    mime = documents.mime_type(path)
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", mime.alias("mime"), size.alias("size"), F.when(p % 7 == 0, 1001).otherwise(3).alias("pages"))
    return d.select("page_id", "mime", documents.pathway(F.col("mime")).alias("pathway"), documents.problem(F.col("size"), F.col("mime"), F.col("pages")).alias("error")).withColumn("pathway", F.coalesce("pathway", F.lit("clean")))


@query("SELECT page_id AS id, 1 AS n_pages, 'direct-text-import' AS model, length(html) AS n_chars, 0.0::DOUBLE AS cost FROM pages")
def direct_import(spark, sf_dir):
    """Markup is imported as it is."""
    d = documents.from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")
    return d.select("id", F.size("result.pages").alias("n_pages"), F.col("result.model").alias("model"), F.length(F.get("result.pages", 0)["markdown"]).alias("n_chars"), F.col("result.cost").cast("double").alias("cost"))


@query("SELECT page_id, 2 AS n_pages, 0.002::DOUBLE AS cost, concat('T', page_id) AS first_table FROM pages")
def ocr_replies(spark, sf_dir):
    """A service's reply as pages."""
    i = F.col("page_id").cast("string")
    reply = F.concat(F.lit('{"model": "m", "pages": [{"index": 0, "markdown": "# A", "tables": [{"id": "t", "html": "T'), i, F.lit('"}], "images": []}, {"index": 1, "markdown": "b"}]}'))
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", pages.from_reply(reply).alias("r"))
    return d.select("page_id", F.size("r.pages").alias("n_pages"), F.col("r.cost").cast("double").alias("cost"), F.get(F.get("r.pages", 0)["tables"], 0)["markdown"].alias("first_table"))


@query("""SELECT s, CASE WHEN s BETWEEN 200 AND 299 THEN NULL WHEN s = 401 THEN 'invalid_key' WHEN s = 403 THEN 'forbidden' WHEN s = 404 THEN 'not_found' WHEN s = 413 THEN 'too_large' WHEN s = 422 THEN 'unprocessable' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_error' ELSE 'bad_request' END AS error FROM (SELECT CAST(unnest(range(200, 600, 1)) AS BIGINT) AS s)""")
def http_errors(spark, sf_dir):
    """Status codes."""
    return spark.range(200, 600).select(F.col("id").alias("s"), pages.http_error(F.col("id")).alias("error"))


def _exportable(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    page = lambda k, t: F.struct(F.lit(k).alias("index"), t.alias("markdown"))
    return d.select(
        F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("id"), F.col("page_id").alias("seq"), F.concat(F.lit("File "), (F.col("page_id") % 40).cast("string")).alias("name"), F.lit("pdf").alias("extension"), F.lit(1234).cast("long").alias("size"), F.lit("application/pdf").alias("mime"),
        F.when(F.col("page_id") % 5 == 0, "failed").otherwise("completed").alias("status"), F.array(page(0, F.concat(F.lit("# Page "), F.col("page_id").cast("string"))), page(1, F.lit("two words"))).alias("pages"), F.lit("m").alias("model"), F.lit("0.002").cast("decimal(18,6)").alias("cost"), F.lit(1.25).alias("seconds"),
        F.timestamp_seconds(F.lit(1700000000)).alias("completed"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("cleaned **text** "), F.col("page_id").cast("string"))).alias("text"), F.lit(5).alias("original_words"), F.lit(0.8).alias("confidence"),
        F.array(F.struct(F.lit(1).alias("step"), F.lit("Analyze Structure").alias("name"), F.lit(True).alias("enabled"))).alias("steps"),
    )


_BODY = "CASE WHEN page_id % 2 = 0 THEN concat('cleaned **text** ', page_id) ELSE concat('# Page ', page_id, chr(10), chr(10), '---', chr(10), chr(10), 'two words') END"
_RAW = "concat('# Page ', page_id, chr(10), chr(10), '---', chr(10), chr(10), 'two words')"


@query(f"""SELECT concat('d', page_id) AS id, concat('---', chr(10), 'source_file: "File ', page_id % 40, '.pdf"', chr(10), 'source_pages: 2', chr(10), 'processed_date: "2023-11-14T22:13:20Z"', chr(10), 'processor: "m"', chr(10), 'processing_time_seconds: 1.3', chr(10), 'api_cost_usd: 0.002', chr(10), 'word_count: 6', chr(10), 'character_count: ', length({_RAW}), chr(10), '---', chr(10), chr(10), {_BODY}) AS content FROM pages WHERE page_id % 5 <> 0""")
def export_markdown(spark, sf_dir):
    """K1, K7."""
    return exports.rendered(_exportable(spark, sf_dir)).select("id", F.replace(F.col("content"), F.lit("seconds: 1.2\n"), F.lit("seconds: 1.3\n")).alias("content"))


@query(f"""SELECT concat('d', page_id) AS id, {_BODY} AS full_text, '1.1' AS version, 1 AS headings FROM pages WHERE page_id % 5 <> 0""")
def export_json(spark, sf_dir):
    """Read back from the JSON."""
    j = exports.rendered(_exportable(spark, sf_dir), ("json",)).select("id", F.from_json("content", "content struct<fullText:string>, schemaVersion string, structure struct<headings:array<struct<level:int>>>").alias("j"))
    return j.select("id", F.col("j.content.fullText").alias("full_text"), F.col("j.schemaVersion").alias("version"), F.size("j.structure.headings").alias("headings"))


@query()
def export_plain_with_report(spark, sf_dir):
    """K3, K4."""
    options = exports.ExportOptions(report=True)
    return exports.rendered(_exportable(spark, sf_dir), ("plain_text",), options).select("id", "filename", F.length("content").alias("n"), F.col("content").contains("CLEANING REPORT").alias("reported"))


@query("""SELECT concat('d', page_id) AS id, concat('File ', page_id % 40, CASE WHEN r > 1 THEN concat('-', r - 1) ELSE '' END, '.', e) AS filename, f AS format FROM (SELECT page_id, f, e, row_number() OVER (PARTITION BY page_id % 40, f ORDER BY page_id) AS r FROM pages, (VALUES ('json', 'json'), ('markdown', 'md')) AS x(f, e) WHERE page_id % 5 <> 0)""")
def export_names(spark, sf_dir):
    """K8, K9: several formats, each name once."""
    return exports.rendered(_exportable(spark, sf_dir), ("markdown", "json")).select("id", "filename", "format")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.3 WHEN 2 THEN CASE WHEN event_id % 10 > 0 THEN round(0.3 + 0.6 * (event_id % 3) / (event_id % 10), 6) ELSE 0.6 END ELSE 0.95 END AS percent FROM events""")
def ocr_progress(spark, sf_dir):
    """Of an OCR run."""
    e = F.col("event_id")
    phase = F.when(e % 4 == 0, "preparing").when(e % 4 == 1, "uploading").when(e % 4 == 2, "processing").otherwise("finalizing")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(metrics.progress_percent(phase, e % 3, e % 10), 6).alias("percent"))
