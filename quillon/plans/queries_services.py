"""Queries on what surrounds the cleaning: regions, limits, kept patterns, retries, telemetry, typed replies, single operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations, estimates, fixed, markdown, metadata, replies
from ..functions.lines import intersection, overlaps
from ..operators import chunking, metrics, services, sessions, structure, validation
from ..operators.mining import line_view
from ..sources import documents, exports, pages
from .decorate import WITH, decorated
from .queries_lines import TRIM
from .queries_session import _SESSION, session

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_KINDS = ("titlePage", "index", "chapter", "glossary", "blockQuote", "abstract")
_KIND_SQL = f"([{_list(_KINDS)}])[CAST(event_id % 6 AS INT) + 1]"


@query(f"""WITH e AS (SELECT event_id, user_id, {_KIND_SQL} AS kind, event_id % 90 AS s, event_id % 90 + event_id % 7 AS e FROM events)
SELECT user_id, max(e) FILTER (WHERE kind IN ({_list(services.FRONT_REGIONS)})) AS front_end, min(s) FILTER (WHERE kind IN ({_list(services.BACK_REGIONS)})) AS back_start,
count(*) FILTER (WHERE kind IN ({_list(services.REMOVED_REGIONS)})) AS removed, count(*) FILTER (WHERE kind IN ({_list(services.CORE_REGIONS)})) AS core FROM e GROUP BY user_id""")
def region_bounds(spark, sf_dir):
    """The bounds that regions found before give, and their classes; a user's events stand for a document's regions."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (e % 6 + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select("user_id", kind.alias("type"), (e % 90).alias("start"), (e % 90 + e % 7).alias("end"))
    found = rows.groupBy("user_id").agg(F.collect_list(F.struct("type", "start", "end")).alias("r"), F.count_if(services.removed_by_default(F.col("type"))).alias("removed"), F.count_if(services.region_class(F.col("type")) == "core").alias("core"))
    return found.withColumn("b", services.region_bounds(F.col("r"))).select("user_id", "b.front_end", "b.back_start", "removed", "core")


_CONTENT = ("poetry", "drama", "legal", "academic", "technical", "childrens", "prose")


@query(f"""SELECT event_id, CASE k WHEN 'poetry' THEN '13,14' WHEN 'drama' THEN '13' WHEN 'legal' THEN '10,11' WHEN 'academic' THEN '10' WHEN 'technical' THEN '10' ELSE '' END AS off,
CASE k WHEN 'childrens' THEN 100 WHEN 'poetry' THEN 50 WHEN 'drama' THEN 50 WHEN 'legal' THEN 300 ELSE 250 END AS words FROM (SELECT event_id, ([{_list(_CONTENT)}])[CAST(event_id % 7 AS INT) + 1] AS k FROM events)""")
def content_limits(spark, sf_dir):
    """Q5, Q6: the steps that a kind of content rules out, and its longest paragraphs."""
    k = F.element_at(F.array(*map(F.lit, _CONTENT)), (F.col("event_id") % 7 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", F.array_join(services.disabled_steps(k).cast("array<string>"), ",").alias("off"), services.paragraph_words(k).alias("words"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), k AS (SELECT user_id, arg_max(event_type, ts) AS patterns FROM events, n WHERE epoch(now) - epoch(ts) <= 3600 GROUP BY user_id)
SELECT u.user_id, coalesce(k.patterns, 'detected') AS patterns, k.patterns IS NOT NULL AS from_cache FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k USING (user_id)""")
def pattern_cache(spark, sf_dir):
    """Q8: patterns kept for an hour; events stand for what was kept, the last one for now."""
    e = _table(spark, sf_dir, "events")
    docs = e.select("user_id").distinct()
    cache = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("patterns"), F.col("ts").alias("cached_at"), "event_id")
    cache = cache.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    return services.with_patterns(docs, cache, F.lit("detected"), F.col("now"), id_col="user_id", order="event_id")


@query(f"""WITH {_SESSION}, r AS (SELECT seq, id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status <> 'failed' THEN concat('e', seq) END AS error FROM s)
SELECT id, status, error FROM r WHERE status = 'pending'""")
def session_retry(spark, sf_dir):
    """Q9: failed documents are pending again and come up in the next batch."""
    s = session(spark, sf_dir).withColumn("error", F.concat(F.lit("e"), F.col("seq").cast("string")))
    return services.next_batch(services.retried(s)).select("id", "status", "error")


@query("""WITH d AS (SELECT event_id, ts, value, event_type = 'error' AS failed FROM events)
SELECT event_id AS doc_id, 'cleaningStarted' AS event_type, concat('wordCount=', event_id % 1000) AS data FROM d
UNION ALL SELECT event_id, CASE WHEN failed THEN 'cleaningFailed' ELSE 'cleaningCompleted' END, CASE WHEN failed THEN 'error=no text' ELSE concat('confidence=', printf('%.2f', (event_id % 64) / 4.0), ',duration=', printf('%.1f', (event_id % 16) / 2.0), ',usedFallback=', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END) END FROM d""")
def telemetry_events(spark, sf_dir):
    """Q10: the events that cleaning records."""
    e = F.col("event_id")
    d = _table(spark, sf_dir, "events").select(e.alias("doc_id"), F.col("ts"), F.when(F.col("event_type") != "error", "x").alias("text"), (e % 1000).alias("original_words"), ((e % 64) / 4.0).alias("confidence"))
    rows = services.events_of(d, F.col("ts"), seconds=(F.col("doc_id") % 16) / 2.0, fallback=F.col("doc_id") % 2 == 0)
    shown = F.array_join(F.transform(F.map_entries("data"), lambda m: F.concat(m["key"], F.lit("="), m["value"])), ",")
    return rows.select("doc_id", "event_type", shown.alias("data"))


_N = "event_id % 50"


@query(f"""SELECT event_id, {_N} AS b_start, {_N} + 5 AS b_end, 0.75 AS b_confidence, 2 AS n_lists, 'List of Maps' AS list_type, 'numbered' AS style, 3 AS cited, 'superscript' AS notes, {_N} + 1 AS notes_start, 'First' AS first_chapter, 'One' AS part, concat('T', event_id) AS title, NULL::VARCHAR AS broken FROM events""")
def typed_replies(spark, sf_dir):
    """Replies on boundaries, lists, citations, footnotes, chapters and metadata; numbers may come as text, entries without lines go."""
    n = (F.col("event_id") % 50).cast("string")
    said = lambda *parts: F.concat(F.lit("Sure:\n"), *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    d = _table(spark, sf_dir, "events").select(
        "event_id", replies.boundary(said('{"startLine": ', n, ', "endLine": ', (F.col("event_id") % 50 + 5).cast("string"), ', "confidence": "0.75", "notes": "x"}')).alias("b"),
        replies.lists(said('{"lists": [{"type": "List of Maps", "startLine": 1, "endLine": 9}, {"type": "gone", "startLine": 3}, {"type": "List of Tables", "startLine": 12, "endLine": ', n, "}]}")).alias("l"),
        replies.citation_style(said('{"style": "numbered", "count": 3, "samples": ["[1]"]}')).alias("c"), replies.footnote_style(said('{"markerStyle": "superscript", "sections": [{"startLine": ', (F.col("event_id") % 50 + 1).cast("string"), ', "endLine": 99}]}')).alias("f"),
        replies.chapter_list(said('{"chapters": [{"line": 9, "title": "Second"}, {"line": 2, "title": "First"}], "parts": [{"line": 1, "title": "One"}]}')).alias("h"),
        replies.metadata(said('{"title": "T', F.col("event_id").cast("string"), '", "author": "A"}')).alias("m"), replies.boundary(F.lit("no reply")).alias("none"),
    )
    return d.select(
        "event_id", F.col("b.start").cast("long").alias("b_start"), F.col("b.end").cast("long").alias("b_end"), F.col("b.confidence").alias("b_confidence"), F.size("l").alias("n_lists"), F.get("l", 0)["type"].alias("list_type"), "c.style", F.col("c.count").alias("cited"),
        F.col("f.style").alias("notes"), F.get("f.sections", 0)["start"].cast("long").alias("notes_start"), F.get("h.chapters", 0)["title"].alias("first_chapter"), F.get("h.parts", 0)["title"].alias("part"), "m.title", F.col("none.notes").alias("broken"),
    )


@query(r"""SELECT conv_id, count(*) AS pages, CAST(sum(len(regexp_extract_all(text, '[^\s\x{85}\p{Z}]+'))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, bool_or(turn % 3 = 1) AS has_tables, bool_or(turn % 4 = 2) AS has_images, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def page_rollups(spark, sf_dir):
    """Pages rolled up to documents; a conversation's turns stand for pages."""
    t = F.col("turn")
    page = F.struct(t.alias("index"), F.col("text").alias("markdown"), F.when(t % 3 == 1, F.array(t)).otherwise(F.array().cast("array<long>")).alias("tables"), F.when(t % 4 == 2, F.array(t)).otherwise(F.array().cast("array<long>")).alias("images"))
    d = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(page)).alias("p")).select("conv_id", metrics.page_totals(F.col("p")).alias("r"))
    return d.select("conv_id", F.col("r.pages").cast("long").alias("pages"), F.col("r.words").cast("long").alias("words"), F.col("r.chars").cast("long").alias("chars"), "r.has_tables", "r.has_images", F.md5(F.encode("r.text", "UTF-8")).alias("digest"))


_C = "CASE WHEN (event_id + {0}) % 3 = 0 THEN NULL ELSE ((event_id * {0}) % 128) / 128.0 END"


@query(f"""WITH c AS (SELECT event_id, {", ".join(f"{_C.format(k)} AS c{k}" for k in range(3, 9))} FROM events)
SELECT event_id, list_avg(list_filter([c3, c4, c5, c6, c7, c8], lambda x: x IS NOT NULL)) AS structure, list_avg(list_filter([c7, c8], lambda x: x IS NOT NULL)) AS back, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS fallbacks FROM c""")
def phase_confidences(spark, sf_dir):
    """The mean of the known confidences of a phase's steps, and how often a model was replaced."""
    e = F.col("event_id")
    of = lambda k: F.when((e + k) % 3 != 0, ((e * k) % 128) / 128.0)
    steps = F.map_from_arrays(F.array(*[F.lit(k) for k in range(3, 9)]), F.array(*[of(k) for k in range(3, 9)]))
    by_model = F.when(e % 3 == 0, False).when(e % 3 == 1, True).otherwise(None)
    other = F.when(e % 3 == 2, True).otherwise(False)
    return _table(spark, sf_dir, "events").select("event_id", metrics.phase_confidence(steps, 3).alias("structure"), metrics.phase_confidence(steps, 6).alias("back"), metrics.fallbacks(by_model, other).alias("fallbacks"))


@query("""SELECT event_id, CASE WHEN event_id % 9 > 0 THEN round((event_id % 100) / (event_id % 9) * (event_id % 5) * CASE WHEN event_id % 7 > 0 THEN (event_id % 40) // (event_id % 7) ELSE 0 END, 6) END AS seconds FROM events""")
def batch_estimate(spark, sf_dir):
    """What a batch still takes, from the time a page took and the whole mean of pages a document."""
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select("event_id", F.round(estimates.remaining_seconds(e % 100, e % 9, e % 5, e % 40, e % 7), 6).alias("seconds"))


@query("""SELECT page_id, url, md5(coalesce(url, '')) AS as_utf16, true AS kept FROM pages WHERE url IS NOT NULL""")
def decoded_text(spark, sf_dir):
    """Text of bytes in UTF-8 and, with its mark, UTF-16; both give the same text."""
    d = _table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", F.encode("url", "UTF-8").alias("u8"), F.encode("url", "UTF-16").alias("u16"))
    return d.select("page_id", documents.decoded(F.col("u8")).alias("url"), F.md5(F.encode(documents.decoded(F.col("u16")), "UTF-8")).alias("as_utf16"), (documents.decoded(F.col("u8")) == documents.decoded(F.col("u16"))).alias("kept"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 'encrypted' ELSE 'corrupted' END AS error, CAST(CASE WHEN page_id % 2 = 0 THEN greatest(page_id % 5, 1) ELSE page_id % 9 + 1 END AS INT) AS pages FROM pages""")
def pdf_checks(spark, sf_dir):
    """Page counts of PDFs by their page objects or the count of their tree, and what is wrong with a file."""
    p = F.col("page_id")
    objects = F.when(p % 2 == 0, F.array_join(F.array_repeat(F.lit("<< /Type /Page /Parent 1 0 R >>\n"), (p % 5).cast("int")), "")).otherwise(F.concat(F.lit("<< /Type /Pages /Count "), (p % 9 + 1).cast("string"), F.lit(" >>\n")))
    end = F.when(p % 3 == 0, "trailer\n%%EOF").when(p % 3 == 1, "trailer << /Encrypt 9 0 R >>\n%%EOF").otherwise("cut off")
    d = _table(spark, sf_dir, "pages").select("page_id", F.encode(F.concat(F.lit("%PDF-1.7\n"), objects, end), "UTF-8").alias("c"))
    return d.select("page_id", documents.pdf_problem(F.col("c")).alias("error"), documents.pdf_pages(F.col("c")).alias("pages"))


_PATHS = ("a.pdf", "b.PNG", "c.exe", "d.txt", "noext", "e.md")


@query(f"""SELECT page_id, path, page_id % 4 <> 0 AS valid, CASE WHEN page_id % 4 = 0 THEN 'empty' END AS reason FROM (SELECT page_id, ([{_list(_PATHS)}])[CAST(page_id % 6 AS INT) + 1] AS path FROM pages) WHERE path NOT IN ('c.exe', 'noext')""")
def supported_files(spark, sf_dir):
    """Files of supported types, and whether each is valid."""
    p = F.col("page_id")
    d = _table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, _PATHS)), (p % 6 + 1).cast("int")).alias("path"), F.when(p % 4 == 0, 0).otherwise(10).alias("size"))
    d = documents.supported(d)
    files = d.withColumn("error", documents.problem(F.col("size"), documents.mime_type(F.col("path")), F.lit(1)))
    return documents.validated(files.withColumn("path", F.concat_ws("|", F.col("page_id").cast("string"), "path"))).select(F.split("path", r"\|")[0].cast("long").alias("page_id"), F.split("path", r"\|")[1].alias("path"), "validation.valid", "validation.reason")


@query(f"""WITH {_SESSION}, a AS (SELECT id, name FROM s WHERE id = 'd7' ORDER BY seq LIMIT 1), b AS (SELECT id, name FROM s ORDER BY seq LIMIT 3) SELECT 'by_id' AS how, * FROM a UNION ALL SELECT 'slots', * FROM b""")
def session_lookups(spark, sf_dir):
    """One document by its id, and as many as there are slots (the limits are the feature)."""
    s = session(spark, sf_dir)
    return sessions.by_id(s, "d7").select(F.lit("by_id").alias("how"), "id", "name").unionByName(documents.take_slots(s, 3).select(F.lit("slots").alias("how"), "id", "name"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(t, '\A---\ntitle: T\n---\n', ''), chr(32) || chr(9) || chr(10))) AS digest FROM (SELECT doc_id, concat('---', chr(10), 'title: T', chr(10), '---', chr(10), regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x21-\x7E\n]|[-*_\[\]#<>()`]', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS t FROM documents)""")
def cleaned_plain(spark, sf_dir):
    """A cleaned document without its metadata block, end marker and emphasis."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x21-\x7E\n]|[-*_\[\]#<>()`]", " "), r"\s+", " "), "^ | $", "")
    marked = F.concat(F.lit("---\ntitle: T\n---\n"), text, F.lit("\n\n*** <!-- END OF T -->"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(markdown.cleaned_plain(marked), "UTF-8")).alias("digest"))


def _escaped(words) -> str:
    return "|".join(words).replace("'", "''")


@query(f"""SELECT conv_id, turn, regexp_matches(t, '{_escaped(fixed.MATH_SIGNS)}') AS math, regexp_matches(t, '```|{_escaped(fixed.CODE_WORDS)}') AS code FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat(text, ' x² ') WHEN 1 THEN concat('let ', text) ELSE text END AS t FROM conversations)""")
def math_and_code(spark, sf_dir):
    """X21."""
    t = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" x² "))).when(F.col("turn") % 4 == 1, F.concat(F.lit("let "), "text")).otherwise(F.col("text"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", structure.has_math(t).alias("math"), structure.has_code(t).alias("code"))


_ENDS = {
    "none": "''", "minimal": "'***'", "simple": "'[END]'", "standard": "concat('*** <!-- END OF ', upper(t), ' -->')", "html_comment": "concat('<!-- END OF DOCUMENT: ', t, ' -->')", "markdown_hr": "'---'", "token": "'<END_DOCUMENT>'",
    "token_with_author": "CASE WHEN a <> '' THEN concat('<END_DOCUMENT author=\"', a, '\">') ELSE '<END_DOCUMENT>' END",
}
_MARKS = {
    "none": ("''", "''"), "html_comments": ("concat('<!-- CHAPTER: ', t, ' -->')", "concat('<!-- PART: ', a, ' | CHAPTER: ', t, ' -->')"), "markdown_h1": ("concat('# ', t)", "concat('# ', a, chr(10), chr(10), '## ', t)"),
    "markdown_h2": ("concat('## ', t)", "concat('## ', a, chr(10), chr(10), '### ', t)"), "token": ("concat('<CHAPTER>', t, '</CHAPTER>')", "concat('<PART>', a, '</PART>', chr(10), '<CHAPTER>', t, '</CHAPTER>')"),
}


@query(f"""WITH x AS (SELECT page_id, concat('Title ', page_id) AS t, CASE WHEN page_id % 2 = 0 THEN concat('W', page_id) ELSE '' END AS a FROM pages)
SELECT page_id, concat_ws('|', {", ".join(_ENDS.values())}) AS ends, concat_ws('|', {", ".join(f"CASE WHEN a = '' THEN {one} ELSE {both} END" for one, both in _MARKS.values())}) AS marks FROM x""")
def marker_styles(spark, sf_dir):
    """All styles of end and chapter markers, with an author or part where there is one."""
    p = F.col("page_id")
    title, author = F.concat(F.lit("Title "), p.cast("string")), F.when(p % 2 == 0, F.concat(F.lit("W"), p.cast("string"))).otherwise("")
    ends = F.concat_ws("|", *[structure.end_marker(s, title, author) for s in structure.END_STYLES])
    marks = F.concat_ws("|", *[structure.chapter_marker(s, title, F.nullif(author, F.lit(""))) for s in structure.CHAPTER_STYLES])
    return _table(spark, sf_dir, "pages").select("page_id", ends.alias("ends"), marks.alias("marks"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS a, regexp_replace(concat(text, chr(10), 'one more'), '[^\x00-\x7F]', '?', 'g') AS b FROM conversations)
SELECT conv_id, turn, 2 AS word_delta, 1 AS line_delta, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity, 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.95 AS passes FROM t""")
def text_comparison(spark, sf_dir):
    """Q13: whole turns compared with the same and one more line (ASCII, as DuckDB's distance counts bytes)."""
    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7F]", "?")
    a, b = ascii_(F.col("text")), ascii_(F.concat("text", F.lit("\none more")))
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.compare_texts(a, b).alias("c"))
    return d.select("conv_id", "turn", "c.word_delta", "c.line_delta", F.round("c.similarity", 6).alias("similarity"), "c.passes")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0.0 ELSE round((2 + CASE WHEN event_id % 4 = 1 THEN (event_id % 10) / 10.0 ELSE 0 END) / CASE WHEN event_id % 4 = 0 THEN 3 ELSE 4 END, 6) END AS share FROM events""")
def cleaning_progress(spark, sf_dir):
    """The share of enabled steps that are over, with the running one's chunks."""
    e = F.col("event_id")
    last = F.when(e % 4 == 0, "skipped").when(e % 4 == 1, "running").otherwise("pending")
    statuses = F.when(e % 4 == 3, F.array(F.lit("skipped"))).otherwise(F.array(F.lit("completed"), F.lit("failed"), F.lit("pending"), last))
    return _table(spark, sf_dir, "events").select("event_id", F.round(metrics.cleaning_progress(statuses, e % 10, F.lit(10)), 6).alias("share"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN concat('T', page_id) ELSE 'Old' END AS title, CASE WHEN page_id % 2 = 0 THEN concat('A', page_id) ELSE 'B' END AS author, left(concat('body ', coalesce(url, '')), 12) AS head FROM pages""")
def metadata_merge(spark, sf_dir):
    """Fields that are known better replace others; the beginning of a text."""
    p = F.col("page_id")
    old = metadata.blank(F.lit("Old"), F.lit("B"))
    new = metadata.blank(F.when(p % 3 == 0, F.concat(F.lit("T"), p.cast("string"))).otherwise(""), F.when(p % 2 == 0, F.concat(F.lit("A"), p.cast("string"))))
    d = _table(spark, sf_dir, "pages").select("page_id", metadata.merged(old, new).alias("m"), exports.preview(F.concat(F.lit("body "), F.coalesce("url", F.lit(""))), 12).alias("head"))
    return d.select("page_id", "m.title", "m.author", "head")


_SECTIONS = ("auxiliaryLists", "backMatter", "index", "frontMatter", "tableOfContents", "footnotesEndnotes", "other")


def _reason_sql() -> str:
    """The rules of place in SQL: section k, start s, end e, confidence c, n lines."""
    branches = []
    for name in _SECTIONS:
        r = validation.LIMITS[name]
        missing = {"end": "e IS NULL", "start": "s IS NULL", "both": "s IS NULL OR e IS NULL", "any": "s IS NULL AND e IS NULL"}[r["needs"]]
        branches.append((name, missing))
    return " ".join(f"WHEN k = '{name}' AND ({missing}) THEN 'no_boundary'" for name, missing in branches)


@query(f"""SELECT section, reason, count(*) AS n FROM (SELECT k AS section, CASE {_reason_sql()} ELSE 'judged' END AS reason FROM (SELECT ([{_list(_SECTIONS)}])[CAST(event_id % 7 AS INT) + 1] AS k, CASE WHEN event_id % 5 > 0 THEN event_id % 600 END AS s, CASE WHEN event_id % 4 > 0 THEN event_id % 600 + event_id % 40 END AS e FROM events)) GROUP BY 1, 2""")
def proposals_judged(spark, sf_dir):
    """Proposed boundaries of all kinds, those without lines told from those judged (whose reasons `boundary_validation` states)."""
    e = F.col("event_id")
    k = F.element_at(F.array(*map(F.lit, _SECTIONS)), (e % 7 + 1).cast("int"))
    d = _table(spark, sf_dir, "events").select(k.alias("section"), F.when(e % 5 > 0, e % 600).alias("s"), F.when(e % 4 > 0, e % 600 + e % 40).alias("e"))
    d = d.withColumn("r", validation.boundary_reason(F.col("section"), F.col("s"), F.col("e"), F.lit(0.9), F.lit(500)))
    return d.groupBy("section", F.when(F.col("r") == "no_boundary", "no_boundary").otherwise("judged").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT a.event_id, a.s <= b.e AND b.s <= a.e AS overlap, CASE WHEN a.s <= b.e AND b.s <= a.e THEN greatest(a.s, b.s) END AS start_line, CASE WHEN a.s <= b.e AND b.s <= a.e THEN least(a.e, b.e) END AS end_line
FROM (SELECT event_id, event_id % 31 AS s, event_id % 31 + event_id % 8 AS e FROM events) a JOIN (SELECT event_id, event_id % 17 AS s, event_id % 17 + event_id % 5 AS e FROM events) b USING (event_id)""")
def ranges_of_events(spark, sf_dir):
    """Overlaps and intersections of ranges."""
    e = F.col("event_id")
    c = (e % 31, e % 31 + e % 8, e % 17, e % 17 + e % 5)
    return _table(spark, sf_dir, "events").select("event_id", overlaps(*c).alias("overlap"), intersection(*c).alias("x")).select("event_id", "overlap", F.col("x.start").alias("start_line"), F.col("x.end").alias("end_line"))


@query("""SELECT event_id, round(list_sum(l) / greatest(len(l), 1), 6) AS overall FROM (SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 0.5 END, CASE WHEN event_id % 3 = 0 THEN 0.75 END, CASE WHEN event_id % 5 = 0 THEN 0.25 END, (event_id % 8) / 8.0], lambda x: x IS NOT NULL) AS l FROM events)""")
def confidence_of_events(spark, sf_dir):
    """The mean of all that is known."""
    e = F.col("event_id")
    of = metrics.overall_confidence(F.when(e % 2 == 0, 0.5), F.when(e % 3 == 0, 0.75), [F.when(e % 5 == 0, 0.25)], (e % 8) / 8.0)
    return _table(spark, sf_dir, "events").select("event_id", F.round(of, 6).alias("overall"))


@query("""SELECT page_id, concat('{"document":{"type":"', CASE WHEN page_id % 2 = 0 THEN 'image_url","image_url":"' ELSE 'document_url","document_url":"' END, CASE WHEN page_id % 2 = 0 THEN concat('data:image/png;base64,', to_base64(encode('x' || page_id))) ELSE concat('https://files/', page_id) END, '"},"include_image_base64":false,"model":"ocr-latest","table_format":"markdown"}') AS payload FROM pages""")
def ocr_requests(spark, sf_dir):
    """Payloads that ask for pages, PDFs by address and images as data."""
    p = F.col("page_id")
    kind = F.when(p % 2 == 0, "image/png").otherwise("application/pdf")
    address = F.when(p % 2 == 0, pages.data_url(kind, F.encode(F.concat(F.lit("x"), p.cast("string")), "UTF-8"))).otherwise(F.concat(F.lit("https://files/"), p.cast("string")))
    return _table(spark, sf_dir, "pages").select("page_id", pages.request(kind, address).alias("payload"))


_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .,;]', ' ', 'g'), ' +', ' ', 'g'))"


def _plain_turn():
    return F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 .,;]", " "), " +", " "))


@query(f"""SELECT conv_id, turn, concat(t, ' x y a b') AS text, 2 AS n FROM (SELECT conv_id, turn, {_CLEAN} AS t FROM conversations)""")
def markers_of_turns(spark, sf_dir):
    """Bracketed and raised footnote markers removed from turns, and counted."""
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", citations.remove_footnote_markers(F.concat(_plain_turn(), F.lit(" x[12] y a^(3) b"))).alias("r"))
    return d.select("conv_id", "turn", "r.text", "r.n")


@query(f"""SELECT conv_id, turn, concat(t, ' as said, and both too . Value 3.14 ends') AS text FROM (SELECT conv_id, turn, regexp_replace(regexp_replace({_CLEAN}, '[,;]', '', 'g'), ' +', ' ', 'g') AS t FROM conversations)""")
def citations_of_turns(spark, sf_dir):
    """Citations removed from turns, numbers left alone, what citations leave behind cleared."""
    t = F.regexp_replace(F.regexp_replace(_plain_turn(), "[,;]", ""), " +", " ")
    cited = F.concat(t, F.lit(" as said (Smith, 2020), and both (Smith, 2018; Jones, 2019) too (ibid., p. 5). Value 3.14 (Jones & Smith, 2019, pp. 3-4) ends"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", citations.remove_citations(cited)["text"].alias("text"))


@query(rf"""WITH {WITH}, v AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line_no, {TRIM.format('unnest(lines)')} AS t FROM decorated)
SELECT doc_id, count(*) AS n, min(line_no) AS first_line FROM v WHERE length(t) > 20 AND regexp_matches(t, '^[A-Z][a-zA-Z''\-]+,\s+[A-Z]') AND (regexp_matches(t, '\(\d{{4}}\)\s*\.') OR regexp_matches(t, '\d{{4}}\s*[.,]?\s*$')
OR {" OR ".join(f"contains(t, '{w}')" for w in fixed.BIBLIOGRAPHY_WORDS)} OR (contains(t, '_') AND contains(t, '.')) OR length(t) - length(replace(t, '.', '')) >= 3) GROUP BY doc_id""")
def bibliographies(spark, sf_dir):
    """The lines of documents that are entries of a bibliography."""
    v = line_view(decorated(spark, sf_dir)).filter(citations.is_bibliography(F.col("line")))
    return v.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").cast("long").alias("first_line"))


@query(f"""SELECT conv_id, turn, concat('Title ', t, ' bold and slanted, link see !alt code end') AS plain, len(list_filter(regexp_split_to_array(concat('Title ', t, ' bold and slanted, link see !alt code end'), ' +'), lambda w: w <> '')) AS words FROM (SELECT conv_id, turn, {_CLEAN} AS t FROM conversations)""")
def markdown_of_turns(spark, sf_dir):
    """Turns in Markdown as plain text, and their words."""
    t = F.concat(F.lit("## Title "), _plain_turn(), F.lit(" **bold** and *slanted*, [link](http://a.b) __see__ ![alt](i.png) `code` end"))
    d = _table(spark, sf_dir, "conversations").withColumn("t", t)
    return d.select("conv_id", "turn", markdown.to_plain(F.col("t")).alias("plain"), markdown.count_semantic_words(F.col("t")).cast("long").alias("words"))


@query("""SELECT event_id, event_id % 6 + 1 AS n_rows, event_id % 4 + 1 AS n_columns FROM events""")
def tables_of_events(spark, sf_dir):
    """Rows and columns of tables of all sizes."""
    e = F.col("event_id")
    cells = lambda what, n: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(what), n.cast("int")), " | "), F.lit(" |"))
    t = F.concat_ws("\n", F.concat(F.lit("  "), cells("head", e % 4 + 1)), cells("---", e % 4 + 1), F.array_join(F.array_repeat(cells("x", e % 4 + 1), (e % 6).cast("int")), "\n"))
    return _table(spark, sf_dir, "events").select("event_id", markdown.table_rows(t).cast("long").alias("n_rows"), markdown.table_columns(t).cast("long").alias("n_columns"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) ELSE printf('%dm %ds', CAST(floor(s / 60) AS INT), CAST(floor(s) AS INT) % 60) END AS duration,
CASE WHEN b < 1000 THEN printf('%.0f bytes', b) WHEN b < 1000000 THEN printf('%.0f KB', b / 1000) WHEN b < 1000000000 THEN printf('%.1f MB', b / 1000000) ELSE printf('%.2f GB', b / 1000000000) END AS size, concat('$', printf('%.2f', c)) AS cost
FROM (SELECT event_id, (event_id % 500) / 2.0 AS s, CAST(event_id % 7 AS DOUBLE) * 128 * power(10, event_id % 9) AS b, (event_id % 900) / 4.0 + 1 AS c FROM events)""")
def numbers_of_events(spark, sf_dir):
    """Durations, sizes and costs as they are shown."""
    e = F.col("event_id")
    size = (e % 7).cast("double") * 128 * F.pow(F.lit(10.0), e % 9)
    return _table(spark, sf_dir, "events").select("event_id", estimates.shown_duration((e % 500) / 2.0).alias("duration"), estimates.shown_bytes(size).alias("size"), estimates.shown_cost(((e % 900) / 4.0 + 1).cast("decimal(18,6)")).alias("cost"))


@query("""WITH v AS (SELECT event_id % 3 <> 0 AS valid, event_type AS reason, concat('s', user_id % 4) AS section FROM events)
SELECT 'all' AS by, '' AS key, count(*) AS n, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM v
UNION ALL SELECT 'reason', reason, count(*), NULL FROM v WHERE NOT valid GROUP BY reason UNION ALL SELECT 'section', section, count(*), NULL FROM v WHERE NOT valid GROUP BY section""")
def totals_of_checks(spark, sf_dir):
    """What passed the checks, and failures by reason and by section."""
    v = _table(spark, sf_dir, "events").select((F.col("event_id") % 3 != 0).alias("valid"), F.col("event_type").alias("reason"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("section"))
    none = F.lit(None).cast("double")
    entries = lambda by, name: F.transform(F.map_entries(name), lambda m: F.struct(F.lit(by).alias("by"), m["key"].alias("key"), m["value"].alias("n"), none.alias("pass_rate")))
    head = F.array(F.struct(F.lit("all").alias("by"), F.lit("").alias("key"), F.col("total").alias("n"), F.round("pass_rate", 6).alias("pass_rate")))
    return metrics.totals_by(v).select(F.explode(F.concat(head, entries("reason", "by_reason"), entries("section", "by_section"))).alias("r")).select("r.*")


@query("""SELECT page_id, concat('# TITLE ', page_id, ' (W)', chr(10), chr(10), '---', chr(10), 'title: Title ', page_id, chr(10), 'author: W', chr(10), '---', chr(10), chr(10), 'body ', page_id, chr(10), chr(10), '*** <!-- END OF TITLE ', page_id, ' -->', chr(10)) AS text FROM pages""")
def assembled_simply(spark, sf_dir):
    """The simple form."""
    n = F.col("page_id").cast("string")
    return _table(spark, sf_dir, "pages").select("page_id", structure.assemble_simple(F.concat(F.lit(" body "), n, F.lit(" \n")), metadata.blank(F.concat(F.lit("Title "), n), F.lit("W"))).alias("text"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 4 * 2 + 7 + length(CAST(page_id AS VARCHAR)) WHEN 1 THEN 8 + length(CAST(page_id AS VARCHAR)) + 1 + 9 ELSE 0 END AS metadata_length FROM pages""")
def metadata_lengths(spark, sf_dir):
    """How long a metadata block at the beginning of a text is."""
    n = F.col("page_id").cast("string")
    t = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("---\ntitle: "), n, F.lit("\n---\nbody"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("# Title "), n, F.lit("\nauthor: A\nbody text"))).otherwise("plain\ntext")
    return _table(spark, sf_dir, "pages").select("page_id", structure.existing_metadata(t).cast("long").alias("metadata_length"))


@query("""SELECT user_id, CAST(count(*) AS INT) AS pages, md5(string_agg(concat(event_type, event_id % 10), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY user_id""")
def pages_of_events(spark, sf_dir):
    """Texts split into pages and joined again."""
    d = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat("event_type", (F.col("event_id") % 10).cast("string")).alias("t")))).alias("a"))
    text = F.array_join(F.transform("a", lambda x: x["t"]), "\n\n---\n\n")
    d = d.select("user_id", chunking.split_pages(text).alias("p"))
    return d.select("user_id", F.size("p").alias("pages"), F.md5(F.encode(chunking.join_pages(F.col("p")), "UTF-8")).alias("digest"))
