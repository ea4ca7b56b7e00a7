"""Queries on lines: removal, counts, runs, chunks, running headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.estimates import reduction, tokens
from ..functions.lines import count_changes, count_chars, count_lines, count_words, excerpt, join_lines, sample_thirds, split_lines, trim
from ..functions.segments import code_ranges, in_any, table_blocks
from ..operators import chunking, metrics, mining, removal
from .decorate import WITH, decorated

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A line as DuckDB sees it trimmed, and words of a text.
TRIM = r"regexp_replace({0}, '^[\p{{Zs}}\t]+|[\p{{Zs}}\t]+$', '', 'g')"
WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _page_rule() -> str:
    return "(?i)^(?:" + "|".join(f"(?:{p})" for p in fixed.PAGE_NUMBERS) + ")$"


_DROPPED = f"list_filter(lines, lambda x: NOT ({TRIM.format('x')} <> '' AND regexp_matches({TRIM.format('x')}, '{_page_rule()}')))"


@query(f"""WITH {WITH}, cleaned AS (SELECT lang, lines, {_DROPPED} AS kept FROM decorated),
counted AS (SELECT lang, len(lines) - len(kept) AS gone, {WORDS.format("array_to_string(lines, chr(10))")} AS before, {WORDS.format("array_to_string(kept, chr(10))")} AS after FROM cleaned)
SELECT lang, count(*) AS docs, CAST(sum(gone) AS BIGINT) AS lines_removed, CAST(sum(before) AS BIGINT) AS words_before, CAST(sum(after) AS BIGINT) AS words_after,
round(100.0 * (sum(before) - sum(after)) / sum(before), 6) AS reduction_pct FROM counted GROUP BY lang""")
def clean_page_numbers_by_lang(spark, sf_dir):
    """Page-number lines removed from decorated documents, by language."""
    rows = decorated(spark, sf_dir).withColumn("kept", removal.drop_matching(F.col("lines")))
    rows = rows.select("lang", (F.size("lines") - F.size("kept")).alias("gone"), count_words(join_lines(F.col("lines"))).alias("before"), count_words(join_lines(F.col("kept"))).alias("after"))
    out = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("gone").alias("lines_removed"), F.sum("before").alias("words_before"), F.sum("after").alias("words_after"))
    return out.withColumn("reduction_pct", F.round(reduction(F.col("words_before"), F.col("words_after")), 6))


@query(rf"""SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, {WORDS.format('text')} AS n_words, length(text) AS n_chars,
CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(floor((length(text) / 4.0 + {WORDS.format('text')} * 1.3) / 2.0 + 0.5) AS INT)) END AS n_tokens FROM documents""")
def line_counts(spark, sf_dir):
    """Lines, words, characters and estimated tokens."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = F.col("text")
    return d.select("doc_id", count_lines(t).alias("n_lines"), count_words(t).alias("n_words"), count_chars(t).alias("n_chars"), tokens(t).alias("n_tokens"))


@query(rf"""SELECT doc_id, len(l) AS lines, CAST(list_sum(list_transform(l, lambda x: {WORDS.format('x')})) AS INT) AS words, length(text) AS chars,
round(list_sum(list_transform(l, lambda x: {WORDS.format('x')})) / len(l), 6) AS words_per_line, round(length(text) / len(l), 6) AS chars_per_line
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def document_metrics(spark, sf_dir):
    """G4."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", metrics.document_metrics(split_lines(F.col("text"))).alias("m"))
    return d.select("doc_id", "m.lines", "m.words", "m.chars", F.round("m.words_per_line", 6).alias("words_per_line"), F.round("m.chars_per_line", 6).alias("chars_per_line"))


@query(f"""WITH {WITH}, k AS (SELECT doc_id, lines, {_DROPPED} AS kept FROM decorated)
SELECT doc_id, len(list_distinct(list_filter(lines, lambda x: NOT list_contains(kept, x)))) + len(list_distinct(list_filter(kept, lambda x: NOT list_contains(lines, x)))) AS changes FROM k""")
def change_counts(spark, sf_dir):
    """Distinct lines that only one of two versions has."""
    d = decorated(spark, sf_dir)
    return d.select("doc_id", count_changes(join_lines(F.col("lines")), join_lines(removal.drop_matching(F.col("lines")))).alias("changes"))


@query(f"""WITH {WITH} SELECT doc_id, md5(array_to_string(list_concat(lines[1:5], lines[13:]), chr(10))) AS digest, len(lines) - 7 AS n FROM decorated""")
def remove_range(spark, sf_dir):
    """Lines 5 to 11 removed."""
    d = decorated(spark, sf_dir).withColumn("kept", removal.remove_range(F.col("lines"), F.lit(5), F.lit(11)))
    return d.select("doc_id", F.md5(F.encode(join_lines(F.col("kept")), "UTF-8")).alias("digest"), F.size("kept").alias("n"))


@query(f"""WITH {WITH} SELECT doc_id, md5(array_to_string(list_concat(list_concat(lines[1:5], lines[9:10]), lines[21:]), chr(10))) AS digest FROM decorated""")
def remove_range_except(spark, sf_dir):
    """Lines 5 to 19 removed but for 8 to 9."""
    zone = F.array(F.struct(F.lit(8).alias("start"), F.lit(9).alias("end")))
    kept = removal.remove_range_except(F.col("lines"), F.lit(5), F.lit(19), zone)
    return decorated(spark, sf_dir).select("doc_id", F.md5(F.encode(join_lines(kept), "UTF-8")).alias("digest"))


@query(f"""WITH {WITH} SELECT doc_id, len(list_filter(lines, lambda x: {TRIM.format('x')} IN ('THE GREAT BOOK', 'xvii'))) AS gone FROM decorated""")
def remove_exact_lines(spark, sf_dir):
    """P4."""
    kept = removal.drop_exact(F.col("lines"), F.array(F.lit(" THE GREAT BOOK"), F.lit("xvii")))
    return decorated(spark, sf_dir).select("doc_id", (F.size("lines") - F.size(kept)).alias("gone"))


_RANGES = [(2, 4), (10, 12), (-1, 3), (100000, 100001), (20, 19)]


@query(f"""WITH {WITH} SELECT doc_id, 6 AS removed, 2 AS accepted, 'negative_start,beyond_end,end_before_start' AS reasons, len(lines) - 6 AS n_left FROM decorated""")
def remove_ranges_report(spark, sf_dir):
    """Good ranges removed, bad ones named."""
    ranges = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in _RANGES])
    d = decorated(spark, sf_dir).select("doc_id", removal.remove_ranges_report(F.col("lines"), ranges).alias("r"))
    return d.select("doc_id", "r.removed", F.size("r.accepted").alias("accepted"), F.array_join(F.transform("r.rejected", lambda x: x["reason"]), ",").alias("reasons"), F.size("r.lines").alias("n_left"))


@query(f"""WITH {WITH} SELECT doc_id, md5(array_to_string(lines[1:10], chr(10))) AS first_ten, left(array_to_string(lines, chr(10)), 100) AS head FROM decorated""")
def first_lines_and_chars(spark, sf_dir):
    """P7, K11."""
    from ..functions.lines import first_chars, first_lines

    t = join_lines(F.col("lines"))
    return decorated(spark, sf_dir).select("doc_id", F.md5(F.encode(first_lines(t, 10), "UTF-8")).alias("first_ten"), first_chars(t, 100).alias("head"))


@query(f"""WITH {WITH}, v AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM decorated),
s AS (SELECT doc_id, i, length(x) + 1 AS n, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM v)
SELECT doc_id, CAST(coalesce(sum(n) FILTER (WHERE upto <= 400), 0) AS INT) AS chars FROM s GROUP BY doc_id""")
def token_excerpt(spark, sf_dir):
    """Whole lines while they fit 100 tokens."""
    return decorated(spark, sf_dir).select("doc_id", F.length(excerpt(F.col("lines"), 0, 100)).alias("chars"))


@query(f"""WITH {WITH}, s AS (SELECT doc_id, array_to_string(lines, chr(10)) AS t, lines FROM decorated)
SELECT doc_id, md5(CASE WHEN length(t) <= 900 THEN t ELSE concat(left(t, 300), chr(10), chr(10), '[...]', chr(10), chr(10), substr(t, CAST(floor(length(t) / 2) AS INT) - 149, 300), chr(10), chr(10), '[...]', chr(10), chr(10), right(t, 300)) END) AS digest,
least(50, len(list_filter(lines, lambda x: regexp_matches(x, '\\[\\d+\\]|\\(\\w+, \\d{{4}}\\)')))) AS with_pattern FROM s""")
def thirds_sample(spark, sf_dir):
    """A third of the limit from the beginning, middle and end; lines that hold a pattern."""
    d = decorated(spark, sf_dir)
    return d.select("doc_id", F.md5(F.encode(sample_thirds(join_lines(F.col("lines")), 900), "UTF-8")).alias("digest"), F.size(removal.pattern_lines(F.col("lines"), [r"\[\d+\]", r"\(\w+, \d{4}\)"])).cast("long").alias("with_pattern"))


@query(f"""WITH {WITH}, v AS (SELECT doc_id, {TRIM.format('x')} AS trimmed, i FROM (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM decorated))
SELECT doc_id, md5(trimmed) AS line_digest, count(*) AS n, min(i) AS first_line, max(i) AS last_line FROM v WHERE trimmed <> '' GROUP BY doc_id, trimmed HAVING count(*) > 1""")
def line_frequencies(spark, sf_dir):
    """Lines that return within a document."""
    f = mining.line_frequencies(mining.line_view(decorated(spark, sf_dir))).filter("n > 1")
    return f.select("doc_id", F.md5(F.encode("trimmed", "UTF-8")).alias("line_digest"), "n", "first_line", "last_line")


_RUNNING = f"""v AS (SELECT doc_id, {TRIM.format('x')} AS t, i, n_lines FROM (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n_lines FROM decorated WHERE len(lines) > 50)),
e AS (SELECT * FROM v WHERE length(t) BETWEEN 3 AND 80 AND NOT regexp_matches(t, '^[#*-]') AND (NOT contains(t, '.') OR length(t) <= 50) AND NOT starts_with(lower(t), 'chapter') AND NOT starts_with(lower(t), 'part ')),
g AS (SELECT *, i - lag(i) OVER (PARTITION BY doc_id, t ORDER BY i) AS gap FROM e),
a AS (SELECT doc_id, t, count(*) AS n, min(i) AS first_line, max(i) AS last_line, max(n_lines) AS n_lines, min(gap) AS low, max(gap) AS high, CAST(sum(gap) AS BIGINT) AS total FROM g GROUP BY doc_id, t HAVING count(*) >= 3),
f AS (SELECT * FROM a WHERE (last_line - first_line) / n_lines >= 0.3 AND low >= (total // (n - 1)) * 0.3 AND high <= (total // (n - 1)) * 2.5)"""


@query(f"""WITH {WITH}, {_RUNNING}
SELECT doc_id, t AS line, CASE WHEN t = upper(t) AND contains(t, ' ') AND (length(t) > 10 OR NOT contains(t, ' & ')) THEN 'header' ELSE 'footer' END AS kind, n, first_line FROM f""")
def running_headers(spark, sf_dir):
    """Lines that return at even distances."""
    return mining.running_lines(decorated(spark, sf_dir))


@query(f"""WITH {WITH}, {_RUNNING}, r AS (SELECT doc_id, list(t) AS gone FROM f GROUP BY doc_id)
SELECT doc_id, len(list_filter(lines, lambda x: gone IS NULL OR NOT list_contains(gone, {TRIM.format('x')}))) AS n_left FROM decorated LEFT JOIN r USING (doc_id)""")
def drop_running_headers(spark, sf_dir):
    """D12 as step 4: within the row, by the rules of running_headers."""
    return mining.drop_running(decorated(spark, sf_dir)).select("doc_id", F.size("lines").cast("long").alias("n_left"))


@query(rf"""WITH {WITH}, v AS (SELECT doc_id, x, i, CASE WHEN {TRIM.format('x')} = '' THEN 0 WHEN regexp_matches(x, '{fixed.INDEX_ENTRY.replace("'", "''")}') THEN 1 ELSE 2 END AS k FROM (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM decorated)),
m AS (SELECT *, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM v),
r AS (SELECT doc_id, min(i) AS start_line, count(*) AS n FROM m WHERE k = 1 GROUP BY doc_id, island),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, start_line) AS place FROM r)
SELECT doc_id, start_line, n FROM b WHERE place = 1""")
def longest_index_run(spark, sf_dir):
    """Gaps and islands of index entries."""
    return mining.longest_island(mining.index_islands(mining.line_view(decorated(spark, sf_dir))))


@query(f"""WITH {WITH}, v AS (SELECT doc_id, i, starts_with({TRIM.format('x')}, '```') AS fence FROM (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM decorated)),
p AS (SELECT doc_id, i, fence, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seen FROM v)
SELECT doc_id, count(*) FILTER (WHERE seen % 2 = 1 OR fence) AS inside FROM p GROUP BY doc_id""")
def lines_in_code(spark, sf_dir):
    """Lines inside fenced code."""
    d = decorated(spark, sf_dir).withColumn("ranges", code_ranges(F.col("lines")))
    return d.select("doc_id", F.size(F.filter(F.transform("lines", lambda x, i: in_any(F.col("ranges"), i)), lambda x: x)).cast("long").alias("inside"))


@query(rf"""WITH {WITH}, v AS (SELECT doc_id, i, {TRIM.format('x')} AS t FROM (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM decorated)),
k AS (SELECT *, regexp_matches(t, '^\|.*\|$') AS on_ FROM v), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, on_ ORDER BY i) AS grp FROM k),
r AS (SELECT doc_id, min(i) AS s, max(i) AS e, bool_or(regexp_matches(t, '\|[\s\-:]+\|')) AS sep FROM g WHERE on_ GROUP BY doc_id, grp)
SELECT doc_id, s AS start_line, e AS end_line FROM r WHERE e > s AND sep""")
def table_runs(spark, sf_dir):
    """Tables as maximal runs of |...| lines."""
    d = decorated(spark, sf_dir).select("doc_id", F.explode_outer(table_blocks(F.col("lines"))).alias("t")).filter(F.col("t").isNotNull())
    return d.select("doc_id", F.col("t.start").alias("start_line"), F.col("t.end").alias("end_line"))




@query(rf"""SELECT doc_id, {WORDS.format('text')} AS words, true AS merged_same FROM documents""")
def word_chunks(spark, sf_dir):
    """Chunks hold all words, and joined again give the text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(f"regexp_replace(text, '([.!?])\\\\n', '$1\\n\\n')").alias("text"))
    d = d.withColumn("chunks", chunking.word_chunks(F.col("text"), 120, 20))
    merged = chunking.merge_chunks(F.transform("chunks", lambda c: c["content"]))
    return d.select("doc_id", F.aggregate("chunks", F.lit(0), lambda acc, c: acc + count_words(c["content"])).alias("words"), (merged == F.col("text")).alias("merged_same"))


_CUT = """CASE WHEN n - least({0} + 40, n) < 100 THEN n ELSE coalesce({0} + 40 + nullif(list_position(list_transform(l[{0} + 41 : least({0} + 45, n)], lambda x: regexp_matches(x, '^\\s*$')), true), 0),
{0} + 41 - nullif(list_position(list_reverse(list_transform(l[{0} + 36 : {0} + 40], lambda x: regexp_matches(x, '^\\s*$'))), true), 0), {0} + 40) END"""


@query(f"""WITH RECURSIVE {WITH}, b AS (SELECT doc_id, list_concat(lines, list_concat(list_reverse(lines), lines)) AS l FROM decorated), d AS (SELECT doc_id, l, len(l) AS n FROM b),
c(doc_id, chunk_id, s, e) AS (SELECT doc_id, 0, 0, CAST({_CUT.format('0')} AS INT) FROM d UNION ALL SELECT c.doc_id, c.chunk_id + 1, c.e, CAST({_CUT.format('c.e')} AS INT) FROM c JOIN d ON d.doc_id = c.doc_id WHERE c.e < d.n)
SELECT c.doc_id, chunk_id, s AS start_line, e - 1 AS end_line, md5(array_to_string(l[s + 1 : e], chr(10))) AS digest, CASE WHEN chunk_id > 0 THEN length(array_to_string(l[greatest(s - 5, 0) + 1 : s], chr(10))) END AS n_context FROM c JOIN d ON d.doc_id = c.doc_id""")
def line_chunks(spark, sf_dir):
    """Chunks of lines, cut near blank lines, with what stands before them; documents three times as long."""
    d = decorated(spark, sf_dir).select("doc_id", join_lines(F.concat("lines", F.reverse("lines"), "lines")).alias("text"))
    found = chunking.line_chunks(d, target=40, overlap=5, snap=5)
    return found.select("doc_id", "chunk_id", "start_line", "end_line", F.md5(F.encode("content", "UTF-8")).alias("digest"), F.length("context").alias("n_context"))


def in_three_pages(lines):
    """All lines as three pages of about as many each."""
    third = F.floor(F.size(lines) / 3).cast("int")
    return F.concat_ws(chunking.PAGE_BREAK, join_lines(F.slice(lines, F.lit(1), third)), join_lines(F.slice(lines, third + 1, third)), join_lines(F.slice(lines, 2 * third + 1, F.size(lines) - 2 * third)))


@query(f"""WITH {WITH} SELECT doc_id, 3 AS pages, true AS same FROM decorated""")
def page_split_and_join(spark, sf_dir):
    """C5."""
    d = decorated(spark, sf_dir).select("doc_id", in_three_pages(F.col("lines")).alias("t"))
    p = chunking.split_pages(F.col("t"))
    return d.select("doc_id", F.size(p).alias("pages"), (chunking.join_pages(p) == F.col("t")).alias("same"))


@query(r"""SELECT conv_id, turn, levenshtein(a, reverse(a)) AS distance, length(a) AS longest FROM (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS a FROM conversations)""")
def text_distance(spark, sf_dir):
    """Q13: edit distance of whole turns to their reverse (ASCII, as DuckDB's counts bytes)."""
    a = F.regexp_replace("text", r"[^\x00-\x7F]", "?")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.levenshtein(a, F.reverse(a)).alias("distance"), F.length(a).alias("longest"))


@query()
def text_distance_whole(spark, sf_dir):
    """Q13 over whole turns, in code points; tests compare it with brute force."""
    d, b = spark.read.parquet(f"{sf_dir}/conversations.parquet"), F.reverse("text")
    return d.select("conv_id", "turn", F.levenshtein("text", b).alias("distance"), F.length("text").alias("longest"))


_RANGE_ROWS = [(k, a, b, c, d) for k, (a, b, c, d) in enumerate([(0, 5, 3, 8), (0, 5, 6, 8), (2, 2, 2, 2), (7, 9, 0, 7), (4, 10, 5, 6)])]


@query(f"""SELECT k, s1 <= e2 AND s2 <= e1 AS overlap, CASE WHEN s1 <= e2 AND s2 <= e1 THEN greatest(s1, s2) END AS start_line, CASE WHEN s1 <= e2 AND s2 <= e1 THEN least(e1, e2) END AS end_line
FROM (VALUES {", ".join(map(str, _RANGE_ROWS))}) AS t(k, s1, e1, s2, e2)""")
def range_predicates(spark, sf_dir):
    """P16."""
    from ..functions.lines import intersection, overlaps

    d = spark.createDataFrame(_RANGE_ROWS, "k int, s1 int, e1 int, s2 int, e2 int")
    c = [F.col(x) for x in ("s1", "e1", "s2", "e2")]
    return d.select("k", overlaps(*c).alias("overlap"), intersection(*c).alias("x")).select("k", "overlap", F.col("x.start").alias("start_line"), F.col("x.end").alias("end_line"))
