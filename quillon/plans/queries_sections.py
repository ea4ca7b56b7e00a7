"""Queries on sections: detectors, checks, chapters, and the whole cleaning plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.lines import join_lines, split_lines
from ..operators import boundaries, metrics, mining, structure, validation
from . import cleaning
from .config import PRESETS, preset, suggested
from .decorate import WITH, decorated
from .queries_lines import TRIM, WORDS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_VIEW = "v AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n FROM decorated)"


def _weight(headings, plain, trimmed: bool) -> str:
    """SQL of the greatest heading weight of line x."""
    out = []
    for w in sorted({*headings, *plain}, reverse=True):
        tests = []
        if w in headings:
            tests.append(f"regexp_matches(x, {_q(rf'^#{{1,3}}\s*(?:{'|'.join(headings[w])})\s*$')})")
        if w in plain:
            tests.append(f"regexp_matches({TRIM.format('x') if trimmed else 'x'}, {_q('^(?:' + '|'.join(plain[w]) + ')$')})")
        out.append(f"WHEN {' OR '.join(tests)} THEN {w}")
    return f"CASE {' '.join(out)} END"


@query(f"""WITH {WITH}, {_VIEW}, h AS (SELECT doc_id, i, n, {_weight(fixed.BACK_HEADINGS, fixed.BACK_PLAIN, True)} AS w FROM v WHERE n >= 50 AND i >= CAST(floor(n * 0.5) AS INT)),
a AS (SELECT doc_id, min(i) AS line, arg_min(w, i) AS w, count(*) AS hits, max(n) AS n FROM h WHERE w IS NOT NULL GROUP BY doc_id),
c AS (SELECT doc_id, line, CASE WHEN hits >= 3 THEN least(1.0, w + 0.15) WHEN hits >= 2 THEN least(1.0, w + 0.1) ELSE w END * CASE WHEN line / n < 0.55 THEN 0.9 ELSE 1.0 END AS confidence FROM a)
SELECT doc_id, line, round(confidence, 6) AS confidence FROM c WHERE confidence >= 0.6""")
def back_matter_start(spark, sf_dir):
    """D01, T2."""
    d = decorated(spark, sf_dir).withColumn("b", boundaries.back_matter(F.col("lines")))
    return d.filter("b IS NOT NULL").select("doc_id", F.col("b.line").cast("long").alias("line"), F.round("b.confidence", 6).alias("confidence"))


_IE, _LD = _q(fixed.INDEX_ENTRY), _q(fixed.LETTER_DIVIDER)


@query(f"""WITH {WITH}, {_VIEW}, w AS (SELECT doc_id, i, n, regexp_matches(x, {_IE}) AS entry, regexp_matches(x, {_LD}) AS letter, {TRIM.format('x')} = '' AS blank, {_weight(fixed.INDEX_HEADINGS, fixed.INDEX_PLAIN, False)} AS w FROM v WHERE n >= 50),
h AS (SELECT doc_id, min(i) AS line, arg_min(w, i) AS w FROM w WHERE w IS NOT NULL AND i >= CAST(floor(n * 0.7) AS INT) GROUP BY doc_id),
e AS (SELECT h.doc_id, h.line, h.w, count(*) FILTER (WHERE entry) AS entries, count(*) FILTER (WHERE letter) AS letters FROM h JOIN w ON w.doc_id = h.doc_id AND w.i >= h.line AND w.i < h.line + 50 GROUP BY 1, 2, 3),
c AS (SELECT doc_id, line, w, entries, least(1.0, CASE WHEN entries >= 20 THEN least(1.0, w + 0.2) WHEN entries >= 10 THEN least(1.0, w + 0.15) WHEN entries >= 5 THEN least(1.0, w + 0.1) ELSE w END + CASE WHEN letters >= 5 THEN 0.1 WHEN letters >= 1 THEN 0.05 ELSE 0 END) AS confidence FROM e),
m AS (SELECT *, sum(CASE WHEN NOT blank AND NOT entry THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM w WHERE i >= CAST(floor(n * 0.7) AS INT) AND doc_id NOT IN (SELECT doc_id FROM h)),
r AS (SELECT doc_id, min(i) AS line, count(*) AS run FROM m WHERE entry GROUP BY doc_id, island),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run DESC, line) AS place FROM r)
SELECT doc_id, line, round(confidence, 6) AS confidence FROM c WHERE (w >= 1 OR entries >= 5) AND confidence >= 0.6
UNION ALL SELECT doc_id, line, round(least(0.8, 0.5 + run / 100.0), 6) FROM b WHERE place = 1 AND run >= 30""")
def index_start(spark, sf_dir):
    """An index by its heading or by the density of its entries."""
    d = decorated(spark, sf_dir).withColumn("b", boundaries.index_start(F.col("lines")))
    return d.filter("b IS NOT NULL").select("doc_id", F.col("b.line").cast("long").alias("line"), F.round("b.confidence", 6).alias("confidence"))


def _case(patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(x, {_q(p)}) THEN {k}" for k, (p, _) in enumerate(patterns)) + " END"


_KINDS = " + ".join(f"CASE WHEN bool_or(regexp_matches(x, {_q('(?i)' + p)})) THEN 1 ELSE 0 END" for p, _ in fixed.FRONT_INDICATORS)


@query(f"""WITH {WITH}, {_VIEW}, p AS (SELECT doc_id, i, {_case(fixed.MAIN_STARTS)} AS p FROM v WHERE n >= 50 AND i < CAST(floor(n * 0.3) AS INT)),
f AS (SELECT doc_id, p, i, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS place FROM p WHERE p IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS line, p FROM f WHERE place = 1 AND i - 1 >= 3),
k AS (SELECT g.doc_id, g.line, g.p, {_KINDS} AS kinds FROM g JOIN v ON v.doc_id = g.doc_id AND v.i <= g.line GROUP BY 1, 2, 3)
SELECT doc_id, line, kinds, round(CASE WHEN kinds >= 3 THEN least(1.0, w + 0.15) WHEN kinds >= 1 THEN least(1.0, w + 0.1) ELSE w END, 6) AS confidence
FROM (SELECT *, ([{", ".join(str(w) for _, w in fixed.MAIN_STARTS)}])[p + 1] AS w FROM k)""")
def front_matter_end(spark, sf_dir):
    """Front matter that ends where the main content starts."""
    d = decorated(spark, sf_dir).withColumn("b", boundaries.front_matter_end(F.col("lines"))).filter("b IS NOT NULL")
    d = d.withColumn("kinds", boundaries.indicator_kinds(F.col("lines"), F.col("b.line"))).withColumn("next", F.get("lines", F.col("b.line") + 1))
    main = F.lit(False)
    for p, _ in fixed.MAIN_STARTS:
        main = main | F.col("next").rlike(p)
    return d.filter(main).select("doc_id", F.col("b.line").cast("long").alias("line"), "kinds", F.round("b.confidence", 6).alias("confidence"))


@query(f"""WITH {WITH}, {_VIEW}, p AS (SELECT doc_id, i, {_case(fixed.TOC_HEADERS)} AS p FROM v WHERE n >= 50 AND i < CAST(floor(n * 0.3) AS INT)),
f AS (SELECT doc_id, p, i, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS place FROM p WHERE p IS NOT NULL),
s AS (SELECT f.doc_id, f.i AS line, f.p, v.i, v.x, {TRIM.format('v.x')} AS t FROM f JOIN v ON v.doc_id = f.doc_id AND v.i > f.i AND v.i <= f.i + 50 WHERE place = 1),
z AS (SELECT doc_id, min(i) AS stop FROM s WHERE regexp_matches(t, '^##? Chapter') OR starts_with(upper(t), 'CHAPTER 1') GROUP BY doc_id),
k AS (SELECT s.doc_id, s.line, s.p, count(*) FILTER (WHERE t <> '' AND (z.stop IS NULL OR s.i < z.stop) AND (regexp_matches(x, {_q(fixed.TOC_ENTRY)}) OR regexp_matches(x, {_q(fixed.PAGED_LINE)}))) AS entries FROM s LEFT JOIN z USING (doc_id) GROUP BY 1, 2, 3),
c AS (SELECT doc_id, line, entries, w, CASE WHEN entries >= 10 THEN least(1.0, w + 0.2) WHEN entries >= 5 THEN least(1.0, w + 0.15) WHEN entries >= 3 THEN least(1.0, w + 0.1) WHEN entries = 0 THEN w * 0.7 ELSE w END AS confidence FROM (SELECT *, ([{", ".join(str(w) for _, w in fixed.TOC_HEADERS)}])[p + 1] AS w FROM k))
SELECT doc_id, line, round(confidence, 6) AS confidence FROM c WHERE (w >= 1 OR entries >= 3) AND confidence >= 0.6""")
def toc_start(spark, sf_dir):
    """A table of contents under its heading."""
    d = decorated(spark, sf_dir).withColumn("b", boundaries.toc_start(F.col("lines"))).filter("b IS NOT NULL")
    return d.select("doc_id", F.col("b.line").cast("long").alias("line"), F.round("b.confidence", 6).alias("confidence"))


@query(f"""WITH {WITH}, {_VIEW}, t AS (SELECT doc_id, i, {TRIM.format('x')} AS t FROM v),
h AS (SELECT doc_id, min(i) AS line FROM v WHERE x = '## TABLE OF CONTENTS' GROUP BY doc_id),
s AS (SELECT h.doc_id, h.line, t.i, t.t, t.t = '' AS blank, (starts_with(t.t, '# ') AND NOT contains(lower(t.t), 'contents')) OR (regexp_matches(upper(t.t), '^(CHAPTER |PART |PROLOGUE|INTRODUCTION)') AND NOT regexp_matches(t.t, '\\s+\\d+\\s*$')) AS stop FROM h JOIN t ON t.doc_id = h.doc_id AND t.i > h.line AND t.i < h.line + 100),
e AS (SELECT doc_id, min(i) AS at FROM s WHERE stop GROUP BY doc_id)
SELECT h.doc_id, h.line AS start_line, coalesce(max(s.i) FILTER (WHERE NOT s.blank AND (e.at IS NULL OR s.i < e.at)), h.line) AS end_line FROM h LEFT JOIN s USING (doc_id) LEFT JOIN e USING (doc_id) GROUP BY h.doc_id, h.line""")
def toc_end(spark, sf_dir):
    """Where tables of contents end (none here has three blank lines in a row)."""
    d = decorated(spark, sf_dir).withColumn("s", F.array_position("lines", "## TABLE OF CONTENTS").cast("int") - 1).filter("s >= 0")
    return d.select("doc_id", F.col("s").cast("long").alias("start_line"), boundaries.toc_end(F.col("lines"), F.col("s")).cast("long").alias("end_line"))


_LIST_ENTRY = " OR ".join(f"regexp_matches(x, {_q('(?i)' + p)})" for p in fixed.LIST_ENTRIES)
_LIST_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(upper(h.x), {_q(p)}) THEN {_q(name)}" for p, name in fixed.LIST_TYPES) + " ELSE 'Auxiliary List' END"
_OPENING = "regexp_matches(upper(t), '^(CHAPTER |PART |PROLOGUE|INTRODUCTION)')"


@query(f"""WITH {WITH}, {_VIEW}, l AS (SELECT doc_id, i, x, {TRIM.format('x')} AS t, CAST(floor(n * 0.4) AS INT) AS high, {_weight(fixed.LIST_HEADINGS, fixed.LIST_PLAIN, False)} AS w, {_LIST_ENTRY} AS entry FROM v WHERE n >= 50),
k AS (SELECT *, t = '' AS blank, starts_with(t, '#') OR {_OPENING} OR (t = upper(t) AND length(t) > 3 AND length(t) < 50 AND NOT contains(t, '.') AND NOT regexp_matches(t, '^\\p{{N}}') AND w IS NOT NULL) AS stop FROM l),
h AS (SELECT doc_id, i, x, w, high FROM k WHERE w IS NOT NULL AND i < high),
p AS (SELECT h.doc_id, h.i AS s, k.i, k.blank, k.stop AND NOT k.blank AS stop, k.blank AND lag(k.blank) OVER z AND lag(k.blank, 2) OVER z AS third, k.entry FROM h JOIN k ON k.doc_id = h.doc_id AND k.i > h.i AND k.i < least(h.i + 100, h.high) WINDOW z AS (PARTITION BY h.doc_id, h.i ORDER BY k.i)),
e AS (SELECT doc_id, s, min(i) FILTER (WHERE stop OR third) AS at FROM p GROUP BY 1, 2),
f AS (SELECT h.doc_id, h.i AS s, coalesce(max(p.i) FILTER (WHERE NOT p.blank AND (e.at IS NULL OR p.i < e.at)), h.i) AS e FROM h LEFT JOIN e ON e.doc_id = h.doc_id AND e.s = h.i LEFT JOIN p ON p.doc_id = h.doc_id AND p.s = h.i GROUP BY 1, 2, h.i),
c AS (SELECT f.doc_id, f.s, f.e, count(k.i) FILTER (WHERE k.entry) AS n FROM f LEFT JOIN k ON k.doc_id = f.doc_id AND k.i > f.s AND k.i <= f.e GROUP BY 1, 2, 3),
g AS (SELECT c.doc_id, {_LIST_TYPE} AS type, c.s, c.e, c.n, CASE WHEN n >= 5 THEN least(1.0, w + 0.15) WHEN n >= 2 THEN least(1.0, w + 0.1) WHEN n = 0 THEN w * 0.7 ELSE w END AS confidence FROM c JOIN h ON h.doc_id = c.doc_id AND h.i = c.s)
SELECT doc_id, type, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, round(confidence, 6) AS confidence, CAST(n AS INT) AS entries FROM g a WHERE confidence >= 0.6 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.doc_id = a.doc_id AND b.confidence >= 0.6 AND b.s < a.s AND b.e >= a.s)""")
def auxiliary_lists(spark, sf_dir):
    """Lists under headings, with their ends and entries."""
    d = decorated(spark, sf_dir).select("doc_id", F.explode_outer(boundaries.auxiliary_lists(F.col("lines"))).alias("l")).filter("l IS NOT NULL")
    return d.select("doc_id", "l.type", F.col("l.start").alias("start_line"), F.col("l.end").alias("end_line"), F.round("l.confidence", 6).alias("confidence"), "l.entries")


@query(f"""WITH {WITH}, {_VIEW}, k AS (SELECT doc_id, i, {TRIM.format('x')} = '' AS blank, regexp_matches({TRIM.format('x')}, {_q(fixed.ABBREVIATION)}) AS entry FROM v WHERE i < CAST(floor(n * 0.4) AS INT)),
m AS (SELECT *, sum(CASE WHEN NOT blank AND NOT entry THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k)
SELECT doc_id, min(i) AS start_line, max(i) AS end_line, count(*) AS entries, round(least(0.7, 0.5 + count(*) * 0.05), 6) AS confidence FROM m WHERE entry GROUP BY doc_id, island HAVING count(*) >= 3""")
def headerless_lists(spark, sf_dir):
    """Abbreviation clusters."""
    d = decorated(spark, sf_dir).select("doc_id", F.explode_outer(boundaries.headerless_lists(F.col("lines"))).alias("l")).filter("l.type = 'abbreviations'")
    return d.select("doc_id", F.col("l.start").cast("long").alias("start_line"), F.col("l.end").cast("long").alias("end_line"), F.col("l.entries").cast("long").alias("entries"), F.round("l.confidence", 6).alias("confidence"))


@query(f"""WITH {WITH}, {_VIEW}, k AS (SELECT doc_id, i, n, regexp_matches({TRIM.format('x')}, {_q(fixed.NOTES_START)}) AS s, regexp_matches({TRIM.format('x')}, {_q(fixed.NOTES_END)}) AS e FROM v),
b AS (SELECT doc_id, i AS start_line, n FROM k WHERE s)
SELECT b.doc_id, b.start_line, coalesce(min(k.i) FILTER (WHERE k.e) - 1, max(b.n) - 1) AS end_line FROM b JOIN k ON k.doc_id = b.doc_id AND k.i > b.start_line GROUP BY b.doc_id, b.start_line""")
def notes_sections(spark, sf_dir):
    """D08, W8."""
    d = decorated(spark, sf_dir).select("doc_id", F.explode_outer(boundaries.notes_sections(F.col("lines"))).alias("s")).filter("s IS NOT NULL")
    return d.select("doc_id", F.col("s.start").cast("long").alias("start_line"), F.col("s.end").cast("long").alias("end_line"))


@query(f"""WITH {WITH}, {_VIEW}, t AS (SELECT doc_id, i, {TRIM.format('x')} AS t FROM v),
c AS (SELECT doc_id, i, trim(regexp_replace(t, '^#+\\s*', '')) AS title FROM t WHERE regexp_matches(t, '^#{{1,2}}\\s*Chapter\\s+\\d+')),
p AS (SELECT doc_id, i, trim(regexp_replace(t, '^#+\\s*', '')) AS part FROM t WHERE regexp_matches(t, '^#{{1,2}}\\s*Part\\s+[IVXLC]+'))
SELECT c.doc_id, c.i AS line, CASE WHEN contains(title, ': ') THEN split_part(title, ': ', 2) ELSE title END AS title, arg_max(p.part, p.i) AS part FROM c LEFT JOIN p ON p.doc_id = c.doc_id AND p.i <= c.i GROUP BY c.doc_id, c.i, title""")
def chapters_in_parts(spark, sf_dir):
    """Chapters with the latest part before each (an as-of join)."""
    lines = F.col("lines")
    d = decorated(spark, sf_dir).withColumn("ch", structure.chapters(lines)).withColumn("pt", structure.parts(lines))
    d = d.select("doc_id", F.explode_outer(structure.chapters_in_parts(F.col("ch"), F.col("pt"))).alias("c")).filter("c IS NOT NULL")
    return d.select("doc_id", F.col("c.line").cast("long").alias("line"), "c.title", "c.part")


_FW, _CW, _BW = "|".join(fixed.FRONT_WORDS), "|".join(fixed.CORE_WORDS), "|".join(fixed.BACK_WORDS)


@query(f"""WITH {WITH}, {_VIEW}, k AS (SELECT doc_id, i, n, lower({TRIM.format('x')}) AS t FROM v WHERE n >= 10),
b AS (SELECT doc_id, max(i) FILTER (WHERE regexp_matches(t, '^(?:{_BW})') AND i >= n - 500) AS back_start FROM k GROUP BY doc_id)
SELECT doc_id, back_start FROM b""")
def keyword_boundaries(spark, sf_dir):
    """The last back-matter word within the last 500 lines."""
    d = decorated(spark, sf_dir).withColumn("b", boundaries.keyword_boundaries(F.col("lines")))
    return d.filter(F.size("lines") >= 10).select("doc_id", F.col("b.back_start").cast("long").alias("back_start"))


@query()
def boundary_report(spark, sf_dir):
    """All that is found in each document; parts of it have SQL of their own."""
    lines = F.col("lines")
    d = decorated(spark, sf_dir).select(
        "doc_id", "variant", F.size(lines).alias("n"), boundaries.front_matter_end(lines).alias("f"), boundaries.toc_start(lines).alias("t"), boundaries.back_matter(lines).alias("b"), boundaries.index_start(lines).alias("i"), boundaries.keyword_boundaries(lines).alias("k")
    )
    core = boundaries.core_range(F.array("f.line"), F.array("b.line"), F.col("n"))
    return d.select("doc_id", "variant", F.col("f.line").alias("front_end"), F.col("t.line").alias("toc_start"), F.col("b.line").alias("back_start"), F.col("i.line").alias("index_start"), F.col("k.front_end").alias("front_by_words"), core["start"].alias("core_start"), core["end"].alias("core_end"))


# Boundaries of a document of 500 lines and whether they hold.
CASES = [
    ("auxiliaryLists", 50, 80, 0.80, "valid"), ("auxiliaryLists", 250, 300, 0.80, "too_late"), ("auxiliaryLists", 10, 135, 0.80, "too_large"), ("auxiliaryLists", 50, 80, 0.50, "low_confidence"), ("auxiliaryLists", 50, 51, 0.80, "too_small"),
    ("auxiliaryLists", 30, 32, 0.65, "valid"), ("auxiliaryLists", 50, None, 0.80, "no_boundary"), ("backMatter", 4, 500, 0.90, "too_early"), ("backMatter", 400, 499, 0.80, "valid"), ("index", 150, 200, 0.80, "too_early"), ("index", 425, 499, 0.80, "valid"),
    ("frontMatter", 0, 250, 0.80, "too_late"), ("frontMatter", 0, 50, 0.80, "valid"), ("tableOfContents", 200, 250, 0.80, "too_late"), ("tableOfContents", 50, 75, 0.80, "valid"), ("footnotesEndnotes", 10, 60, 0.9, "too_large"),
    ("footnotesEndnotes", 450, 499, 0.9, "valid"), ("other", 600, None, 0.9, "out_of_bounds"), ("other", None, None, 0.9, "no_boundary"), ("tableOfContents", 60, 50, 0.9, "inverted"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s}', '{r}')" for k, (s, *_, r) in enumerate(CASES)) + ") AS t(k, section, reason)")
def boundary_validation(spark, sf_dir):
    """V1: stated boundaries and the first reason against each."""
    d = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "k int, section string, s int, e int, c double")
    return d.select("k", "section", validation.boundary_reason(F.col("section"), F.col("s"), F.col("e"), F.col("c"), F.lit(500)).alias("reason"))


@query("""SELECT reason, section, count(*) AS n FROM (VALUES """ + ", ".join(f"('{s}', '{r}')" for s, *_, r in CASES) + """) AS t(section, reason) GROUP BY 1, 2""")
def validation_totals(spark, sf_dir):
    """Reasons by section."""
    d = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(CASES)], "k int, section string, s int, e int, c double")
    d = d.select("section", validation.boundary_reason(F.col("section"), F.col("s"), F.col("e"), F.col("c"), F.lit(500)).alias("reason"))
    return d.groupBy("reason", "section").agg(F.count(F.lit(1)).alias("n"))


@query()
def content_checks(spark, sf_dir):
    """V2: the sections found are checked by their content; tested on stated sections."""
    lines = F.col("lines")
    d = decorated(spark, sf_dir).select("doc_id", "variant", "lines", boundaries.back_matter(lines).alias("b"), boundaries.index_start(lines).alias("i"))
    return d.select("doc_id", "variant", validation.verify_content("backMatter", lines, F.coalesce("b.line", F.lit(-1))).alias("back"), validation.verify_content("index", lines, F.coalesce("i.line", F.lit(-1))).alias("index")).select(
        "doc_id", "variant", F.col("back.reason").alias("back"), F.col("index.reason").alias("index")
    )


@query(f"""SELECT doc_id, CASE WHEN w2 < 10 THEN 0.1 WHEN r < 0.5 THEN 0.4 WHEN r < 0.8 THEN 0.6 ELSE 0.7 END AS score, CASE WHEN w2 < 10 OR r < 0.5 THEN 'critical' WHEN r < 0.8 THEN 'warning' END AS severity
FROM (SELECT doc_id, {WORDS.format('c')} AS w2, {WORDS.format('c')} / greatest({WORDS.format('t')}, 1) AS r FROM (SELECT doc_id, text AS t, left(text, CAST(length(text) * (doc_id % 4 + 1) // 4 AS INT)) AS c FROM documents))""")
def quality_review(spark, sf_dir):
    """V5: documents of which a part is left."""
    t = F.col("text")
    left = F.substring(t, F.lit(1), F.floor(F.length(t) * (F.col("doc_id") % 4 + 1) / 4).cast("int"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", validation.review(t, left, F.lit(False)).alias("r"))
    return d.select("doc_id", "r.score", "r.severity")


_CONF = [(k, a, b, c, d, e) for k, (a, b, c, d, e) in enumerate([(0.9, 0.8, 0.7, None, 0.6), (None, None, None, None, None), (0.5, None, 0.9, 0.7, None), (None, 0.4, 0.2, 0.4, 0.8)])]


@query("""SELECT k, round(coalesce((coalesce(h,0)+coalesce(b,0)+coalesce(p,0)+coalesce(q,0)+coalesce(r,0)) / nullif((h IS NOT NULL)::INT+(b IS NOT NULL)::INT+(p IS NOT NULL)::INT+(q IS NOT NULL)::INT+(r IS NOT NULL)::INT, 0), 0), 6) AS overall,
round(coalesce((coalesce(h,0)+coalesce(b,0)+coalesce(m,0)+coalesce(r,0)) / nullif((h IS NOT NULL)::INT+(b IS NOT NULL)::INT+(m IS NOT NULL)::INT+(r IS NOT NULL)::INT, 0), 0), 6) AS tracked
FROM (SELECT *, (coalesce(p,0)+coalesce(q,0)) / nullif((p IS NOT NULL)::INT+(q IS NOT NULL)::INT, 0) AS m FROM (VALUES """ + ", ".join("(" + ", ".join("NULL" if x is None else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in _CONF) + """) AS t(k, h, b, p, q, r))""")
def overall_confidence(spark, sf_dir):
    """Phases count each, or once as their mean."""
    d = spark.createDataFrame(_CONF, "k int, h double, b double, p double, q double, r double")
    h, b, p, q, r = (F.col(c) for c in "hbpqr")
    return d.select("k", F.round(metrics.overall_confidence(h, b, [p, q], r), 6).alias("overall"), F.round(metrics.tracker_confidence(h, b, [p, q], r), 6).alias("tracked"))


@query(rf"""WITH {WITH}, {_VIEW}, t AS (SELECT doc_id, {TRIM.format('x')} AS t FROM v),
c AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE regexp_matches(t, {_q(p)})) AS n{k}" for k, (_, p) in enumerate(fixed.VOTES['page_number']))} FROM t GROUP BY doc_id),
u AS (SELECT doc_id, unnest([{", ".join(f"{{'n': n{k}, 'k': {-k}, 'name': '{name}'}}" for k, (name, _) in enumerate(fixed.VOTES['page_number']))}]) AS s FROM c),
b AS (SELECT doc_id, s.name AS name, s.n AS n, row_number() OVER (PARTITION BY doc_id ORDER BY s.n DESC, s.k DESC) AS place FROM u)
SELECT doc_id, name, CAST(n AS INT) AS n, round(least(n / 20.0, 0.95), 6) AS confidence FROM b WHERE place = 1 AND n >= 3""")
def page_number_vote(spark, sf_dir):
    """The style of a document's page numbers."""
    lines = F.col("lines")
    d = decorated(spark, sf_dir).select("doc_id", mining.pattern_vote(join_lines(lines), lines, "page_number").alias("v")).filter("v IS NOT NULL")
    return d.select("doc_id", "v.name", "v.n", F.round("v.confidence", 6).alias("confidence"))


def _votes(kind: str, least: int) -> str:
    """SQL: the pattern of a kind found most often in t, null if too rare; on a tie the first one named."""
    counts = [f"len(regexp_extract_all(t, {_q(p)}))" for _, p in fixed.VOTES[kind]]
    best = f"greatest({', '.join(counts)})"
    return f"CASE WHEN {best} < {least} THEN NULL " + " ".join(f"WHEN {c} = {best} THEN '{name}'" for c, (name, _) in zip(counts, fixed.VOTES[kind], strict=True)) + " END"


@query(f"""WITH {WITH}, s AS (SELECT doc_id, array_to_string(lines, chr(10)) || CASE WHEN doc_id % 3 = 0 THEN ' so [1], [2] and (Smith, 2020).' ELSE ' note* and word** end' END AS t FROM decorated)
SELECT doc_id, {_votes('citation', 2)} AS citation, {_votes('footnote', 2)} AS footnote FROM s""")
def citation_and_footnote_votes(spark, sf_dir):
    """The styles of citations and footnote markers."""
    t = F.concat(join_lines(F.col("lines")), F.when(F.col("doc_id") % 3 == 0, " so [1], [2] and (Smith, 2020).").otherwise(" note* and word** end"))
    d = decorated(spark, sf_dir).withColumn("t", t)
    d = d.select("doc_id", mining.pattern_vote(F.col("t"), F.col("lines"), "citation").alias("c"), mining.pattern_vote(F.col("t"), F.col("lines"), "footnote").alias("f"))
    return d.select("doc_id", F.col("c.name").alias("citation"), F.col("f.name").alias("footnote"))


def _plan(name):
    def run(spark, sf_dir):
        docs = decorated(spark, sf_dir).select("doc_id", join_lines(F.col("lines")).alias("text"))
        out = cleaning.clean(docs, PRESETS[name])
        return out.select("doc_id", "original_words", "cleaned_words", F.round("reduction_pct", 4).alias("reduction_pct"), "tokens", "primary_type", "score", "severity", F.size("audit").alias("steps"), F.md5(F.encode("text", "UTF-8")).alias("digest"))

    run.__doc__ = f"Q1 to Q3, V4, G17: the plan of the preset {name} over decorated documents."
    return run


for _name in PRESETS:
    QUERIES[f"plan_{_name}"] = _plan(_name)


def proposed(docs):
    """docs with proposals of all kinds: by doc_id % 4 sound, of a wrong place, without lines, and none."""
    k, n = F.col("doc_id") % 4, F.size("lines")
    end = F.array_position("lines", "# Chapter 1").cast("int") - 2
    front = F.when(k == 0, F.struct(F.lit(0).alias("start"), F.when(end >= 0, end).alias("end"), F.lit(0.9).alias("confidence"))).when(k == 1, F.struct(F.lit(0).alias("start"), (n - 1).alias("end"), F.lit(0.9).alias("confidence"))).when(
        k == 2, F.struct(F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(0.9).alias("confidence"))
    )
    back = F.when(k == 1, F.struct(F.lit(4).alias("start"), (n - 1).alias("end"), F.lit(0.9).alias("confidence")))
    lists = F.when(k < 2, F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(0.9).alias("confidence"))))
    reply = F.when(k == 3, F.lit('{"title": "Known", "author": "A. Writer"}'))
    return docs.select("doc_id", "lines", join_lines(F.col("lines")).alias("text"), front.alias("front_proposal"), back.alias("back_proposal"), lists.alias("lists_proposal"), lists.alias("notes_proposal"), reply.alias("metadata_reply"))


@query(f"""WITH {WITH}, {_VIEW}, e AS (SELECT doc_id, min(i) - 1 AS last FROM v WHERE x = '# Chapter 1' GROUP BY doc_id), p AS (SELECT d.doc_id, len(lines) AS n, d.doc_id % 4 AS k, e.last AS last FROM decorated d LEFT JOIN e USING (doc_id))
SELECT doc_id, CASE k WHEN 0 THEN CASE WHEN last IS NULL THEN 'no_boundary' WHEN last < 2 THEN 'too_small' WHEN last > n * 0.4 THEN 'too_late' ELSE 'valid' END WHEN 1 THEN 'too_late' WHEN 2 THEN 'no_boundary' END AS front, CASE WHEN k = 1 THEN 'too_early' END AS back FROM p""")
def proposals_checked(spark, sf_dir):
    """V1 on proposals over decorated documents: the first reason against each."""
    d = proposed(decorated(spark, sf_dir))
    reason = lambda section, p: F.when(F.col(p).isNotNull(), validation.boundary_reason(F.lit(section), F.col(f"{p}.start"), F.col(f"{p}.end"), F.col(f"{p}.confidence"), F.size("lines")))
    return d.select("doc_id", reason("frontMatter", "front_proposal").alias("front"), reason("backMatter", "back_proposal").alias("back"))


@query()
def plan_with_proposals(spark, sf_dir):
    """V1 to V3, Q1: the training plan where a service proposed sections, lists and metadata; the checks of place and content decide, detectors stand in."""
    out = cleaning.clean(proposed(decorated(spark, sf_dir)).drop("lines"), preset("training"))
    return out.select("doc_id", "cleaned_words", "score", F.size("audit").alias("steps"), F.col("text").contains("# KNOWN").alias("titled"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query()
def audit_log(spark, sf_dir):
    """Q7, Q11, V4: what each step changed, over all documents."""
    docs = decorated(spark, sf_dir).select("doc_id", join_lines(F.col("lines")).alias("text"))
    rows = cleaning.audit_rows(cleaning.clean(docs, preset("training", paragraph_length=False)))
    return rows.groupBy("step", "name").agg(F.count(F.lit(1)).alias("docs"), F.sum("changes").alias("changes"), F.count("anomaly").alias("anomalies"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'scholarly' WHEN 1 THEN 'minimal' END AS preset FROM documents""")
def preset_suggestions(spark, sf_dir):
    """Q4."""
    k = F.col("doc_id") % 3
    flags = F.struct((k == 0).alias("is_academic"), F.lit(False).alias("is_legal"), F.when(k == 1, "poetry").otherwise("prose").alias("primary_type"), F.lit(0.8).alias("confidence"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", suggested(flags).alias("preset"))


_CHAPTER_LINE, _PART_LINE = r"'^#{{1,2}}\s*Chapter\s+\d+'", r"'^#{{1,2}}\s*Part\s+[IVXLC]+'"


@query(f"""WITH {WITH}, {_VIEW}, m AS (SELECT doc_id, count(*) FILTER (WHERE regexp_matches({TRIM.format('x')}, {_CHAPTER_LINE.format()})) AS chapters, count(*) FILTER (WHERE regexp_matches({TRIM.format('x')}, {_PART_LINE.format()})) AS parts FROM v GROUP BY doc_id),
b AS (SELECT doc_id, len(string_split(regexp_replace(array_to_string(lines, chr(10)), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), chr(10))) AS body FROM decorated)
SELECT doc_id, CAST(CASE WHEN chapters > 0 THEN chapters + parts ELSE 0 END AS INT) AS markers, CAST(body + 2 * CASE WHEN chapters > 0 THEN chapters + parts ELSE 0 END + 14 AS INT) AS n_lines, true AS ended FROM m JOIN b USING (doc_id)""")
def assembled(spark, sf_dir):
    """Marked chapters and the parts around a text."""
    from ..functions.metadata import blank

    d = decorated(spark, sf_dir).select("doc_id", structure.assemble(join_lines(F.col("lines")), blank(F.lit("A Title"), F.lit("A. Writer"))).alias("t"))
    return d.select("doc_id", F.size(split_lines(F.col("t"))).alias("n_lines"), F.regexp_count("t", F.lit("<!-- (?:PART|CHAPTER)")).alias("markers"), F.col("t").endswith("-->\n").alias("ended"))
