"""Queries on text: characters, citations, Markdown, estimates, metadata, replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chars, citations, estimates, fixed, markdown, metadata, replies
from ..functions.lines import join_lines, trim
from ..functions.segments import CODE, DOI_OR_DECIMAL, extracted, protecting
from ..operators import structure
from ..operators.mining import line_view
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


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaces(column: str, pairs) -> str:
    for a, b in pairs:
        column = f"replace({column}, {_quoted(a)}, {_quoted(b)})"
    return column


_TEXT = "array_to_string(lines, chr(10))"
_MOJIBAKE = _replaces("t", sorted(fixed.MOJIBAKE.items(), key=lambda p: (-len(p[0]), p[0])))
_LIGATURES = _replaces("t", fixed.LIGATURES.items())
_INVISIBLE = _replaces("t", [(c, "") for c in fixed.INVISIBLE])
_QUOTES = _replaces("t", [(c, to) for those, to in fixed.QUOTES.items() for c in those])


@query(f"""WITH {WITH}, s AS (SELECT doc_id, {_TEXT} AS t FROM decorated)
SELECT doc_id, md5({_MOJIBAKE}) AS mojibake, md5({_LIGATURES}) AS ligatures, md5({_INVISIBLE}) AS invisible, md5({_QUOTES}) AS quotes FROM s""")
def character_repairs(spark, sf_dir):
    """X1, X2, X3, X7."""
    d = decorated(spark, sf_dir).select("doc_id", join_lines(F.col("lines")).alias("t"))
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    t = F.col("t")
    return d.select("doc_id", digest(chars.fix_mojibake(t)).alias("mojibake"), digest(chars.expand_ligatures(t)).alias("ligatures"), digest(chars.remove_invisible(t)).alias("invisible"), digest(chars.normalize_quotes(t)).alias("quotes"))


_OCR = ["1O5", "2OO", "3.O", "O5", "word Oh", "1l2", " l5", "l9 x", "all 5", "7O, then", "1OOO!", "ab1O", "5Ox"]
_OCR_DONE = ["105", "200", "3.0", "O5", "word Oh", "112", " 15", "19 x", "all 5", "70, then", "1000!", "ab10", "5Ox"]
_DASHES = ["a--b", "a — — b", "---", "x - — y", "one – two", "‒5", "  spaced   out", "—", "a―b", "***"]
_DASHES_DONE = ["a — b", "a — b", "---", "x — y", "one — two", "-5", " spaced out", "—", "a — b", "***"]


def _values(rows) -> str:
    return ", ".join(f"({k}, {', '.join(_quoted(x) if isinstance(x, str) else str(x) for x in r)})" for k, r in enumerate(rows))


@query(f"SELECT k, t AS text, done AS repaired FROM (VALUES {_values(zip(_OCR, _OCR_DONE, strict=True))}) AS v(k, t, done)")
def ocr_digits(spark, sf_dir):
    """X4 on stated cases; its lookbehinds have no equal in RE2."""
    d = spark.createDataFrame(list(enumerate(_OCR)), "k int, text string")
    return d.select("k", "text", chars.fix_ocr_digits(F.col("text")).alias("repaired"))


@query(f"SELECT k, t AS text, done AS repaired FROM (VALUES {_values(zip(_DASHES, _DASHES_DONE, strict=True))}) AS v(k, t, done)")
def dashes(spark, sf_dir):
    """X5 on stated cases."""
    d = spark.createDataFrame(list(enumerate(_DASHES)), "k int, text string")
    return d.select("k", "text", chars.normalize_dashes(F.array("text"))[0].alias("repaired"))


@query()
def clean_characters(spark, sf_dir):
    """The whole chain; its lookarounds have no equal in RE2."""
    d = decorated(spark, sf_dir).select("doc_id", chars.clean_characters(join_lines(F.col("lines"))).alias("t"))
    return d.select("doc_id", F.length("t").alias("n"), F.md5(F.encode("t", "UTF-8")).alias("digest"), F.regexp_count("t", F.lit(r"[\[\]]")).alias("brackets"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{4,}', repeat(chr(10), 3), 'g')) AS digest
FROM (SELECT page_id, concat('a  ', chr(13), chr(10), 'b', chr(9), chr(10), chr(10), chr(10), chr(10), chr(10), coalesce(url, ''), '  ') AS t FROM pages)""")
def whitespace(spark, sf_dir):
    """X9."""
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("a  \r\nb\t\n\n\n\n\n"), F.coalesce("url", F.lit("")), F.lit("  ")).alias("t"))
    return d.select("page_id", F.md5(F.encode(chars.normalize_whitespace(F.col("t")), "UTF-8")).alias("digest"))


_CITED = ["As (Smith, 2020) says", "so (Smith & Jones, 2019, pp. 3-4) too", "see (Smith et al., 2018).", "both (Smith, 2018; Jones, 2019) hold", "plain (text) here", "value 3.14 stays (Smith, 2020)", "Smith (2020) wrote", "at (ibid., p. 5) end", "Smith, J. (2020). A long enough title. Press."]
_CITED_DONE = ["As says", "so too", "see .", "both hold", "plain (text) here", "value 3.14 stays ", " wrote", "at end", "Smith, J. (2020). A long enough title. Press."]


@query(f"SELECT k, t AS text, done AS cleaned FROM (VALUES {_values(zip(_CITED, _CITED_DONE, strict=True))}) AS v(k, t, done)")
def citations_removed(spark, sf_dir):
    """X10, X11, X13, X14 on stated cases; lookarounds have no equal in RE2."""
    d = spark.createDataFrame(list(enumerate(_CITED)), "k int, text string")
    return d.select("k", "text", citations.remove_citations(F.col("text"))["text"].alias("cleaned"))


_BIB = ["Smith, J. (2020). A title. Press.", "Smith, John. A Book. London, 1999", "Just a plain sentence, That is all.", "Jones, A. and more. Some. Words. here", "short, A.", "Miller, B, University of X"]


@query(f"SELECT k, t AS text, k IN (0, 1, 3, 5) AS bibliography FROM (VALUES {_values((b,) for b in _BIB)}) AS v(k, t)")
def bibliography_lines(spark, sf_dir):
    """X12."""
    return spark.createDataFrame(list(enumerate(_BIB)), "k int, text string").select("k", "text", citations.is_bibliography(F.col("text")).alias("bibliography"))


_NOTED = ["the word² ends", "x[12] y", "a^(3) b", "star* here", "a^b c", "none"]
_NOTED_DONE = [("the word ends", 1), ("x y", 1), ("a b", 1), ("star here", 1), ("a c", 1), ("none", 0)]


@query(f"SELECT k, t AS text, done AS cleaned, n FROM (VALUES {_values((a, *b) for a, b in zip(_NOTED, _NOTED_DONE, strict=True))}) AS v(k, t, done, n)")
def footnote_markers(spark, sf_dir):
    """X15 on stated cases."""
    d = spark.createDataFrame(list(enumerate(_NOTED)), "k int, text string").withColumn("r", citations.remove_footnote_markers(F.col("text")))
    return d.select("k", "text", F.col("r.text").alias("cleaned"), "r.n")


@query(f"""WITH {WITH}, s AS (SELECT doc_id, {_TEXT} AS t FROM decorated)
SELECT doc_id, len(regexp_extract_all(t, '```[a-zA-Z0-9]*\\n[\\s\\S]*?```|`[^`\\n]+`')) AS code_blocks, len(regexp_extract_all(t, '(?i:(?:doi:\\s*)?10\\.\\d{{4,}}/[^\\s]+)|\\b\\d+\\.\\d+\\b')) AS numbers, true AS same FROM s""")
def protected_segments(spark, sf_dir):
    """What is protected, and that nothing is lost by splitting and joining."""
    d = decorated(spark, sf_dir).select("doc_id", join_lines(F.col("lines")).alias("t"))
    t = F.col("t")
    return d.select("doc_id", F.size(extracted(t, CODE)).alias("code_blocks"), F.size(extracted(t, DOI_OR_DECIMAL)).alias("numbers"), (protecting(t, CODE, lambda x: x) == t).alias("same"))


_MD = ["# Title here", "a **bold** word", "x [link](http://a.b) y", "![alt](img.png) z", "code `x = 1` end", "__under__ and   spaces", "plain"]
_MD_DONE = ["Title here", "a bold word", "x link y", "!alt z", "code x = 1 end", "under and spaces", "plain"]


@query(f"SELECT k, t AS text, done AS plain FROM (VALUES {_values(zip(_MD, _MD_DONE, strict=True))}) AS v(k, t, done)")
def markdown_plain(spark, sf_dir):
    """X30, X8 on stated cases."""
    return spark.createDataFrame(list(enumerate(_MD)), "k int, text string").select("k", "text", markdown.to_plain(F.col("text")).alias("plain"))


_STRIP = "coalesce(t, '')"
for _p, _to in ((r"\A#{1,6}\s*", ""), (r"\*\*(.+?)\*\*", r"\1"), (r"\*(.+?)\*", r"\1"), (r"__(.+?)__", r"\1"), (r"_(.+?)_", r"\1"), (r"\[(.+?)\]\(.+?\)", r"\1")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '{_to}', 'g')"


@query(f"SELECT doc_id, md5({_STRIP}) AS digest FROM (SELECT doc_id, concat('# ', coalesce(text, ''), ' **b** *i* [l](u) _e_') AS t FROM documents)")
def export_strip(spark, sf_dir):
    """K5: whole texts of all documents, with a heading and emphasis around each."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(F.encode(markdown.strip_markdown(F.concat(F.lit("# "), F.coalesce("text", F.lit("")), F.lit(" **b** *i* [l](u) _e_"))), "UTF-8")).alias("digest"))


@query()
def export_strip_whole(spark, sf_dir):
    """K5 over whole texts, every document; tests compare it with brute force."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", markdown.strip_markdown(F.col("text")).alias("stripped"))


@query(f"""WITH {WITH}, v AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS i FROM decorated)
SELECT doc_id, i AS place, length(regexp_extract(x, '^(#+) ', 1)) AS level, regexp_replace(x, '^#{{1,4}} ', '') AS heading FROM v WHERE regexp_matches(x, '^#{{1,4}} ')""")
def heading_list(spark, sf_dir):
    """K6."""
    d = line_view(decorated(spark, sf_dir)).select("doc_id", (F.col("line_no") + 1).alias("place"), F.get(markdown.headings(F.col("line")), 0).alias("h"))
    return d.filter(F.col("h").isNotNull()).select("doc_id", "place", "h.level", F.col("h.text").alias("heading"))


@query(r"""SELECT doc_id, 2 AS n_rows, 2 AS n_columns FROM documents""")
def table_shape(spark, sf_dir):
    """X33."""
    t = F.lit("| a | b |\n| --- | --- |\n| 1 | 2 |")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", markdown.table_rows(t).alias("n_rows"), markdown.table_columns(t).alias("n_columns"))


@query(f"""SELECT conv_id, turn, CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(floor((length(text) / 4.0 + {WORDS.format('text')} * 1.3) / 2.0 + 0.5) AS INT)) END AS tokens, CAST(floor(length(text) / 4) AS INT) AS by_chars FROM conversations""")
def token_estimates(spark, sf_dir):
    """X34."""
    t = F.col("text")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", estimates.tokens(t).alias("tokens"), estimates.tokens_by_chars(t).alias("by_chars"))


@query("""SELECT event_id, CASE WHEN c >= 0.9 THEN 'very_high' WHEN c >= 0.75 THEN 'high' WHEN c >= 0.6 THEN 'moderate' WHEN c >= 0.4 THEN 'low' ELSE 'very_low' END AS rating,
CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN c >= 0.9 THEN 'excellent' WHEN c >= 0.75 THEN 'good' WHEN c >= 0.6 THEN 'acceptable' WHEN c >= 0.4 THEN 'needs_review' ELSE 'poor' END AS band
FROM (SELECT event_id, (event_id % 101) / 100.0 AS c FROM events)""")
def confidence_bands(spark, sf_dir):
    """X36, X37."""
    c = (F.col("event_id") % 101) / F.lit(100.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", estimates.rating(c).alias("rating"), estimates.level(c).alias("level"), estimates.review_band(c).alias("band"))


@query("""SELECT event_id, CAST((event_id % 50) * 0.001 AS DOUBLE) AS page_cost, CAST(CASE WHEN event_id % 3 = 0 THEN floor((event_id * 10) * 0.4) * 0.000003 + floor((event_id * 10) * 0.6) * 0.000015 ELSE event_id * 0.000003 + event_id * 2 * 0.000015 END AS DOUBLE) AS clean_cost FROM events""")
def costs(spark, sf_dir):
    """G15, G16."""
    e = F.col("event_id")
    known = F.when(e % 3 != 0, e).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", estimates.page_cost(e % 50).cast("double").alias("page_cost"), estimates.clean_cost(known, known * 2, e * 10).cast("double").alias("clean_cost"))


_SHOWN = [(0.0005, 45.25, 999.0), (0.05, 125.0, 1500.0), (1.5, 3601.0, 2500000.0), (1234.5, 59.94, 3000000000.0)]
_SHOWN_DONE = [("$0.0005", "45.3s", "999 bytes"), ("$0.05", "2m 5s", "2 KB"), ("$1.50", "60m 1s", "2.5 MB"), ("$1,234.50", "59.9s", "3.00 GB")]


@query(f"SELECT k, cost, duration, size FROM (VALUES {_values(_SHOWN_DONE)}) AS v(k, cost, duration, size)")
def shown_numbers(spark, sf_dir):
    """X35 on stated cases."""
    d = spark.createDataFrame([(k, *r) for k, r in enumerate(_SHOWN)], "k int, cost double, seconds double, bytes double")
    return d.select("k", estimates.shown_cost(F.col("cost").cast("decimal(18,6)")).alias("cost"), estimates.shown_duration(F.col("seconds")).alias("duration"), estimates.shown_bytes(F.col("bytes")).alias("size"))


@query("""SELECT page_id, CASE WHEN trim(n) = '' THEN 'Untitled Document' ELSE trim(n) END AS title FROM (SELECT page_id, translate(regexp_replace(f, '\\.[^.]*$', ''), '_-', '  ') AS n FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('my_file-', page_id, '.v2.pdf') WHEN 1 THEN concat('Plain ', page_id) ELSE '.pdf' END AS f FROM pages))""")
def titles_from_names(spark, sf_dir):
    """X39."""
    p = F.col("page_id")
    name = F.when(p % 3 == 0, F.concat(F.lit("my_file-"), p.cast("string"), F.lit(".v2.pdf"))).when(p % 3 == 1, F.concat(F.lit("Plain "), p.cast("string"))).otherwise(".pdf")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", metadata.title_from_filename(name).alias("title"))


@query("""SELECT page_id, concat('---', chr(10), 'title: "A: ', page_id, '"', chr(10), 'author: Writer ', page_id, CASE WHEN page_id % 2 = 1 THEN concat(chr(10), 'chapters: ', page_id % 5 + 1) ELSE '' END, chr(10), '---') AS yaml,
concat('# A: ', page_id, ' (WRITER ', page_id, ')') AS header, concat('**Title:** A: ', page_id, '  ', chr(10), '**Author:** Writer ', page_id) AS markdown FROM pages""")
def metadata_rendering(spark, sf_dir):
    """X38."""
    p = F.col("page_id")
    title, author = F.concat(F.lit("A: "), p.cast("string")), F.concat(F.lit("Writer "), p.cast("string"))
    d = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", metadata.blank(title, author, F.when(p % 2 == 1, p % 5 + 1)).alias("m"))
    m = F.col("m")
    return d.select("page_id", metadata.to_yaml(m).alias("yaml"), metadata.title_header(m["title"], m["subtitle"], m["author"]).alias("header"), metadata.to_markdown(m).alias("markdown"))


@query("""SELECT event_id, 'academic' AS content_type, round((event_id % 100) / 100.0, 6) AS confidence, event_id % 40 AS first_start, 1 AS n_regions FROM events""")
def reply_parsing(spark, sf_dir):
    """Replies in a fence, with both spellings of a range and numbers as text."""
    e = F.col("event_id")
    s = lambda c: c.cast("string")
    region = F.when(e % 2 == 0, F.concat(F.lit('"lineRange": {"start": '), s(e % 40), F.lit(', "end": 90}'))).otherwise(F.concat(F.lit('"startLine": '), s(e % 40), F.lit(', "endLine": 90')))
    reply = F.concat(F.lit('Here it is:\n```json\n{"contentType": "academic", "confidence": "'), s((e % 100) / 100.0), F.lit('", "regions": [{"type": "index", '), region, F.lit(', "confidence": 0.9}, {"type": "broken"}]}\n```'))
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", replies.content_type(reply).alias("c"), replies.regions(reply).alias("r"))
    return d.select("event_id", "c.content_type", F.round("c.confidence", 6).alias("confidence"), F.get("r", 0)["start"].alias("first_start"), F.size("r").alias("n_regions"))


@query(r"""SELECT conv_id, turn, regexp_matches(l, 'stanza|verse|rhyme') AS poetry, regexp_matches(l, '"said|she said|he said|asked,') AS dialogue, regexp_matches(l, 'func |def |class |import |```') AS code, regexp_matches(l, 'abstract|methodology|bibliography|et al\.') AS academic,
CASE WHEN regexp_matches(l, 'abstract|methodology|bibliography|et al\.') THEN 'academic' WHEN regexp_matches(l, 'func |def |class |import |```|equation|theorem|proof') OR (contains(text, '=') AND contains(text, 'x')) THEN 'technical' WHEN regexp_matches(l, 'stanza|verse|rhyme') THEN 'poetry'
WHEN regexp_matches(l, '"said|she said|he said|asked,') THEN 'dialogue' WHEN (contains(l, 'picture') AND contains(l, 'story')) OR regexp_matches(l, 'bedtime|fairy tale') THEN 'childrens' ELSE 'prose' END AS primary_type
FROM (SELECT conv_id, turn, text, lower(text) AS l FROM (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN concat(text, ' the Abstract') WHEN 1 THEN concat('import ', text) WHEN 2 THEN concat(text, ' a Verse') WHEN 3 THEN concat(text, ' he said') WHEN 4 THEN concat('bedtime ', text) ELSE text END AS text FROM conversations))""")
def content_types(spark, sf_dir):
    """D13."""
    t = F.col("turn") % 6
    text = F.when(t == 0, F.concat("text", F.lit(" the Abstract"))).when(t == 1, F.concat(F.lit("import "), "text")).when(t == 2, F.concat("text", F.lit(" a Verse"))).when(t == 3, F.concat("text", F.lit(" he said"))).when(t == 4, F.concat(F.lit("bedtime "), "text")).otherwise(F.col("text"))
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", structure.content_flags(text).alias("f"))
    return d.select("conv_id", "turn", F.col("f.has_poetry").alias("poetry"), F.col("f.has_dialogue").alias("dialogue"), F.col("f.has_code").alias("code"), F.col("f.is_academic").alias("academic"), "f.primary_type")


@query(f"""WITH {WITH}, s AS (SELECT doc_id, list_transform(lines, lambda x: {TRIM.format('x')}) AS l FROM decorated)
SELECT doc_id, CAST({WORDS.format("array_to_string(l, chr(10))")} AS INT) AS words FROM s""")
def reflow_keeps_words(spark, sf_dir):
    """Joining lines keeps every word."""
    from ..functions.lines import count_words

    d = decorated(spark, sf_dir)
    return d.select("doc_id", count_words(structure.reflow(join_lines(F.transform("lines", trim)))["text"]).alias("words"))


def _lines_of(p: str) -> str:
    return f"list_filter(list_transform(string_split({p}, chr(10)), lambda y: {TRIM.format('y')}), lambda z: z <> '')"


def _verse(l: str) -> str:
    words = f"list_sum(list_transform({l}, lambda w: {WORDS.format('w')}))"
    return f"(len({l}) >= 3 AND len(list_filter({l}, lambda h: starts_with(h, '#'))) = 0 AND {words} / len({l}) < 12 AND len(list_filter({l}, lambda o: NOT regexp_matches(o, '[.!?]$'))) / len({l}) > 0.6)"


@query(f"""WITH d AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS t FROM documents), u AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS p FROM d), l AS (SELECT doc_id, p, {_lines_of('p')} AS l FROM u),
b AS (SELECT doc_id, CAST(sum(CASE WHEN len(l) = 0 THEN 0 WHEN {_verse('l')} THEN 0 ELSE len(list_filter(l[1 : len(l) - 1], lambda k: NOT regexp_matches(k, '[.!?"'']$'))) END) AS INT) AS breaks, CAST(count(*) FILTER (WHERE len(l) > 0) AS INT) AS paragraphs, CAST(count(*) FILTER (WHERE {WORDS.format('p')} >= 100) AS INT) AS long_paragraphs FROM l GROUP BY doc_id),
w AS (SELECT doc_id, {_lines_of('t')} AS l FROM d)
SELECT doc_id, breaks, paragraphs, long_paragraphs, len(l) > 0 AND {_verse('l')} AS poetry FROM b JOIN w USING (doc_id)""")
def reflow_breaks(spark, sf_dir):
    """Breaks removed, paragraphs, those that a rewriter would split, verse."""
    t = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("t", t)
    t = F.col("t")
    return d.select("doc_id", structure.reflow(t)["breaks"].alias("breaks"), structure.count_paragraphs(t).alias("paragraphs"), F.size(structure.long_paragraphs(t, 100)).alias("long_paragraphs"), F.coalesce(structure.is_poetry(t), F.lit(False)).alias("poetry"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 18 WHEN 1 THEN 22 ELSE 0 END AS metadata_length FROM documents""")
def existing_metadata(spark, sf_dir):
    """D15."""
    t = F.when(F.col("doc_id") % 3 == 0, "---\ntitle: One\n---\nbody").when(F.col("doc_id") % 3 == 1, "# Title\nauthor: A\nx: y\nbody text").otherwise("plain\ntext")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", structure.existing_metadata(t).alias("metadata_length"))
