"""The queries of the training-data operators and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_components

    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack, token_pieces

    return pack(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sentencepiece_fst import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, learn, score

    docs = table(spark, sf_dir, "documents")
    grammar = learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    found = score(docs, grammar)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", F.size("clauses").alias("n_clauses"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import edited, edited_range, likeness, shown, tree

    own, new, after = F.col("own"), F.col("new"), F.col("next_tree")
    rows = edited(table(spark, sf_dir, "documents")).withColumn("new", tree(F.col("edited")))
    rows = rows.withColumn("range", edited_range(own, new))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), shown(own).alias("fingerprint"), shown(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, after).alias("near_next"), F.col("range.first").alias("first_edited_paragraph"), F.col("range.last").alias("last_edited_paragraph"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op4_url_filter alone say, for comparison with SQL."""
    from .url_filter import prepared

    return prepared(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.col("rule_verdict").alias("verdict"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of base phrases that op8_licenses finds, for comparison with SQL."""
    from .licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that op9_fingerprints compares, for comparison with SQL."""
    from .merkle import edited

    return edited(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP7_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_RULES_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
f AS (SELECT *, '.' || host AS dotted FROM s),
g AS (SELECT page_id, host, path, CASE WHEN dotted LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN dotted LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN dotted LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN dotted LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM g
"""

LICENSE_BASE_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x FROM documents),
p AS (SELECT doc_id, len(x) AS n_words, list_filter(range(0, len(x)), lambda i: x[i + 1] = 'cc' AND x[i + 2] = 'by') AS cc,
  list_filter(range(0, len(x)), lambda i: x[i + 1] = 'general' AND x[i + 2] = 'public' AND x[i + 3] = 'license') AS gpl,
  list_filter(range(0, len(x)), lambda i: x[i + 1] = 'all' AND x[i + 2] = 'rights' AND x[i + 3] = 'reserved') AS res FROM w)
SELECT doc_id, n_words, len(cc) + len(gpl) + len(res) AS n_base, list_min(list_concat(cc, list_concat(gpl, res))) AS first_word, list_max(list_concat(cc, list_concat(gpl, res))) AS last_word,
  array_to_string(list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(res) > 0 THEN 'reserved' END], lambda y: y IS NOT NULL), ',') AS base_labels FROM p
"""

EDITED_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, length(t) // 3 AS k, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM t)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - k) || substr(after, 1, k)) AS edited_sha256 FROM n
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_simhash, op2_packing, op3_sentencepiece, op4_url_filter, op5_toxicity, op6_html_text, op7_exact_dedup, op8_licenses, op9_fingerprints, op10_language, pipeline, url_rules, license_base, edited_texts)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "url_rules": URL_RULES_SQL, "license_base": LICENSE_BASE_SQL, "edited_texts": EDITED_SQL}
