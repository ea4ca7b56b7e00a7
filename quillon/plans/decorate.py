"""Documents with the structure that the cleaning rules look for, the same in Spark and in SQL.

By doc_id % 8: page numbers, running lines, front matter, contents, back matter, an index, lists,
citations and broken characters are added to a document's own lines, repeated to 60 at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TOC = ", ".join(f"'Chapter {k} of this book  ..... {3 * k}'" for k in range(1, 13))
_INDEX = ", ".join(f"'term, {k}'" for k in range(1, 41))
_NOTE = "'# NOTES', '1. See the first source', '2. Cf. pp. 12', '', '# BIBLIOGRAPHY', 'Smith, J. (2020). A title. Example Press.', 'Jones, A. (2019). More. Example Press.'"
_LISTS = "'LIST OF FIGURES', 'Figure 1 One ..... 3', 'Figure 2 Two ..... 5', 'Figure 3 Three ..... 9', '', 'LIST OF TABLES', 'Table 1 One ..... 4', 'Table 2 Two ..... 6', '', 'ABC - Alpha Beta Gamma', 'DEF - Delta Epsilon', 'GHI - Gamma Iota', ''"
_MARKS = "'As shown (Smith, 2020) before', 'a plain line [1] here', 'value 3.14 and doi: 10.1234/abc.5 stay', 'the ﬁrst oﬃce‌ word “quoted” ‘so’', 'cafÃ© and â€œx â€¢ y', '| a | b |', '| --- | --- |', '| 1 | 2 |', '```', 'let x = 1', '```', '## Part I', '# Chapter 1: Begin', '# Chapter 2', 'end *it* now'"


def _sql(number: str, string: str, fn: str, div: str) -> str:
    """The CASE of the variants; number, string, fn and div are the dialect's spellings."""
    page = f"CASE ({div}) % 4 WHEN 0 THEN {number} WHEN 1 THEN concat('- ', {number}, ' -') WHEN 2 THEN concat('Page ', {number}) ELSE 'xvii' END"
    return f"""CASE doc_id % 8
      WHEN 0 THEN flatten({fn.format(f"CASE WHEN i % 7 = 6 THEN {string.format('b[@i], ' + page)} ELSE {string.format('b[@i]')} END")})
      WHEN 1 THEN flatten({fn.format(f"CASE WHEN i % 10 = 0 THEN {string.format("'THE GREAT BOOK', b[@i]")} ELSE {string.format('b[@i]')} END")})
      WHEN 2 THEN @concat({string.format("'Some Title', '© 2024 Example House', 'Copyright © 2024 by A. Writer', 'All rights reserved', 'ISBN: 978-1-23', '', '# Chapter 1'")}, b)
      WHEN 3 THEN @concat({string.format(f"'Some Title', '', '## TABLE OF CONTENTS', {_TOC}, '', '# Chapter 1'")}, b)
      WHEN 4 THEN @concat(@concat(@head, {string.format(_NOTE)}), @tail)
      WHEN 5 THEN @concat(CASE WHEN doc_id % 16 = 13 THEN b ELSE @concat(b, {string.format("'# INDEX'")}) END, {string.format(_INDEX)})
      WHEN 6 THEN @concat({string.format(_LISTS)}, b)
      ELSE @concat(b, {string.format(_MARKS)}) END"""


_AT = "CASE WHEN doc_id % 16 = 12 THEN 6 ELSE CAST(m * 7 / 10 AS INT) END"

SPARK = (
    _sql("CAST(i div 7 + 1 AS STRING)", "array({})", "transform(b, (x, i) -> {})", "i div 7")
    .replace("b[@i]", "x").replace("@concat", "concat").replace("@head", f"slice(b, 1, {_AT})").replace("@tail", f"slice(b, {_AT} + 1, m)")
)
DUCK = (
    _sql("CAST(i // 7 + 1 AS VARCHAR)", "[{}]", "list_transform(range(0, m), lambda i: {})", "i // 7")
    .replace("b[@i]", "b[i + 1]").replace("@concat", "list_concat").replace("@head", f"b[1:{_AT}]").replace("@tail", f"b[({_AT}) + 1:]").replace("m * 7 / 10", "m * 7 // 10")
)
SPARK = SPARK.replace("CAST(m * 7 / 10 AS INT)", "CAST(m * 7 div 10 AS INT)")

#: Common table expressions: decorated(doc_id, lang, variant, lines).
WITH = f"""base AS (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
padded AS (SELECT doc_id, lang, greatest(60, len(own)) AS m, list_transform(range(0, greatest(60, len(own))), lambda i: own[(i % len(own)) + 1]) AS b FROM base),
decorated AS (SELECT doc_id, lang, doc_id % 8 AS variant, {DUCK} AS lines FROM padded)"""


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "lang", "split(coalesce(text, ''), '\\n', -1) AS own")
    cores = spark.sparkContext.defaultParallelism
    if docs._jdf.queryExecution().toRdd().getNumPartitions() < cores:  # a small table's single file would keep one core busy
        docs = docs.repartition(cores, "doc_id")
    padded = docs.selectExpr("doc_id", "lang", "greatest(60, size(own)) AS m", "slice(flatten(array_repeat(own, cast(ceil(60 / size(own)) as int))), 1, greatest(60, size(own))) AS b")
    return padded.selectExpr("doc_id", "lang", "doc_id % 8 AS variant", f"{SPARK} AS lines")
