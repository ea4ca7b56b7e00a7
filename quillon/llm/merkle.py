"""Document fingerprints: a Merkle tree over paragraphs and sections, in SQL functions only.

A text's paragraphs are its lines, and a section ends after each paragraph whose digest is divisible by
four, so sections too move only near edits.  Below a paragraph are leaves, runs of its words, cut by the
words themselves (by their last characters, by rarer ones in longer paragraphs, and after `LONGEST` characters without
such a word), so an edit moves no cut beyond the next such word.  A paragraph's digest covers its text, a section's
the digests of its paragraphs and leaves, and the root's those of the sections.

The fingerprint is the whole tree, `root:section;section;...` with `digest=paragraph,paragraph,...` for a
section and the digest followed by six digits for each leaf for a paragraph.  Roots test equality.
Two fingerprints are compared from the top: sections of one digest are done with, in the others paragraphs
are compared, and in paragraphs that differ leaves.  Likeness is the Dice coefficient of what is shared, in
leaves; it is exact but for equal digests of different leaves (one pair in 2^24), 1 for equal roots and `ALMOST` at most
for others.  `edited_range` walks down the branches that differ to the first and the last paragraph edited.

Defined results: null counts as empty; the empty text has one empty paragraph without leaves, and
is like only itself; the next document of a row is that of the next smaller doc_id, and rows that repeat a
doc_id (or have none, which sorts last) follow each other by a hash of their texts, those of equal texts too
having one next document; after the last comes the first; the smallest long counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lines import let
from .common import checkpointed, text_of

#: Patterns that cut a paragraph into leaves, each for paragraphs of fewer characters than stated.  A run of words ends
#: after a word that ends in anything but one of these letters, in any script.
CUTS = (
    (80, r"(?<=[^bcdfgijklmopqruvwxyzà-ÿ\s])\s+"),
    (400, r"(?<=[^abcdfghijklmnopqrtuvwxyzà-ÿ\s])\s+"),
    (1 << 31, r"(?<=[^abcdefghijklmnopqrtuvwxyzà-ÿ\s])\s+"),
)
#: A longer run is cut after so many characters all the same, and again from there (up to the first character beyond U+FFFF).
LONGEST = 120
DIGITS = 12
LEAF = 6
ALMOST = 0.9999
LOWEST = -(1 << 63)


def _hex(digest: Column, digits: int) -> Column:
    return F.right(F.lpad(F.hex(digest), 16, "0"), F.lit(digits))


def _paragraph(p: Column) -> Column:
    cut = lambda pattern: F.split(p, rf"{pattern}|(?<=\G[\s\S]{{{LONGEST}}})", -1)
    runs = cut(CUTS[-1][1])
    for most, pattern in reversed(CUTS[:-1]):
        runs = F.when(F.length(p) < most, cut(pattern)).otherwise(runs)
    leaves = F.transform(F.filter(runs, lambda r: r != ""), lambda r: _hex(F.xxhash64(r), LEAF))
    return F.concat(_hex(F.xxhash64(p), DIGITS), F.array_join(leaves, ""), F.when(F.pmod(F.xxhash64(p), F.lit(4)) == 0, ";").otherwise(","))


def tree(text: Column) -> Column:
    """A struct of root and sections, each as in the fingerprint."""
    joined = F.array_join(F.transform(F.split(text, "\n", -1), _paragraph), "")
    marked = F.split(F.regexp_replace(joined, "[,;]$", ""), ";", -1)
    sections = F.transform(marked, lambda s: F.concat(_hex(F.xxhash64(F.rtrim(s, F.lit(","))), DIGITS), F.lit("="), F.rtrim(s, F.lit(","))))
    return let(lambda s: F.struct(F.substring(F.sha2(F.array_join(s, ";"), 256), 1, 16).alias("root"), s.alias("sections")), sections)


def shown(t: Column) -> Column:
    """The fingerprint string of a tree."""
    return F.lower(F.concat_ws(":", t["root"], F.array_join(t["sections"], ";")))


def _paragraphs(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(F.substring(s, F.lit(DIGITS + 2), F.length(s)), ",", -1)))


def _leaves(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substring(p, F.lit(DIGITS + 1), F.length(p)), F.lit(f".{{{LEAF}}}"), F.lit(0))))


def _weight(paragraphs: Column) -> Column:
    """The number of leaves of paragraphs."""
    return F.aggregate(paragraphs, F.lit(0.0), lambda n, p: n + (F.length(p) - DIGITS) / LEAF)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two trees."""

    def below(x: Column, y: Column, done: Column) -> Column:
        """x and y: the paragraphs of sections that differ; done: leaves of the others."""
        own, other = F.array_distinct(_leaves(F.array_except(x, y))), F.array_distinct(_leaves(F.array_except(y, x)))
        counted = lambda p, q, n: F.when(2 * n + F.size(p) + F.size(q) == 0, 0.0).otherwise(2 * (n + F.size(F.array_intersect(p, q))) / (2 * n + F.size(p) + F.size(q)))
        return let(counted, own, other, done + _weight(F.array_intersect(x, y)))

    def compare(x: Column, y: Column) -> Column:
        return let(below, _paragraphs(F.array_except(x, y)), _paragraphs(F.array_except(y, x)), _weight(F.array_distinct(_paragraphs(F.array_intersect(x, y)))))

    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.least(let(compare, a["sections"], b["sections"]), F.lit(ALMOST)))


def _alike(x: Column, y: Column) -> Column:
    """How many of the first elements of two arrays are equal."""
    differing = F.array_position(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differing > 0, differing - 1).otherwise(F.least(F.size(x), F.size(y))).cast("int")


def _between(x: Column, y: Column, found) -> Column:
    """found(n, x', y') with what two arrays have between their n first equal elements and their last equal ones."""

    def cut(x: Column, y: Column, n: Column) -> Column:
        rest = lambda a: F.slice(a, n + 1, F.size(a) - n)
        inner = lambda p, q: let(lambda p, q, k: found(n, F.slice(p, F.lit(1), F.size(p) - k), F.slice(q, F.lit(1), F.size(q) - k)), p, q, _alike(F.reverse(p), F.reverse(q)))
        return let(inner, rest(x), rest(y))

    return let(lambda x, y: let(cut, x, y, _alike(x, y)), x, y)


def edited_range(a: Column, b: Column) -> Column:
    """A struct (first, last) of the paragraphs (from 0) of b that stand between what both trees begin and end with; null for equal roots.

    Where paragraphs were only left out, last is first - 1.
    """
    n_of = lambda sections: F.size(_paragraphs(sections))

    def paragraphs(n: Column, x: Column, y: Column) -> Column:
        before = n_of(F.slice(b["sections"], F.lit(1), n))
        ends = lambda k, p, q: F.struct((before + k).cast("int").alias("first"), (before + k + F.size(q) - 1).cast("int").alias("last"))
        return _between(_paragraphs(x), _paragraphs(y), ends)

    return F.when(a["root"] != b["root"], _between(a["sections"], b["sections"], paragraphs))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint."""
    return text_of(docs, id_col, text_col).withColumn("__t", tree(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n_chars"), shown(F.col("__t")).alias("fingerprint"))


def next_keys(keys: DataFrame, parts: int) -> DataFrame:
    """(key, sub, next_key, next_sub) for the distinct (key, sub): the next smaller pair, the largest after the smallest.

    Ranges of keys are ordered each on its own; only the ends of the ranges, one row each, meet in one place.
    """
    at = F.struct("key", "sub")
    ranges = checkpointed(keys.distinct().repartitionByRange(parts, F.desc("key"), F.desc("sub")).withColumn("part", F.spark_partition_id()))
    ends = ranges.groupBy("part").agg(F.max(at).alias("first"))
    following = ends.select("part", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("follows"), F.max("first").over(Window.partitionBy(F.lit(0))).alias("top"))
    inner = ranges.withColumn("next", F.lead(at).over(Window.partitionBy("part").orderBy(F.desc("key"), F.desc("sub"))))
    return inner.join(following, "part").withColumn("n", F.coalesce("next", "follows", "top")).select("key", "sub", F.col("n.key").alias("next_key"), F.col("n.sub").alias("next_sub"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_chars, edited, own (tree), next_tree: each document beside its edited text and the next document's tree.

    The edited text: the last third of the code points replaced by as many (or all) of the next
    document's first ones.  Texts are dealt by key once; a document sends its neighbour its tree and no more than the
    beginning that is asked for.  Its tree is made where it is sent and again where it stays, as a tree is too long to
    travel with each text (disk at 30 GB: 2.90 x input with it).
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4)
    pair = ["key", "sub"]
    keyed = text_of(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("key"), F.xxhash64("text").alias("sub"), "text")
    chain = checkpointed(next_keys(keyed.select(*pair), parts))
    rows = keyed.repartition(parts, *pair)  # the one exchange of whole texts, which both sides below share, as they need the same columns
    asked = keyed.groupBy(*pair).agg(F.max(F.floor(F.length("text") / 3)).alias("third")).join(chain, pair)
    giving = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("text")))).filter("nth = 1")
    wanted = asked.select(F.col("next_key").alias("key"), F.col("next_sub").alias("sub"), F.col("key").alias("asker"), F.col("sub").alias("asker_sub"), "third")
    sent = giving.join(wanted, pair).select(F.col("asker").alias("key"), F.col("asker_sub").alias("sub"), F.expr("substring(text, 1, cast(third as int))").alias("begins"), tree(F.col("text")).alias("next_tree"))
    met = rows.join(sent, pair)
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    return met.select(F.when(F.col("key") != LOWEST, F.col("key")).alias("doc_id"), "text", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("begins"), F.lit(1), third)).alias("edited"), tree(F.col("text")).alias("own"), "next_tree")
