"""Exact dedup by skew-safe combining.

Texts are equal when identical after each run of white space `[\\x20\\x09-\\x0D]+` became one
space.  Groups form in three steps, each of which compares whole texts and not only digests:
(1) Spark's partial aggregation merges equal texts inside a task, (2) the survivors of a digest
meet under one of `salts` salts, (3) the salt winners meet under the digest alone.  A text that
fills a third of the table therefore leaves each task as one row and reaches the last step as at
most `salts` rows.

Membership goes back to the rows through the digest.  A digest that stands for two different
texts (a collision) is told apart by joining on the text too.  Groups that hold at least one row
in `common.HOT_SHARE` are joined by broadcast: by that definition there are at most so many,
whatever the size of the table.

Defined results: a null text counts as empty; the smallest doc_id of a group stays; rows that
repeat a doc_id are rows of their own, counted in group_size, and are kept if that id is the one
that stays; a null doc_id is never the smallest unless its group has no other; an empty table
gives an empty result; other columns are ignored by `exact_groups`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, text_of, to_members

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest (binary)."""
    rows = text_of(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    # A task has one salt, so equal texts of a task leave it as one row.
    salted = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "norm").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size"))
    # Of each digest: one text as a rule.  The texts of colliding digests are carried on, others are dropped here.
    found = checkpointed(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")))
    plain, collided = found.filter("texts = 1").drop("texts"), found.filter("texts > 1").select("digest")
    ids = checkpointed(rows.select("doc_id", "digest"))  # hot and other digests are joined each on their own
    parts = [to_members(ids, plain, "digest", "group_size")]
    if collided.take(1):
        wide = groups.join(collided, "digest", "left_semi")
        parts.append(rows.join(collided, "digest", "left_semi").join(wide, ["digest", "norm"]).select(*parts[0].columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an earlier doc_id has; all columns stay.

    Rows that repeat a doc_id stay together if one of them stays; a null doc_id always stays.
    """
    return without(docs, exact_groups(docs, id_col, text_col).select("doc_id", "kept"), id_col)


def without(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the ids none of whose rows in marked (doc_id, kept) is kept."""
    gone = marked.groupBy(F.col("doc_id").alias("__gone_id")).agg(F.max("kept").alias("__kept")).filter(~F.col("__kept")).select("__gone_id")
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone_id"], "left_anti")
