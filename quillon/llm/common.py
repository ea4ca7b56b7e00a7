"""What the training-data operators share: reading tables, checkpoints, splitting work."""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows of a batch that are turned into Python objects at a time.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches):
    """Batches of at most ARROW_ROWS rows; Spark bounds their bytes."""
    for b in batches:
        for at in range(0, b.num_rows, ARROW_ROWS):
            yield b.slice(at, ARROW_ROWS)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it names none, one of our own is made on a single machine only; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def released(spark: SparkSession):
    """What is planned and run in here leaves no shuffle files, once it has run.

    Otherwise they stay until the driver collects its garbage, which many short steps don't make it do.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the reliable checkpoint folder and reads it from there; the shuffle files that it took are deleted."""
    checkpoint_folder(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, as Spark looks at the setting when it plans


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept_rows(docs: DataFrame, text_col: str, make_test) -> DataFrame:
    """The rows whose text (null: None) passes; make_test() gives the test on the executor.  No column is touched."""
    at = docs.columns.index(text_col)

    def run(batches):
        test = make_test()
        for b in small(batches):
            yield b.filter(pa.array([test(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns can't clash any more."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: A class that holds at least one row in so many is hot; there can't be more hot classes than this.
HOT_SHARE = 1000


def to_members(rows: DataFrame, classes: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with the (checkpointed) classes on key, whatever share of the rows a class holds.

    Hot classes, by their definition HOT_SHARE at most, are broadcast; their rows stay where they
    are, and only the others are dealt by key.
    """
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    least = max(2, -(-total // HOT_SHARE))
    hot, rest = classes.filter(F.col(size) >= least), classes.filter(F.col(size) < least)
    cool = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return rows.join(F.broadcast(hot), key).unionByName(cool)


#: Rows of one key up to which they meet one copy of what is joined to them.
SPREAD = 1000


def spread_join(rows: DataFrame, wide: DataFrame, key: str, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with the one row of wide that has their key; a hot key gets a copy of it for every so many of its rows.

    counted: a (checkpointed) table of the same keys, as it is read more than once; rows by default.  Hot are keys with over SPREAD rows and a share of 1 / HOT_SHARE, so HOT_SHARE at most; they are broadcast.
    """
    counted = rows if counted is None else counted
    least = max(SPREAD, -(-counted.count() // HOT_SHARE))
    many = F.broadcast(counted.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / least).alias("__copies")).filter("__copies > 1"))
    dealt = rows.join(many, key, "left").withColumn("__copy", F.pmod(F.xxhash64(*counted.columns), F.coalesce("__copies", F.lit(1).cast("long")))).drop("__copies")
    each = wide.join(many, key, "left").withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__copies", F.lit(1).cast("long")) - 1))).drop("__copies")
    return dealt.join(each, [key, "__copy"]).drop("__copy")
