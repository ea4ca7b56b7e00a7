"""A session: a table of documents with their status, in order, of limited size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CAPACITY = 50
#: Columns of a session: id, seq, name, status, pages, cost, in_library, cleaned, text.
VIEWS = {
    "pending": "status = 'pending'",
    "active": "status IN ('validating', 'processing')",
    "completed": "status = 'completed'",
    "failed": "status = 'failed'",
    "library": "in_library",
    "awaiting_library": "status = 'completed' AND NOT in_library",
    "cleanable": "status = 'completed' AND NOT cleaned",
}


def view(session: DataFrame, name: str) -> DataFrame:
    return session.filter(VIEWS[name])


def badges(session: DataFrame) -> DataFrame:
    """One row with the size of each view."""
    return session.agg(*[F.count_if(F.expr(c)).alias(name) for name, c in VIEWS.items()])


def stage(in_library: Column, being_cleaned: Column, status: Column) -> Column:
    return F.when(in_library, "complete").when(being_cleaned, "processing").when(status.isin("pending", "failed", "cancelled"), "pending").otherwise("processing")


def search(session: DataFrame, query: str, in_text: bool = True) -> DataFrame:
    """Documents whose name (or text) holds the query, ignoring case; all of them for a blank one."""
    q = query.strip().lower()
    if not q:
        return session
    found = F.lower("name").contains(q)
    return session.filter(found | F.lower("text").contains(q) if in_text else found)


def ordered(session: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """By columns, each ascending or not; then by seq."""
    return session.orderBy(*[F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in keys], F.col("seq"))


def by_id(session: DataFrame, id_: str) -> DataFrame:
    return session.filter(F.col("id") == id_).orderBy("seq").limit(1)


def added(session: DataFrame, new: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The session with as many new documents, in their order, as it has room for."""
    room = max(0, capacity - session.count())
    first = session.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    taken = new.orderBy("seq").limit(room)  # the limit is the session's capacity
    return session.unionByName(taken.withColumn("seq", F.col("seq") + first))


def removed(session: DataFrame, ids: DataFrame) -> DataFrame:
    return session.join(ids.select("id"), "id", "left_anti")


def updated(session: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with the same id take the values that new has."""
    columns = [c for c in session.columns if c != "id"]
    other = new.select("id", *[F.col(c).alias(f"__{c}") for c in columns if c in new.columns])
    joined = session.join(other, "id", "left")
    return joined.select("id", *[(F.coalesce(f"__{c}", c) if c in new.columns else F.col(c)).alias(c) for c in columns])


def in_library(session: DataFrame, ids: Sequence[str], value: bool = True) -> DataFrame:
    return session.withColumn("in_library", F.when(F.col("id").isin(list(ids)), F.lit(value)).otherwise(F.col("in_library")))


def totals(session: DataFrame) -> DataFrame:
    """One row: pages, costs, and how many are processed, read but not cleaned, and cleaned."""
    return session.agg(
        F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(18,6)").alias("cost"), F.count_if(F.col("cost") > 0).alias("processed"),
        F.count_if((F.col("status") == "completed") & ~F.col("cleaned")).alias("read_only"), F.count_if(F.col("cleaned")).alias("cleaned_docs"),
    )


def latest(events: DataFrame, n: int, by: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last n events (the limit is the feature)."""
    return events.orderBy(F.desc(by), F.desc(tie)).limit(n)


def latest_per(events: DataFrame, key: str, n: int, by: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last n events of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), F.desc(tie)))
    return events.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
