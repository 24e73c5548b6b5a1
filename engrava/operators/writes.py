"""Writes as new versions of tables: what a table holds after rows are added, changed or deleted.

Each function takes tables and gives the table after the write, to be written as a new version (or merged, where the store can): Spark's tables have no update in place. Keys are
joined, never collected; a write of a few rows is broadcast by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrava.functions import text as T
from engrava.plans import ranks


def added(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table and those new rows whose key it doesn't hold; of new rows with one key the first by their whole row."""
    cols = table.columns
    first = new.groupBy(*key).agg(F.min(F.struct(*cols)).alias("_r")).select("_r.*")
    return table.unionByName(first.join(table.select(*key), key, "left_anti"))


def add_memories(table: DataFrame, new: DataFrame) -> DataFrame:
    """New memories by the hash of their path and content; equal ones are stored once."""
    hashed = lambda df: df.withColumn("content_hash", T.hash_with_path(F.col("content"), F.col("source_file")))
    return added(hashed(table), hashed(new), ["content_hash"])


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the columns that ``changes`` has for their key; a key that the table lacks changes nothing. One change for each key."""
    columns = [c for c in changes.columns if c != key]
    renamed = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def with_value(table: DataFrame, ids: DataFrame, column: str, value: Column, key: str = "id") -> DataFrame:
    """Rows among ``ids`` with a new value in one column: states, types, confidences (between 0 and 1), acknowledgements."""
    return updated(table, ids.select(key, value.alias(column)), key)


def soft_deleted(table: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Rows among ``ids`` marked as deleted at an instant; those that are already keep theirs."""
    joined = table.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    return joined.withColumn("deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("deleted_at"))).select(*table.columns)


def deleted_by(table: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The table without the rows whose column is among ``values``."""
    return table.join(values.select(F.col(values.columns[0]).alias("_gone")), F.col(column) == F.col("_gone"), "left_anti")


def numbered(table: DataFrame, new: DataFrame, id_: str = "id") -> DataFrame:
    """The table and new rows (events, ledger entries, accesses) with the ids after its highest, without a gap, in the order in which they lie."""
    highest = table.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_max"))
    rows = ranks.numbered(new, "_place").crossJoin(F.broadcast(highest))
    return table.unionByName(rows.withColumn(id_, (F.col("_max") + 1 + F.col("_place")).cast("long")).select(*table.columns))


def counted(counters: DataFrame, deltas: DataFrame) -> DataFrame:
    """``key, value``: counters after what is added to them; a counter that wasn't there starts at 0."""
    return counters.select("key", "value").unionByName(deltas.select("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))


def reinforced(table: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Facts among ``ids`` reinforced at an instant, unless they were later."""
    joined = table.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    return joined.withColumn("last_reinforced", F.when(F.col("_hit"), F.greatest("last_reinforced", F.lit(at).cast("timestamp_ntz"))).otherwise(F.col("last_reinforced"))).select(*table.columns)
