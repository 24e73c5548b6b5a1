"""Event-log operators on streams: the same folds as the batch forms, with watermarks bounding the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.operators.retrieval import watch_score


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """An append-only Parquet log as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def access_counts(log: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``fact_id, start, n, agents``: accesses by tumbling window; events later than ``late`` are dropped with the window's state."""
    counted = log.withWatermark("created_at", late).groupBy("fact_id", F.window("created_at", window)).agg(F.count("*").alias("n"), F.approx_count_distinct("agent_id").alias("agents"))
    return counted.select("fact_id", F.col("window.start").alias("start"), "n", "agents")


def first_seen(memories: DataFrame, at: str = "imported_at", late: str = "5 minutes") -> DataFrame:
    """Memories without those whose content was seen within the watermark."""
    return memories.withColumn("content_hash", F.sha2("content", 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["content_hash"])


def watch_stream(memories: DataFrame, watches: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Standing queries (``watch_id, query``, or ``terms`` in the query's order; a bounded configuration table) against new memories: a stream-static join."""
    if "query" not in watches.columns:
        watches = watches.select("watch_id", F.array_join("terms", " ").alias("query"))
    scored = memories.select("id", "content").crossJoin(F.broadcast(watches)).select("watch_id", "id", F.round(watch_score(F.col("content"), F.col("query")), 6).alias("score"))
    return scored.where(F.col("score") >= threshold)
