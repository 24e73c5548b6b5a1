"""Timelines of a subject: buckets and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_start(at: Column, bucket: str) -> Column:
    """The day, the Monday, or the first of the month."""
    return F.date_trunc({"day": "DAY", "week": "WEEK", "month": "MONTH"}[bucket], at).cast("date")


def buckets(rows: DataFrame, bucket: str) -> DataFrame:
    """``subject, start, n, avg_confidence``."""
    return rows.groupBy("subject", bucket_start(F.col("created_at"), bucket).alias("start")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 12).alias("avg_confidence"))


def transitions(rows: DataFrame, step: float = 0.05) -> DataFrame:
    """``id, transition``: how each fact follows the one before it on its subject and predicate.

    Superseded if it was; else contradicted if the object differs, refined or decayed if the confidence rose or fell by the step.
    """
    w = Window.partitionBy("subject", "predicate").orderBy("created_at", "id")
    delta = F.col("confidence") - F.lag("confidence").over(w)
    before = F.lag("object").over(w)
    kind = F.when(before.isNull(), "first").when(F.col("superseded_by").isNotNull(), "superseded").when(before != F.col("object"), "contradicted").when(delta > step, "refined").when(delta < -step, "decayed").otherwise("expanded")
    return rows.select("id", kind.alias("transition"))


def subject_window(rows: DataFrame) -> DataFrame:
    return rows.groupBy("subject").agg(F.count("*").alias("n"), F.min("created_at").cast("date").alias("first"), F.max("created_at").cast("date").alias("last"))


def top_per_subject(rows: DataFrame, most: int = 6) -> DataFrame:
    """``subject, id, rank``: the most confident facts of each subject."""
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("confidence"), F.desc("id")))
    return rows.select("subject", "id", rank.alias("rank")).where(F.col("rank") <= most)
