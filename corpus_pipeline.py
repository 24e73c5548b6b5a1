"""A corpus pipeline: documents in, packed training sequences out.

``STAGES`` are ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``docs``, whatever these are named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.language import fit_language, like_language
from engrava.llm.mixing import mixed_documents
from engrava.llm.packing import pack_documents
from engrava.llm.quality import THRESHOLD, fit_quality, predict_quality
from engrava.llm.simhash import dedup_documents
from engrava.plans.shipping import ship
from engrava.plans.storage import materialize


def _keep(docs: DataFrame, value: Callable[[Column], Column], holds: Callable[[Column], Column]) -> DataFrame:
    """``docs`` where what ``value`` makes of the text ``holds``; columns may have any names."""
    cols = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(cols))])
    kept = inner.withColumn("v", value(F.col(f"c{cols.index('text')}"))).where(holds(F.col("v")))
    return kept.drop("v").toDF(*cols)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and such as are like no language of the sample. Without a sample nothing is known, and only the first two go."""
    ship(spark)
    model = fit_language(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return _keep(docs, lambda text: like_language(model, text), lambda v: v)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what scores below the threshold; learns from the labels of the documents that are left.

    A null text is scored as an empty one; repeated rows fare alike; without labels all score 0.5 and stay. An empty table gives no rows.
    """
    ship(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _keep(docs, lambda text: predict_quality(model, text), lambda v: v >= THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the smallest doc_id; nulls come last.

    Null and empty texts are one group, repeated rows another each; of rows with one doc_id the first in the input stays. An empty table gives no rows.
    """
    ship(spark)
    return dedup_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0, 1 or 2.

    Null and empty texts have no words and are never taken; a null source is a source, the last; of repeated rows as many are taken whichever. An empty
    table gives no rows.
    """
    return mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of the packed mix.

    A null text counts as empty and is one piece, the end id; null doc_ids and repeated rows are packed like any other. An empty table gives no rows.
    """
    ship(spark)
    return pack_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("sequences", sequences)]
#: SQL can't express the learned stages; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
