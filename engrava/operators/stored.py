"""Keyword and vector indexes that outlive a session: appended to, deleted from, compacted and reopened.

Rows that are appended replace those of the same ids. What a search reads is the same ``Index`` that ``keyword.index`` and ``vectors.index`` make, over the live rows of all
segments; a stored index answers as one made anew from the rows it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.functions import text as T
from engrava.operators import keyword, vectors
from engrava.operators.keyword import buckets_for
from engrava.plans import versions
from engrava.plans.storage import materialize, scratch
from engrava.plans.versions import Version

def _replaced(spark: SparkSession, old: Version, ids: DataFrame) -> DataFrame:
    """``id`` of those that the index holds."""
    held = versions.live(spark, old, "texts")
    return ids.select("id").distinct().join(held.select("id"), "id", "left_semi") if held is not None else ids.select("id").limit(0)


def create_keyword(spark: SparkSession, path: str, texts: int = 0) -> Version:
    """An empty index; ``texts`` is about how many it will hold."""
    return versions.create(spark, path, {"kind": "keyword", "buckets": buckets_for(texts)})


def append_keyword(old: Version, rows: DataFrame) -> Version:
    """``id, content``: new rows, and new contents of known ids. A text without a word is held, and never found by words."""
    spark = rows.sparkSession
    with scratch(spark):
        words = materialize(rows.select("id", T.tokens(F.coalesce("content", F.lit(""))).alias("w")), "words")
        postings = keyword.postings_of(words, old.meta["buckets"], 16)
        tables = {"postings": postings, "texts": words.select("id", F.size("w").alias("length")), "dead": materialize(_replaced(spark, old, words), "replaced")}
        return versions.add(spark, old, tables, {"postings": ["bucket"]})


def delete(old: Version, ids: DataFrame) -> Version:
    """Without the rows of ``id``, of an index of either kind; unknown ids are passed over."""
    spark = ids.sparkSession
    with scratch(spark):
        return versions.add(spark, old, {"dead": materialize(_replaced(spark, old, ids), "deleted")})


def open_keyword(spark: SparkSession, path: str, number: int | None = None) -> keyword.Index:
    """What ``keyword.search`` and ``search_all`` read, of the latest version or of one by its number."""
    version = versions.open_version(spark, path, number)
    texts, postings = versions.live(spark, version, "texts"), versions.live(spark, version, "postings")
    if texts is None:
        postings = spark.createDataFrame([], "id long, length int, term string, tf long, bucket int")
        texts = postings.select("id", "length")
    totals = texts.agg(F.count("*").alias("docs"), F.avg("length").alias("average"))
    return keyword.Index(postings, totals, version.meta["buckets"])


def compact_keyword(spark: SparkSession, old: Version) -> Version:
    """One segment of the live rows, in as many buckets as their number now asks for."""
    texts, postings = versions.live(spark, old, "texts"), versions.live(spark, old, "postings")
    if texts is None:
        return old
    buckets = buckets_for(texts.count())
    moved = postings.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int"))
    return versions.add(spark, old, {"postings": moved.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16))), "texts": texts}, {"postings": ["bucket"]}, alone=True, meta={"buckets": buckets})


def create_vectors(spark: SparkSession, path: str, dim: int, rows: int = 0, tables: int = 16) -> Version:
    """An empty index of vectors of ``dim`` components; ``rows`` is about how many it will hold."""
    return versions.create(spark, path, {"kind": "vectors", "dim": dim, "tables": tables, "bits": _bits(rows)})


def _bits(rows: int) -> int:
    return max(1, math.ceil(math.log2(max(2, rows / vectors.BUCKET))))


def append_vectors(old: Version, rows: DataFrame) -> Version:
    """``id, vector``: new rows, and new vectors of known ids. A vector that can't be indexed only takes the old one away."""
    spark, m = rows.sparkSession, old.meta
    with scratch(spark):
        ids = materialize(rows.select("id"), "vector-ids")
        hashed = vectors._hashed(rows, m["dim"], m["tables"], m["bits"], 1)
        return versions.add(spark, old, {"rows": hashed, "texts": ids, "dead": materialize(_replaced(spark, old, ids), "replaced")})


def open_vectors(spark: SparkSession, path: str, number: int | None = None) -> vectors.Index:
    """What ``vectors.search`` reads."""
    version = versions.open_version(spark, path, number)
    rows, m = versions.live(spark, version, "rows"), version.meta
    if rows is None:
        rows = spark.createDataFrame([], "t int, bucket long, id long, unit array<double>")
    return vectors.Index(rows, m["dim"], m["tables"], m["bits"])


def compact_vectors(spark: SparkSession, old: Version) -> Version:
    """One segment of the live rows, hashed with as many bits as their number asks for."""
    rows, m = versions.live(spark, old, "rows"), old.meta
    if rows is None:
        return old
    units = rows.where("unit IS NOT NULL").select("id", F.col("unit").alias("vector"))
    bits = _bits(units.count())
    return versions.add(spark, old, {"rows": vectors._hashed(units, m["dim"], m["tables"], bits, 1), "texts": versions.live(spark, old, "texts")}, alone=True, meta={"bits": bits})
