"""Folds by document id, and bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


#: Values that are sampled from, the commonest, and bytes of all texts of a sample.
VALUES, SAMPLE_BYTES = 1000, 64 << 20


def bounded_sample(rows: DataFrame, by: str, key: str, most: int, text: str | None = None, values: int = VALUES, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``most`` keys for each of the ``values`` commonest values of ``by``: those that hash lowest, so the choice doesn't depend on how rows lie. A key that comes
    again is one row, with the least of its other columns. With ``text``, a value's rows end where their texts pass its share of ``most_bytes``.

    A first pass counts the keys of each value; the second keeps the share by hash that holds ``most`` of them with some to spare, and one row of each, before anything is
    sorted, so a hot key or value is no task's burden.
    """
    counts = rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("rows"), F.approx_count_distinct(key, 0.02).alias("n")).orderBy(F.desc("rows"), by).limit(values).collect()
    if not counts:
        return rows.limit(0)
    rate = F.create_map(*[F.lit(x) for r in counts for x in (r[by], min(1.0, (1.3 * most + 50) / max(r.n, 1)))])
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.where(at < F.try_element_at(rate, F.col(by)))
    others = [F.min(c).alias(c) for c in rows.columns if c not in (by, key)]
    near = (near.groupBy(by, key).agg(*others) if others else near.distinct()).withColumn("_at", at)
    order = Window.partitionBy(by).orderBy("_at", key)
    near = near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    if text:
        near = near.withColumn("_size", F.sum(F.coalesce(F.octet_length(text), F.lit(0))).over(order)).where(F.col("_size") <= most_bytes // len(counts)).drop("_size")
    return near.select(*rows.columns)
