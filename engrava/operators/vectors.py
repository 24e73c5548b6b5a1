"""An approximate vector index: random hyperplanes in several tables, with the nearest buckets probed and exact cosines for what they hold.

Every row is indexed, with one row for each table that says its bucket; one of these has its unit vector. A search hashes its queries, adds for each table the buckets that
differ in the bits whose hyperplanes lie closest, and joins; candidates are scored exactly, so a result's cosine is always right and only recall is approximate.
The bits grow with the logarithm of the rows, so buckets keep their size; ``recall`` measures against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrava.plans.storage import join_small, materialize

SEED, BUCKET = 2016, 1024
#: Vectors of a bucket and queries that meet in one task, and queries compared at once.
BLOCK, _ROWS = 4096, 256


class Index(NamedTuple):
    """``t, bucket, id, unit``, and the index's shape."""

    rows: DataFrame
    dim: int
    tables: int
    bits: int


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(tables, bits, dim))


def _units(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have one: of the right length, finite and not zero."""
    out, ok = np.zeros((len(vectors), dim)), np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v.is_valid and len(v.values) == dim and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            n = np.linalg.norm(x)
            if np.isfinite(n) and n > 0:
                out[k], ok[k] = x / n, True
    return out, ok


def _hashed(rows: DataFrame, dim: int, tables: int, bits: int, probes: int) -> DataFrame:
    """``t, bucket, id, unit``: for each vector its bucket in every table, and the next ``probes - 1``. Only one row of a vector has its unit vector."""
    schema = pa.schema([("t", pa.int32()), ("bucket", pa.int64()), ("id", pa.int64()), ("unit", pa.list_(pa.float64()))])
    near = min(bits, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, power = _planes(dim, tables, bits), 1 << np.arange(bits, dtype=np.int64)
        flips = [c for n in range(near + 1) for c in combinations(range(near), n)]
        for batch in batches:
            unit, ok = _units(batch.column("vector"), dim)
            unit, ids = unit[ok], batch.column("id").to_numpy(zero_copy_only=False)[ok]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * dim), pa.array(unit.reshape(-1)))
            nothing = pa.nulls(len(unit), values.type)
            for t in range(tables):
                side = unit @ planes[t].T
                own = (side > 0) @ power
                order = np.argsort(np.abs(side), axis=1)[:, :near]
                cost = np.stack([np.take_along_axis(np.abs(side), order[:, list(c)], 1).sum(1) if c else np.zeros(len(unit)) for c in flips], 1)
                for p, pick in enumerate(np.argsort(cost, axis=1, kind="stable")[:, :probes].T if len(unit) else []):
                    bucket = own.copy()
                    for k, which in enumerate(pick):
                        bucket[k] ^= power[order[k, list(flips[which])]].sum()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), pa.array(bucket), pa.array(ids, pa.int64()), nothing if t or p else values], schema=schema)

    return rows.select(F.col("id").cast("long"), "vector").mapInArrow(run, "t int, bucket long, id long, unit array<double>")


def index(rows: DataFrame, dim: int, tables: int = 16, bits: int | None = None) -> Index:
    """Index of ``id, vector``: every row with a vector of ``dim`` finite components that isn't zero. By default there are so many bits that a bucket holds about ``BUCKET`` rows."""
    bits = bits or max(1, math.ceil(math.log2(max(2, rows.count() / BUCKET))))
    return Index(materialize(_hashed(rows, dim, tables, bits, 1), "vector-index"), dim, tables, bits)


def search(found: Index, queries: DataFrame, k: int = 10, probes: int = 8, least: float = -1.0, block: int = BLOCK) -> DataFrame:
    """``query_id, id, cosine``: of each query (``id, vector``) the ``k`` closest of what its buckets hold, by exact cosine, itself left out; equal cosines by id.

    A bucket's vectors and its queries meet as two matrices in a task, in blocks of at most about ``block`` each, and only the ``k`` best of each query leave it: pairs are never shuffled.
    """
    asked = materialize(_hashed(queries, found.dim, found.tables, found.bits, probes), "vector-queries")
    unit = lambda rows: rows.where("unit IS NOT NULL").select("id", "unit").dropDuplicates(["id"])
    rows, asks = found.rows.select("t", "bucket", "id").distinct(), asked.select("t", "bucket", "id").distinct()
    blocks = lambda x: F.ceil(F.count("*") / block)
    shape = rows.groupBy("t", "bucket").agg(blocks(rows).alias("across")).join(asks.groupBy("t", "bucket").agg(blocks(asks).alias("down")), ["t", "bucket"])
    shape = materialize(shape, "vector-blocks")
    own, other = (lambda n: F.pmod(F.xxhash64("id"), F.col(n))), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    keys = ["t", "bucket", "x", "y"]
    a = join_small(asks, shape, ["t", "bucket"], "inner").withColumn("y", own("down")).withColumn("x", other("across")).select(*keys, "id").join(unit(asked), "id")
    b = join_small(rows, shape, ["t", "bucket"], "inner").withColumn("x", own("across")).withColumn("y", other("down")).select(*keys, "id").join(unit(found.rows), "id")
    dim = found.dim
    best = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda p, q: _closest(p, q, dim, k, least), "query_id long, id long, cosine double")
    best = best.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "cosine")


def _closest(asks: pa.Table, rows: pa.Table, dim: int, k: int, least: float) -> pa.Table:
    """Of each of ``asks`` the ``k`` best of ``rows`` (``id, unit``)."""
    matrix = lambda t: t.column("unit").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if asks.num_rows and rows.num_rows:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids)
        mine, ids, names, q = matrix(rows)[order], ids[order], asks.column("id").to_numpy(), matrix(asks)
        for lo in range(0, len(names), _ROWS):
            sim = np.round(q[lo : lo + _ROWS] @ mine.T, 9)
            sim[names[lo : lo + _ROWS, None] == ids] = -2
            floor = np.maximum(np.partition(sim, -k, axis=1)[:, -k], least) if len(ids) > k else np.full(len(sim), least)
            at, place = np.nonzero((sim >= floor[:, None]) & (sim > -2))
            value = sim[at, place]
            sort = np.lexsort((place, -value, at))
            at, place, value = at[sort], place[sort], value[sort]
            kept = np.arange(len(at)) - np.searchsorted(at, at) < k
            out.append((names[lo : lo + _ROWS][at[kept]], ids[place[kept]], value[kept]))
    columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0)] * 3
    return pa.table([pa.array(c.astype(x)) for c, x in zip(columns, ("int64", "int64", "float64"))], ["query_id", "id", "cosine"])


def brute(rows: DataFrame, queries: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """The same by comparing a stated query set with all rows, in blocks of matrix products; each block keeps its own ``k`` best."""
    asked, ok = _units(pa.array([r.vector for r in queries.select("vector").collect()], pa.list_(pa.float64())), dim)
    ids = np.array([r.id for r in queries.select("id").collect()], np.int64)[ok]
    asked = asked[ok]
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, good = _units(batch.column("vector"), dim)
            mine = batch.column("id").to_numpy(zero_copy_only=False)[good]
            sim = np.round(asked @ unit[good].T, 9)
            sim[ids[:, None] == mine[None]] = -2
            for q, row in zip(ids, sim):
                best = np.lexsort((mine, -row))[:k]
                best = best[row[best] > -2]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), q)), pa.array(mine[best], pa.int64()), pa.array(row[best])], schema=schema)

    every = rows.select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "cosine")


def recall(approximate: DataFrame, exact: DataFrame) -> float:
    """Share of the exact results that the approximate ones hold."""
    key = ["query_id", "id"]
    hit, every = exact.select(*key).join(approximate.select(*key), key, "left_semi").count(), exact.count()
    return hit / every if every else 1.0
