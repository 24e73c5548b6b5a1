"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is rotated three times by random signs and a Walsh-Hadamard transform; its hash is the axis, with sign, that it then lies closest
to (Andoni et al., 2015). Each of ``L`` tables takes ``k`` such hashes; a vector lies in its own bucket of a table and is looked up in the next closest
ones, too. Whatever meets in a bucket is verified by its cosine in double precision. ``k`` grows with the logarithm of the number of
vectors, so buckets keep their size, and ``L`` follows from how often simulated pairs at the threshold meet.

Equal vectors are one class with a count, so copies are never paired. Pairs are never emitted: a task adds up each vector's links and
keeps a forest of them. A bucket of more than ``BLOCK`` vectors is dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.workers import tidied
from engrava.operators.graph import connected_components
from engrava.plans.storage import join_small, materialize

THRESHOLD, MISSED = 0.95, 1e-5
PROBES, NEXT, BUCKET, BLOCK = 4, 4, 4096, 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


@lru_cache(maxsize=64)
def _signs(width: int, tables: int, k: int) -> np.ndarray:
    return np.random.default_rng(20150909).choice([-1.0, 1.0], (tables, k, 3, width))


def codes(x: np.ndarray, tables: int, k: int, probes: int = PROBES) -> np.ndarray:
    """For each row its buckets, shape (rows, tables, probes); the first of each table is its own."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    keep = min(NEXT, 2 * width)
    picks = np.array(list(product(range(keep), repeat=k)))
    out = np.zeros((len(x), tables, probes), np.int64)
    for t in range(tables):
        loss, code = np.zeros((len(x), len(picks))), np.zeros((len(x), len(picks)), np.int64)
        for j in range(k):
            r = x
            for s in _signs(width, tables, k)[t, j]:
                r = _hadamard(r * s)
            both = np.concatenate([r, -r], 1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :keep]
            value = np.take_along_axis(both, order, 1)
            loss += ((value[:, :1] - value) ** 2)[:, picks[:, j]]
            code = code * (2 * width) + order[:, picks[:, j]]
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(code, best, 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]
    return out


def code_type(dim: int, k: int) -> np.dtype:
    """The narrowest type that holds the codes of vectors of this length."""
    return np.min_scalar_type((2 << max(1, (dim - 1).bit_length())) ** k - 1)


@lru_cache(maxsize=64)
def plan_tables(n: int, dim: int, threshold: float = THRESHOLD, missed: float = MISSED) -> tuple[int, int]:
    """``(L, k)`` for ``n`` vectors: about ``BUCKET`` to a bucket were they spread evenly, and a pair at the threshold missed with probability ``missed``."""
    k = max(1, math.ceil(math.log(max(1, n / BUCKET)) / math.log(2 << max(1, (dim - 1).bit_length()))))
    if dim < 2:
        return 1, k
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 4000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1)[:, None], 1e-300)
    ca, cb = (codes(v, 1, k)[:, 0] for v in (a, threshold * a + math.sqrt(1 - threshold**2) * b))
    meet = ((ca[:, :1] == cb).any(1) | (cb[:, :1] == ca).any(1)).mean()
    return max(1, math.ceil(math.log(missed) / math.log(max(1e-9, 1 - min(meet, 1 - 1e-9))))), k


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _valid(vectors: pa.Array, kind: str) -> list[bytes | None]:
    """Each vector's components as bytes; None for null and zero vectors and such with null or non-finite components."""
    out = []
    for v in vectors:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(kind)
            x = (x + 0.0).tobytes() if np.isfinite(x).all() and x.any() else None
        out.append(x)
    return out


def _links(run: dict[str, np.ndarray | int], x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Links that a bucket's members are the first place to show: members' numbers in pairs, in any order of the members. Of a pair at least one has this
    bucket as its own."""
    base, code, t, blk, node = run["base"], run["codes"], run["t"], run["blk"], run["node"]
    own_here, found = np.flatnonzero(base), []
    for lo in range(0, len(own_here), 256):
        i, j = np.nonzero(x[own_here[lo : lo + 256]] @ x.T >= threshold)
        i = own_here[lo + i]
        keep = ~base[j] | (i < j)
        if run["lo"] != run["hi"]:
            keep &= blk[i] != blk[j]
        found.append((i[keep], j[keep]))
    i, j = (np.concatenate(a) for a in zip(*found, (np.zeros(0, int),) * 2))
    if not len(i):
        return None
    later = node[i] > node[j]  # where each looks the other up, the smaller node's bucket counts: the same in both buckets
    i, j = np.where(later, j, i), np.where(later, i, j)
    first = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 16):  # met in an earlier table, or in this one in the bucket that counts
        p, q = code[i[at : at + (1 << 16)]], code[j[at : at + (1 << 16)]]
        p_in_q, q_in_p = (p[:, :, :1] == q).any(2), (q[:, :, :1] == p).any(2)
        own = np.where(p_in_q[:, t], p[:, t, 0], q[:, t, 0])
        first[at : at + (1 << 16)] = ~(p_in_q[:, :t] | q_in_p[:, :t]).any(1) & (own == run["code"])
    return i[first], j[first]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of each member the smallest it is linked with over any number of links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, zero or empty, or hold null or non-finite components, link with nothing, as do vectors of different
    lengths with each other. Equal vectors all link with each other; rows of one id, or of none, count as so many vectors. A null id is never a
    component's smallest; rows of a component without any other id have a null component and are kept. An empty table gives no rows; extra columns are ignored.
    """
    kind = "<f8" if dict(vectors.dtypes)[vector] == "array<double>" else "<f4"

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            raw = _valid(b.column("v"), kind)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(raw, pa.binary()), pa.array([len(r) // int(kind[2]) if r else None for r in raw], pa.int32())], names=["vec_id", "raw", "dim"])

    rows = materialize(vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>" if kind == "<f8" else "array<float>").alias("v")).mapInArrow(to_bytes, "vec_id long, raw binary, dim int"), "vectors")
    classes = rows.where("raw is not null").groupBy("raw", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shape = {d: plan_tables(n, d, threshold) for d, n in sizes.items()}

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tidied(batches):
            raw, dims = b.column("raw").to_pylist(), b.column("dim").to_pylist()
            out: list = [None] * len(raw)
            for d in set(dims):
                mine = [k for k, x in enumerate(dims) if x == d]
                for k, c in zip(mine, codes(_units([raw[k] for k in mine], kind), *shape[d])):
                    out[k] = c.reshape(-1)
            packed = [c.astype(code_type(d, shape[d][1])).tobytes() for c, d in zip(out, dims)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "n", "dim", "raw")), pa.array(out, pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=["node", "n", "dim", "raw", "own", "codes"])

    hashed = materialize(classes.select("node", "n", "dim", "raw").mapInArrow(hash_, "node long, n long, dim int, raw binary, own array<long>, codes binary"), "hashed")
    member = hashed.select("node", "n", "dim", "raw", "codes", F.posexplode("own").alias("_at", "code")).withColumn("t", F.expr(f"_at div {PROBES}").cast("int")).withColumn("base", F.col("_at") % PROBES == 0)
    bucket = ["dim", "t", "code"]
    blocks = materialize(member.groupBy(*bucket).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select(*bucket, F.ceil(F.col("size") / BLOCK).cast("int").alias("nblk")), "hot-buckets")
    dealt = join_small(member.drop("_at"), blocks, bucket).withColumn("nblk", F.coalesce("nblk", F.lit(1)))
    dealt = dealt.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nblk")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, nblk - 1)"))).withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    run = [*bucket, "lo", "hi"]
    dealt = dealt.withColumn("key", F.xxhash64(*run)).select("key", *run, "blk", "base", "node", "n", "raw", "codes")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {c: t.column(c).to_numpy(zero_copy_only=False) for c in (*run, "blk", "base", "node", "n")}
            change = np.flatnonzero(np.any([cols[c][1:] != cols[c][:-1] for c in run], axis=0)) + 1
            for a, z in zip([0, *change], [*change, len(t)]):
                if z - a < 2 or not cols["base"][a:z].any():
                    continue
                dim = int(cols["dim"][a])
                tables, k = shape[dim]
                code = np.frombuffer(b"".join(t.column("codes").slice(a, z - a).to_pylist()), code_type(dim, k)).reshape(z - a, tables, PROBES)
                one = {c: cols[c][a] for c in run} | {c: cols[c][a:z] for c in ("blk", "base", "node")} | {"codes": code}
                pairs = _links(one, _units(t.column("raw").slice(a, z - a).to_pylist(), kind), threshold)
                if pairs is None:
                    continue
                i, j = pairs
                node, n = cols["node"][a:z], cols["n"][a:z]
                links = np.bincount(i, n[j], z - a) + np.bincount(j, n[i], z - a)
                mine = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(node[mine]), pa.array(links[mine].astype(np.int64)), pa.array(node[_forest(i, j, z - a)[mine]])], schema=schema)

        for b in tidied(batches):
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            last = held.slice(len(held) - 1)
            same = np.ones(len(held), bool)
            for c in run:
                same &= held.column(c).to_numpy() == last.column(c)[0].as_py()
            cut = len(held) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from done(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from done(held)

    seen = dealt.repartition("key").sortWithinPartitions("key", *run).mapInArrow(verify, "node long, links long, parent long")
    seen = materialize(seen, "links")
    links = seen.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(seen.select(F.col("node").alias("src"), F.col("parent").alias("dst")))
    reps = parts.join(classes.select("node", "rep"), "node")
    least = reps.groupBy("component").agg(F.min("rep").alias("least"))
    found = classes.join(links, "node", "left").join(reps.select("node", "component").join(least, "component").select("node", "least"), "node", "left")
    found = found.select(F.col("raw").alias("_raw"), F.col("dim").alias("_dim"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.join(found, (rows.raw == F.col("_raw")) & (rows.dim == F.col("_dim")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
