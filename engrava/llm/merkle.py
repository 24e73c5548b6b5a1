"""A Merkle manifest of a table: one digest for all rows, and a proof for each.

Leaves are digests of rows, ordered within a group; every ``FAN`` consecutive nodes become one, until one is left, the group's subroot; the groups' subroots, ordered by
group, become the root in the same way. Nodes lie outside memory, as Parquet folders ``level=0``, ``level=1``, ... below the manifest's: sorted runs of leaves, numbered
by their place in the group, then each level from the one below. A node is found by its coordinate (group number, level, place): its parent's place is its own
divided by ``FAN``. Proofs are read from the top down, each level's runs merged with the paths of their parents.

Everything stays in Spark's own functions. A hot group is many runs, since runs are cut by row, not by group; no window spans more than a group's runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.plans.storage import fresh_path, join_small, materialize, scratch

FAN = 8
#: Paths to subroots that are broadcast, some kilobytes each; more are joined by a shuffle.
TOPS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(value: Column) -> Column:
    """Lowercase hex digest of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return sha256(F.concat(*map(field, values)))


def _write(df: DataFrame, folder: str, level: int) -> DataFrame:
    path = f"{folder}/level={level}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (``grp``, ``key``, ``leaf``, ...) with ``gid``, the group's number in order, ``pos``, the row's place in the group, and ``n``, the group's rows; places of all
    rows without a window over them.

    The rows are sorted into runs by ranges; rows alike in group, key and digest are spread by where they lie. A run's rows are numbered where they are; what comes before
    a run is added up over runs.
    """
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    runs = materialize(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("row", F.monotonically_increasing_id()), "leaf-runs")
    run = F.shiftright("row", 33)
    parts = runs.groupBy("grp", run.alias("run")).agg(F.min("row").alias("first"), F.count("*").alias("k"))
    group = Window.partitionBy("grp").orderBy("run")
    parts = parts.select("*", F.sum("k").over(group).alias("upto"), F.sum("k").over(Window.partitionBy("grp")).alias("n"), (F.row_number().over(group) == 1).cast("long").alias("begins"))
    parts = materialize(parts.withColumn("within", F.sum("begins").over(Window.partitionBy("run").orderBy("first"))), "runs")
    before = parts.groupBy("run").agg(F.sum("begins").alias("b")).withColumn("before", F.sum("b").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))  # a row a run
    begins = parts.where("begins = 1").join(before, "run").select(F.col("grp").alias("_grp"), (F.coalesce("before", F.lit(0)) + F.col("within") - 1).alias("gid"))
    parts = parts.join(begins, F.col("grp").eqNullSafe(F.col("_grp"))).select(F.col("grp").alias("_grp"), "run", "gid", "n", (F.col("upto") - F.col("k") - F.col("first")).alias("shift"))
    placed = join_small(runs, materialize(parts, "placed-runs"), F.col("grp").eqNullSafe(F.col("_grp")) & (run == F.col("run")), "inner")
    return placed.withColumn("pos", F.col("row") + F.col("shift")).drop("_grp", "run", "shift", "row")


def _runs(nodes: DataFrame, *payload: str) -> DataFrame:
    """``gid, up, n, run``: each parent's nodes in order."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *payload)))
    return nodes.where("n > 1").groupBy("gid", F.expr(f"pos div {FAN}").alias("up")).agg(F.max("n").alias("n"), members.alias("run"))


def _levels(leaves: DataFrame, folder: str) -> list[DataFrame]:
    """``gid, pos, n, digest`` of each level above ``leaves``, lowest first; ``n`` is the number of a group's nodes there."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = _runs(levels[-1].select("gid", "pos", "n", "digest"))
        up = runs.select("gid", F.col("up").alias("pos"), F.expr(f"(n + {FAN} - 1) div {FAN}").alias("n"), sha256(F.concat_ws("", "run.digest")).alias("digest"))
        levels.append(_write(up, folder, len(levels)))
        most = (most + FAN - 1) // FAN
    return levels


def _roots(levels: list[DataFrame]) -> DataFrame:
    roots = levels[0].where("n = 1").select("gid", "digest")
    for level in levels[1:]:
        roots = roots.unionByName(level.where("n = 1").select("gid", "digest"))
    return roots


def _paths(levels: list[DataFrame], tops: DataFrame, *payload: str) -> DataFrame:
    """``gid, digest``, the payload, the columns of ``tops`` (``gid``, ``path``, ...) and ``path``: what stands to the left and right of a leaf at each level up to the root."""
    extra = [c for c in tops.columns if c not in ("gid", "path")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        carried = payload if not k else ()
        nodes = levels[k].select("gid", "pos", "n", "digest", *carried)
        here = join_small(nodes.where("n = 1"), tops, "gid", "inner", TOPS).select("gid", "pos", "digest", *carried, "path", *extra)
        if above is not None:
            a = above.select(F.col("gid").alias("_gid"), F.col("pos").alias("_pos"), "path", *extra)
            met = _runs(nodes, *carried).join(a.hint("merge"), (F.col("gid") == F.col("_gid")) & (F.col("up") == F.col("_pos")))
            each = met.select("gid", "run", "path", *extra, F.posexplode("run").alias("i", "node"))
            digests = F.col("run.digest")
            step = F.struct(F.concat_ws("", F.slice(digests, F.lit(1), F.col("i"))).alias("left"), F.concat_ws("", F.slice(digests, F.col("i") + 2, F.lit(FAN))).alias("right"))
            deeper = each.select("gid", "node.pos", "node.digest", *(f"node.{c}" for c in carried), F.concat(F.array(step), "path").alias("path"), *extra)
            here = here.unionByName(deeper)
        above = materialize(here.drop("digest"), "paths") if k else here
    return above


def fold(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` gives with what stands beside it at each level."""
    return F.aggregate(path, leaf, lambda node, step: sha256(F.concat(step["left"], node, step["right"])))


def siblings_digest(path: Column) -> Column:
    return sha256(F.concat_ws("", F.transform(path, lambda step: F.concat(step["left"], step["right"]))))


@dataclass
class Manifest:
    """Levels of the groups' trees, with ``grp``, ``key`` and ``claimed`` at the leaves, and of the tree over their subroots."""

    levels: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """One row with ``root``; none for an empty table."""
        return _roots(self.top).select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """``key, grp, leaf, claimed, path, subroot, root``, one row per row of the table."""
        root = F.broadcast(self.root())  # one row
        tops = root.select(F.lit(0).cast("long").alias("gid"), F.array().cast("array<struct<left:string,right:string>>").alias("path"), "root")
        groups = materialize(_paths(self.top, tops, "sub").select(F.col("sub").alias("gid"), F.col("digest").alias("subroot"), "path", "root"), "subroots")
        return _paths(self.levels, groups, "grp", "key", "claimed").withColumnRenamed("digest", "leaf").drop("gid", "pos")


def build_manifest(rows: DataFrame, folder: str) -> Manifest:
    """Writes the nodes of ``rows`` (``grp``, ``key``, ``leaf``, and ``claimed``, a digest to hold against the proof, null for the leaf's own) below ``folder``.

    Leaves ascend by key, null keys first; rows of one key by digest, so equal rows may stand either way. Null is a group, the first. An empty table has no root.
    """
    with scratch(rows.sparkSession):
        leaves = _write(_numbered(rows).withColumnRenamed("leaf", "digest"), f"{folder}/rows", 0)
        levels = _levels(leaves, f"{folder}/rows")
        subroots = _roots(levels).select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("pos"), F.col("gid").alias("sub"), "digest")
        n = levels[0].agg((F.max("gid") + 1).alias("n"))  # one row
        top = _levels(_write(subroots.crossJoin(F.broadcast(n)), f"{folder}/groups", 0), f"{folder}/groups")
    return Manifest(levels, top)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents by language. Claimed of every third id, by its hash, is the digest of the text with A-Z lower-cased; a null id isn't tampered with.

    Null and empty fields differ; texts of any length are hashed where they lie, and nothing but digests goes on. Extra columns are ignored.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    fields = [F.col(c) for c in FIELDS]
    lowered = F.translate("text", UPPER, LOWER)
    return docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), row_digest(*fields).alias("leaf"), F.when(tampered, row_digest(*fields[:-1], lowered)).alias("claimed"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per row: repeated rows, null ids and null languages included. An empty table gives no rows."""
    spark = docs.sparkSession
    leaves = materialize(document_leaves(docs), "leaves")
    proofs = build_manifest(leaves, fresh_path(spark, "merkle")).proofs()
    folded = proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), fold(F.col("path"), F.coalesce("claimed", "leaf")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_node_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return verify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
