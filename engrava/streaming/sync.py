"""Incremental import of records by their external ids.

What a source has sent lies in a versioned store: ``records`` (what is known of each external id), ``memories``, ``chunks`` and ``facts``, all by the memory's id, so that a memory that
is replaced or deleted takes its chunks and facts along. A batch is one version: its rows, its place in the ledger and the high-water mark appear together or not at all. A batch
that comes again changes nothing, whether by its number (a stream that restarts) or by its contents (a source that sends again).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engrava.functions import text as T
from engrava.operators import extraction
from engrava.plans import ranks, versions
from engrava.plans.storage import join_small, materialize, scratch
from engrava.plans.versions import Version

#: Columns of records; ``deleted`` marks one that its source no longer has.
RECORD = "external_id string, source string, content string, section string, project string, agent_id string, modified_at timestamp_ntz, deleted boolean"
_RECORDS = "id long, provider string, external_id string, content_hash string, modified_at timestamp_ntz"
_LEDGER = "id long, provider string, stream string, batch long, fetched long, imported long, replaced long, unchanged long, stale long, duplicate long, deleted long"


def create(spark: SparkSession, path: str) -> Version:
    return versions.create(spark, path, {"kind": "sync", "last": {}, "mark": {}, "highest": 0})


def _table(spark: SparkSession, version: Version, name: str, schema: str) -> DataFrame:
    held = versions.live(spark, version, name)
    return held if held is not None else spark.createDataFrame([], schema)


def plan(known: DataFrame, batch: DataFrame, provider: str) -> DataFrame:
    """The newest state of each external id in ``batch`` with ``outcome``, and ``old_id`` of the memory that it has.

    ``stale``: known in a newer state. ``unchanged``: known with this path and content. ``deleted``, or ``stale`` if unknown. ``duplicate``: the path and content are another's of the
    provider, known or earlier in the batch by external id. Else ``replaced`` or ``imported``. Null ids are passed over; of equally new states the first by content.
    """
    path = F.concat_ws(":", F.lit(provider), F.nullif(F.coalesce("source", F.lit("")), F.lit("")))
    rows = batch.where("external_id IS NOT NULL").withColumn("path", path).withColumn("content_hash", T.hash_with_path(F.coalesce("content", F.lit("")), F.col("path")))
    newest = rows.groupBy("external_id").agg(F.max_by(F.struct(*rows.columns), F.struct("modified_at", "content_hash", "deleted")).alias("r"), F.count("*").alias("sent")).select("r.*", "sent")
    newest = materialize(newest, "sync-newest")
    mine = known.where(F.col("provider") == provider)
    by_id = join_small(mine, newest.select("external_id"), "external_id", "left_semi").select("external_id", F.col("id").alias("old_id"), F.col("content_hash").alias("old_hash"), F.col("modified_at").alias("old_at"))
    by_hash = join_small(mine, newest.select("content_hash", F.col("external_id").alias("_of")), "content_hash", "inner").where("external_id <> _of").select("content_hash", F.lit(True).alias("held")).distinct()
    first = newest.where("NOT coalesce(deleted, false)").groupBy("content_hash").agg(F.min("external_id").alias("first"))
    met = newest.join(by_id, "external_id", "left").join(by_hash, "content_hash", "left").join(first, "content_hash", "left")
    outcome = (
        F.when(F.col("old_at") > F.col("modified_at"), "stale")
        .when(F.coalesce("deleted", F.lit(False)), F.when(F.col("old_id").isNotNull(), "deleted").otherwise("stale"))
        .when(F.col("old_hash") == F.col("content_hash"), "unchanged")
        .when(F.coalesce("held", F.lit(False)) | (F.col("first") < F.col("external_id")), "duplicate")
        .when(F.col("old_id").isNotNull(), "replaced")
        .otherwise("imported")
    )
    return met.withColumn("outcome", outcome).drop("old_hash", "old_at", "held", "first")


def chunks_of(memories: DataFrame) -> DataFrame:
    """``id, position, text``: paragraphs."""
    return extraction.paragraphs(memories.select("id", "content")).select("id", "position", "text")


def facts_of(memories: DataFrame) -> DataFrame:
    """``id, line, subject, predicate, object``: keys with their values, and what sentences state."""
    pairs = extraction.key_values(memories.select("id", "content")).select("id", "line", F.lit("").alias("subject"), F.col("key").alias("predicate"), F.col("value").alias("object"))
    said = extraction.sentences(memories.select("id", "content")).select("id", "line", "subject", "predicate", "object")
    return pairs.unionByName(said)


def sync(spark: SparkSession, path: str, provider: str, records: DataFrame, batch: int, stream: str = "sync") -> Version:
    """Takes in one batch of ``records`` (``RECORD``); of a batch that the ledger has, or an earlier one of the same stream, nothing.

    A changed record's memory is replaced with its chunks and facts, under a new id; a deleted one's goes. A second writer fails, and may try again.
    """
    old = versions.open_version(spark, path)
    key = f"{provider}/{stream}"
    if batch <= old.meta["last"].get(key, -1):
        return old
    with scratch(spark):
        planned = materialize(plan(_table(spark, old, "records", _RECORDS), records, provider), "sync-plan")
        new = ranks.numbered(planned.where("outcome IN ('imported', 'replaced')"), "id", [F.col("external_id")]).withColumn("id", F.col("id") + old.meta["highest"] + 1)
        new = materialize(new, "sync-new")
        memories = new.select("id", "content", F.col("path").alias("source_file"), F.col("section").alias("source_section"), "project", "agent_id", "content_hash", "modified_at")
        gone = planned.where("outcome IN ('replaced', 'deleted')").select(F.col("old_id").alias("id"))
        count = {r.outcome: r.n for r in planned.groupBy("outcome").agg(F.count("*").alias("n")).collect()}  # seven kinds
        seen = planned.agg(F.sum("sent").alias("n"), F.max("modified_at").cast("string").alias("mark")).first()
        ledger = [(None, provider, stream, batch, seen.n or 0, *(count.get(k, 0) for k in ("imported", "replaced", "unchanged", "stale", "duplicate", "deleted")))]
        tables = {
            "records": new.select("id", F.lit(provider).alias("provider"), "external_id", "content_hash", "modified_at"),
            "memories": memories,
            "chunks": chunks_of(memories),
            "facts": facts_of(memories),
            "dead": gone,
            "ledger": spark.createDataFrame(ledger, _LEDGER),
        }
        mark = max(old.meta["mark"].get(provider) or "", seen.mark or "")
        meta = {"last": old.meta["last"] | {key: batch}, "mark": old.meta["mark"] | {provider: mark}, "highest": old.meta["highest"] + count.get("imported", 0) + count.get("replaced", 0)}
        return versions.add(spark, old, tables, meta=meta)


def since(spark: SparkSession, path: str, provider: str) -> str | None:
    """The high-water mark: the newest change that has been taken in; None before the first."""
    return versions.open_version(spark, path).meta["mark"].get(provider) or None


def table(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame:
    """``records``, ``memories``, ``chunks``, ``facts`` or ``ledger`` as they are now, or were at a version."""
    held = versions.live(spark, versions.open_version(spark, path, number), name)
    if held is None:
        raise ValueError(f"nothing has been taken in: {name}")
    return held


def compact(spark: SparkSession, path: str) -> Version:
    """One segment of what is live."""
    old = versions.open_version(spark, path)
    names = {n for s in old.segments for n in s["tables"]} - {"dead"}
    return versions.add(spark, old, {n: versions.live(spark, old, n) for n in sorted(names)}, alone=True) if names else old


def sync_stream(records: DataFrame, path: str, provider: str, checkpoint: str, stream: str = "stream", available_now: bool = True) -> StreamingQuery:
    """Takes in a stream of records; a batch that is run again after a failure is known by its number. A stream with a new checkpoint needs a name of its own."""

    def take(batch: DataFrame, number: int) -> None:
        sync(batch.sparkSession, path, provider, batch, number, stream)

    out: Callable = records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
