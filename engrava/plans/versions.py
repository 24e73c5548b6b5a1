"""Tables that outlive a session: segments of Parquet under numbered manifests.

A change writes a new segment and then a manifest that names it; a manifest appears whole or not at all, and only if no other writer made that number first. A segment
holds rows, and the ids whose rows in earlier segments are dead: those it replaces or deletes. Whoever opens a number sees what it named, also while later changes are
made. ``compact`` leaves one segment; ``vacuum`` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Version(NamedTuple):
    """``segments``: number, folder and kinds of each, oldest first; ``meta`` is the owner's."""

    path: str
    number: int
    segments: tuple[dict[str, Any], ...]
    meta: dict[str, Any]


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are there."""
    store, p = _context(spark, f"{path}/manifests")
    if not store.exists(p):
        return []
    return sorted(int(name[:-5]) for s in store.listStatus(p) if (name := s.getPath().getName()).endswith(".json") and not name.startswith("_"))


def open_version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The latest version, or one by its number."""
    there = numbers(spark, path)
    if not there or number is not None and number not in there:
        raise FileNotFoundError(f"no version {'' if number is None else number} below {path}")
    number = there[-1] if number is None else number
    text = spark.read.text(f"{path}/manifests/{number:08d}.json", wholetext=True).first()[0]
    held = json.loads(text)
    return Version(path, number, tuple(held["segments"]), held["meta"])


def commit(spark: SparkSession, version: Version) -> Version:
    """Writes a manifest under another name and moves it to its own; fails if that number is taken."""
    held = json.dumps({"segments": list(version.segments), "meta": version.meta})
    target = f"{version.path}/manifests/{version.number:08d}.json"
    part = f"{version.path}/manifests/_{uuid.uuid4().hex}"
    store, p = _context(spark, part)
    store.mkdirs(p.getParent())
    out = store.create(p, False)
    try:
        out.write(bytearray(held.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else store.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(store.makeQualified(p), store.makeQualified(jvm.org.apache.hadoop.fs.Path(target)), none)
    except Exception as e:
        store.delete(p, False)
        raise FileExistsError(f"version {version.number} of {version.path} was made by another writer") from e
    return version


def create(spark: SparkSession, path: str, meta: dict[str, Any]) -> Version:
    return commit(spark, Version(path, 0, (), meta))


def add(spark: SparkSession, old: Version, tables: dict[str, DataFrame], by: dict[str, list[str]] | None = None, alone: bool = False, meta: dict[str, Any] | None = None) -> Version:
    """The next version, with a segment of ``tables``: a table named ``dead`` has the ids whose earlier rows go. ``by`` names columns whose values are folders.

    ``alone``: the segment takes the place of all others.
    """
    folder = f"{old.path}/segments/{old.number + 1:08d}-{uuid.uuid4().hex[:8]}"
    for name, table in tables.items():
        table.write.partitionBy(*(by or {}).get(name, [])).parquet(f"{folder}/{name}")
    segment = {"number": old.number + 1, "folder": folder, "tables": {n: t.schema.jsonValue() for n, t in tables.items()}}
    return commit(spark, Version(old.path, old.number + 1, (segment,) if alone else (*old.segments, segment), old.meta | (meta or {})))


def live(spark: SparkSession, version: Version, name: str) -> DataFrame | None:
    """Rows of a table in all segments whose ids no later segment calls dead; None if no segment has it."""
    from pyspark.sql.types import StructType

    from engrava.plans.storage import join_small

    rows = dead = None
    for s in version.segments:
        for table in (name, "dead"):
            if table in s["tables"]:
                part = spark.read.schema(StructType.fromJson(s["tables"][table])).parquet(f"{s['folder']}/{table}").withColumn("_segment", F.lit(s["number"]))
                if table == name:
                    rows = part if rows is None else rows.unionByName(part)
                else:
                    dead = part if dead is None else dead.unionByName(part)
    if rows is None or dead is None:
        return rows.drop("_segment") if rows is not None else None
    last = dead.groupBy(F.col("id").alias("_dead")).agg(F.max("_segment").alias("_until"))
    return join_small(rows, last, (F.col("id") == F.col("_dead")) & (F.col("_segment") < F.col("_until")), "left_anti").drop("_segment")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all but the ``keep`` latest manifests, and the segments that none of these names; how many folders went. Nobody may be writing."""
    there = numbers(spark, path)
    named = {s["folder"].rpartition("/")[2] for n in there[-keep:] for s in open_version(spark, path, n).segments}
    store, p = _context(spark, f"{path}/manifests")
    for n in there[:-keep]:
        store.delete(_context(spark, f"{path}/manifests/{n:08d}.json")[1], False)
    store, p = _context(spark, f"{path}/segments")
    gone = [s.getPath() for s in store.listStatus(p) if s.getPath().getName() not in named] if store.exists(p) else []
    for folder in gone:
        store.delete(folder, True)
    return len(gone)
