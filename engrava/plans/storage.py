"""Shared storage for intermediate tables, and joins with a size-checked small side.

Every intermediate goes to the folder that the cluster names in ``spark.checkpoint.dir``; only where that is unset and the master is local
(tests, a laptop) a temporary folder is made. Nothing is kept on an executor's own disk, so a lost executor costs a recomputed task and no
data. What an application has written there goes when its driver ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a materialised side may be broadcast; beyond it the join shuffles and AQE splits skewed keys.
BROADCAST_ROWS = 100_000
#: Each application's own folder.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master set to a new temporary one where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="engrava-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses, in the application's own folder."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/engrava-{app}-{uuid.uuid4().hex[:8]}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(_folders[app])
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(folder)
        store.deleteOnExit(folder)
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage and fixes what non-deterministic columns hold.

    Within ``scratch`` it goes with the block, unless it is to ``keep``: then with the block around, if any.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    blocks = _blocks.get()
    if len(blocks) > keep:
        blocks[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of the open blocks, innermost last, of the thread or task that opened them: another's tables never go with them.
_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised in this block are deleted at its end. What outlives the block must be materialised with ``keep`` in it, and read nothing else of it."""
    paths: list[str] = []
    token = _blocks.set((*_blocks.get(), paths))
    try:
        yield
    finally:
        _blocks.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a broadcast of ``small`` only if a count shows at most ``rows`` rows; else a merge join, since files of few bytes, which Spark would broadcast by itself, may hold
    more rows than the driver. ``small`` should be materialised."""
    small = F.broadcast(small) if small.limit(rows + 1).count() <= rows else small.hint("merge")
    return big.join(small, on, how)
