"""Token counts from flat token files that have no index: a separator scan.

The files hold nothing but ids of fixed width, each document ended by an end-of-document id. Files are cut into blocks by byte range; each
block is searched for the id at once with numpy, and what a block does not see, where the document that its first separator ends began,
comes from a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.llm.files import read_range, write_documents
from engrava.llm.tokens import VOCABULARIES, vocabulary, word_tokenizer
from engrava.plans.storage import fresh_path, materialize

#: Ids that a task searches at once.
BLOCK_IDS = 1 << 18
#: Blocks in a run of the prefix scan.
RUN = 4096
#: Ends a document: the largest 16-bit number, which is no vocabulary's id, so no text yields it.
END_ID = (1 << 16) - 1


def write_flat_files(docs: DataFrame, uri: str, vocab: str = "word_bpe_49k", dtype: str = "<u2") -> DataFrame:
    """Write whole texts as flat files of ids, as the documents lie in their partitions; returns which document is the how manieth of which file (``file_no, path, ordinal, doc_id``).

    A null text counts as empty; every document is ended by ``END_ID``. No shuffle. A null doc_id stays null; repeated rows stay; extra columns are ignored;
    an empty table writes no file.
    """
    name, spaced = VOCABULARIES[vocab]
    if np.iinfo(dtype).max < END_ID:
        raise ValueError(f"{dtype} cannot hold id {END_ID}")
    last = np.array([END_ID], "<u4").tobytes()

    def ids(texts: pa.Array) -> list[bytes]:
        return [x + last for x in word_tokenizer(vocabulary(name), spaced).batch(texts)]

    def pack(_: list, parts: list[bytes]) -> bytes:
        return np.frombuffer(b"".join(parts), "<u4").astype(dtype).tobytes()

    return materialize(write_documents(docs, uri, ids, pack, "bin", per_document=True), "flat-placed")


def scan_flat_files(files: DataFrame, end_id: int, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document of the flat files in ``files`` (``file_no, path, bytes``): ``file_no, ordinal, start, n_tokens``.

    ``start`` counts the ids before the document in its file, separators included; ``n_tokens`` leaves the separator out. Ids after a
    file's last separator are a document too; an empty file has none; two separators in a row enclose a document of no tokens.
    """
    width = np.dtype(dtype).itemsize
    n_ids = F.expr(f"bytes div {width}")
    blocks = files.where(f"bytes >= {width}").select("file_no", "path", n_ids.alias("n_ids"), F.explode(F.sequence(F.lit(0), F.expr(f"cast((bytes div {width} - 1) div {block_ids} as int)"))).alias("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_no, path, n, block in zip(*(batch.column(c).to_pylist() for c in ("file_no", "path", "n_ids", "block"))):
                at = block * block_ids
                size = min(block_ids, n - at)
                found = np.flatnonzero(np.frombuffer(read_range(path, at * width, size * width), dtype) == end_id) + at
                if at + size == n and (not len(found) or found[-1] != n - 1):
                    found = np.append(found, n)  # the file's end ends its last document
                yield pa.RecordBatch.from_pydict({"file_no": [file_no], "block": [block], "n": [len(found)], "last": [int(found[-1]) if len(found) else None], "ends": [found]}, schema)

    schema = pa.schema([("file_no", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("last", pa.int64()), ("ends", pa.list_(pa.int64()))])
    spread = blocks.repartition("file_no", "block").mapInArrow(search, "file_no long, block int, n long, last long, ends array<long>")
    seen = materialize(spread, "scan")
    # The scan goes over runs of blocks, and within each run: a file's blocks lie in as many tasks as it has runs.
    runs = seen.select("file_no", "block", F.expr(f"block div {RUN}").alias("run"), "n", "last")
    earlier = Window.partitionBy("file_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.groupBy("file_no", "run").agg(F.sum("n").alias("n"), F.max("last").alias("last")).select("file_no", "run", F.sum("n").over(earlier).alias("run_docs"), F.max("last").over(earlier).alias("run_end"))
    before = Window.partitionBy("file_no", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.select("file_no", "block", "run", F.sum("n").over(before).alias("docs"), F.max("last").over(before).alias("end")).join(sums, ["file_no", "run"])
    zero, none = F.lit(0), F.lit(-1)
    stitched = inside.select("file_no", "block", (F.coalesce("docs", zero) + F.coalesce("run_docs", zero)).alias("docs_before"), F.coalesce("end", "run_end", none).alias("prev_end"))
    ends = seen.join(stitched, ["file_no", "block"])
    starts = F.expr("concat(array(prev_end), slice(ends, 1, greatest(size(ends) - 1, 0)))")
    rows = ends.where("n > 0").select("file_no", "docs_before", F.posexplode(F.arrays_zip(F.col("ends").alias("e"), starts.alias("s"))).alias("k", "p"))
    return rows.select("file_no", (F.col("docs_before") + F.col("k")).alias("ordinal"), (F.col("p.s") + 1).alias("start"), (F.col("p.e") - F.col("p.s") - 1).alias("n_tokens"))


def file_sizes(spark: SparkSession, uri: str) -> DataFrame:
    """``file_no, path, bytes`` of the flat files below ``uri``, numbered as ``write_flat_files`` names them; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(uri).select("path", F.col("length").alias("bytes"))
    part, seq = (F.regexp_extract("path", r"part-(\d+)-(\d+)\.bin$", k).cast("long") for k in (1, 2))
    return found.select((F.shiftleft(part, 24) + seq).alias("file_no"), "path", "bytes")


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, read off the flat files: ``doc_id, file_no, ordinal, start, n_tokens``, one row per row of ``documents``.

    Null and empty texts have no tokens; repeated rows and rows of a null doc_id are counted each; an empty table gives no rows.
    """
    docs, uri = spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "flat")
    placed = write_flat_files(docs, uri)
    counts = scan_flat_files(file_sizes(spark, uri), END_ID) if placed.limit(1).count() else None
    if counts is None:
        return spark.createDataFrame([], "doc_id long, file_no long, ordinal long, start long, n_tokens long")
    return placed.join(counts, ["file_no", "ordinal"]).select("doc_id", "file_no", "ordinal", "start", "n_tokens")
