"""Token files in the shared folder: written whole or not at all, read by byte range."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engrava.llm.workers import tidied

#: Ids after which a writer packs what it has, at the end of a document, and bytes after which it closes a file.
PACK_IDS, FILE_BYTES = 2_000_000, 128 << 20


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of ``uri`` (a local path, ``file://``, ``hdfs://``, ``s3://``, ``gs://``) and the path there."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class FileWriter:
    """Writes under another name and moves at the end: a task that is lost or run twice leaves no half-written file."""

    def __init__(self, uri: str):
        self.store, self.path = filesystem(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.size = self.store.open_output_stream(self.part), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.path)


def read_range(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(length) if length is not None else f.read()


def in_slices(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that what is made of its texts is small beside it."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


#: One row per document that a writer has put into a file.
PLACED = T.StructType([T.StructField("file_no", T.LongType()), T.StructField("path", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("doc_id", T.LongType())])
#: One row per file.
MANIFEST = T.StructType([T.StructField("part", T.LongType()), T.StructField("file_no", T.LongType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])


def write_documents(docs: DataFrame, uri: str, encode: Callable[[pa.Array], list[bytes]], pack: Callable[[list, list[bytes]], bytes], suffix: str, per_document: bool = False) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``), as they lie in their partitions, into files below ``uri``.

    ``encode`` gives texts' ids as little-endian unsigned 32-bit integers; ``pack`` makes bytes of the ids of some documents, and a file is such packs one
    after another, up to ``FILE_BYTES`` and one pack more. A worker's memory holds one pack of ``PACK_IDS`` and the longest document. Names follow from
    the partition and the file's number in it, so a repeated task overwrites its own files. Lazy: returns the manifest's rows
    (``MANIFEST``, or ``PLACED`` for each document), to be materialised once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        file: FileWriter | None = None
        n_docs = n_ids = 0  # in the file before this pack
        where = lambda: (f"{uri}/part-{part:07d}-{seq:05d}.{suffix}", (part << 24) | seq)

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal file, n_docs, n_ids, ids, parts, size
            path, no = where()
            file = file or FileWriter(path)
            file.write(pack(ids, parts))
            if per_document:
                yield pa.RecordBatch.from_pydict({"file_no": [no] * len(ids), "path": [path] * len(ids), "ordinal": range(n_docs, n_docs + len(ids)), "doc_id": ids}, pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())]))
            n_docs, n_ids, ids, parts, size = n_docs + len(ids), n_ids + size, [], [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal file, n_docs, n_ids, seq
            path, no = where()
            file.close()
            if not per_document:
                yield pa.RecordBatch.from_pydict({"part": [part], "file_no": [no], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}, pa.schema([("part", pa.int64()), ("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            file, n_docs, n_ids, seq = None, 0, 0, seq + 1

        for doc_id, raw in ((d, r) for c in tidied((c for b in batches for c in in_slices(b)), tokenizing=True) for d, r in zip(c.column("doc_id").to_pylist(), encode(c.column("text")))):
            ids.append(doc_id)
            parts.append(raw)
            size += len(raw) // 4
            if size >= PACK_IDS:
                yield from packed()
                if file.size >= FILE_BYTES:
                    yield from closed()
        if ids:
            yield from packed()
        if file:
            yield from closed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, PLACED if per_document else MANIFEST)


def in_id_order(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` dealt by ranges of doc_id and sorted in each; nulls first. Repeated doc_ids keep the order of the input, and may be split."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("_at"))
    return rows.repartitionByRange("doc_id", "_at").sortWithinPartitions("doc_id", "_at").select("doc_id", "text")
