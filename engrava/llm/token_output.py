"""Token-ID output: Simple-8b word-aligned coding of documents' ids into files, and the way back.

A file is packs, one after another. A pack holds ``_HEAD``, the 64-bit code words of its blocks of ``BLOCK`` ids, and a footer: the word offset of each block,
each document's id, whether it is null, and its number of ids. A code word's upper four bits select how many ids of which width its lower 60 bits hold
(Anh and Moffat, 2010). Selector 0 is the escape: the next word is one id of 60 to 64 bits as it is. Every block starts a new word,
so blocks can be decoded alone, by the offsets, all words of a selector at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engrava.llm.files import in_id_order, read_range, write_documents
from engrava.llm.tokens import VOCABULARIES, vocabulary, word_tokenizer
from engrava.llm.workers import give_back, tidied
from engrava.plans.storage import fresh_path, materialize

#: Fixed values of the coding: ids in a word, and the width of each, by selector; 0 is the escape.
COUNTS = np.array([0, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 4096
#: Magic, version, ids in a block, blocks, code words, documents, ids.
_HEAD = struct.Struct("<4sIQQQQQ")


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bit lengths."""
    if ids.size and ids.max() < 1 << 52:
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    out, rest = np.zeros(len(ids), np.uint8), ids.copy()
    while rest.any():
        out += rest > 0
        rest >>= np.uint64(1)
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Code words of unsigned 64-bit ``ids``, and the offset of each block's first word. No ids: no blocks."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    blocks = -(-len(ids) // block)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    need = np.full((blocks, block), 255, np.uint8)  # 255: past the end, fits nowhere
    need.reshape(-1)[: len(ids)] = _bits(ids)
    widest, size = {1: need}, 1
    while size < COUNTS.max() and size < block:  # widest[n][i]: of need[i : i + n]
        top = np.full_like(need, 255)
        np.maximum(widest[size][:, : block - size], widest[size][:, size:], out=top[:, : block - size])
        widest[size := size * 2] = top
    choice = np.where(need > 60, 0, 15).astype(np.uint8)
    for s in range(14, 0, -1):
        n = int(COUNTS[s])
        if n > block:
            continue
        half = 1 << (n.bit_length() - 1)
        fits = widest[half] <= WIDTHS[s]
        if n > half:
            shift = n - half
            fits[:, : block - shift] &= widest[half][:, shift:] <= WIDTHS[s]
            fits[:, block - shift :] = False
        if not fits.any():
            break  # what fits a selector of more ids fits those of fewer
        choice[fits] = s
    del widest
    choice = choice.reshape(-1)
    step = COUNTS.copy()
    step[0] = 1
    ends = np.minimum(block, len(ids) - np.arange(blocks) * block)
    at, lanes, taken = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(lanes):  # one word of every unfinished block at a time
        here = lanes * block + at[lanes]
        taken.append(here)
        at[lanes] += step[choice[here]]
        lanes = lanes[at[lanes] < ends[lanes]]
    first = np.sort(np.concatenate(taken))
    sel = choice[first]
    words_each = np.where(sel == 0, 2, 1)
    place = np.cumsum(words_each) - words_each
    words = np.zeros(int(words_each.sum()), np.uint64)
    for s in range(16):
        mine = np.flatnonzero(sel == s)
        if s == 0:
            words[place[mine] + 1] = ids[first[mine]]
            continue
        word = np.full(len(mine), s << 60, np.uint64)
        if WIDTHS[s]:
            for k in range(COUNTS[s]):
                word |= ids[first[mine] + k] << np.uint64(k * WIDTHS[s])
        words[place[mine]] = word
    return words, place[np.searchsorted(first, np.arange(blocks) * block)]


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks' code words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    raw[1:] = sel[:-1] == 0  # an escaped id is 2**60 at least, so its upper four bits never are 0
    n = np.where(raw, 1, COUNTS[sel])
    start = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint64)
    out[start[raw]] = words[raw]
    for s in range(2, 16):
        mine = np.flatnonzero((sel == s) & ~raw)
        low, mask = words[mine], np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[start[mine] + k] = (low >> np.uint64(k * WIDTHS[s])) & mask
    return out


def pack_file(doc_ids: list, parts: list[bytes]) -> bytes:
    """A pack of the documents' ids, given as little-endian unsigned 32-bit integers."""
    words, offsets = encode(np.frombuffer(b"".join(parts), "<u4"))
    sizes = np.array([len(p) // 4 for p in parts], "<u8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(b"S8B1", BLOCK, len(offsets), len(words), len(parts), int(sizes.sum()), 0)
    return b"".join([head, words.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), ids.tobytes(), sizes.tobytes(), nulls.tobytes()])


def unpack_file(data: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Of each pack document ids, their numbers of token ids, and all token ids."""
    at = 0
    while at < len(data):
        magic, _, blocks, n_words, n_docs, _, _ = _HEAD.unpack_from(data, at)
        if magic != b"S8B1":
            raise ValueError("not a Simple-8b token file")
        at += _HEAD.size
        words = np.frombuffer(data, "<u8", n_words, at)
        at += 8 * (n_words + blocks)
        ids, sizes = np.frombuffer(data, "<i8", n_docs, at), np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs)
        nulls = np.frombuffer(data, np.uint8, n_docs, at + 16 * n_docs)
        at += 17 * n_docs
        yield [None if x else int(i) for i, x in zip(ids, nulls)], sizes.astype(np.int64), decode(words)


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block of a pack, decoded alone by its offset."""
    _, _, blocks, n_words, *_ = _HEAD.unpack_from(data)
    offsets = [*np.frombuffer(data, "<u8", blocks, _HEAD.size + 8 * n_words).astype(int), n_words]
    return decode(np.frombuffer(data, "<u8", offsets[block + 1] - offsets[block], _HEAD.size + 8 * offsets[block]))


def write_token_files(docs: DataFrame, uri: str, vocab: str = "word_bpe_49k", end_id: int | None = 2) -> DataFrame:
    """Tokenise whole texts and write them below ``uri`` in ascending doc_id order; returns the manifest, one row per file.

    A null text counts as empty; each document ends with ``end_id``. A null doc_id comes first; rows with one doc_id keep the order of
    the input. An empty table writes no file. Extra columns are ignored. The text is shuffled once, by ranges of doc_id.
    """
    name, spaced = VOCABULARIES[vocab]
    last = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def ids(texts: pa.Array) -> list[bytes]:
        return [x + last for x in word_tokenizer(vocabulary(name), spaced).batch(texts)]

    return materialize(write_documents(in_id_order(docs), uri, ids, pack_file, "s8b"), "s8b-manifest")


def file_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``: ids in all files before. A scan within each writer's files, then one over the writers' sums."""
    sums = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    sums = sums.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    own = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file_no")) - F.col("n_ids")
    return manifest.withColumn("_own", own).join(sums, "part").withColumn("first", F.col("_own") + F.col("_before")).drop("_own", "_before")


def read_token_files(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens`` and ``ids`` (array of long), or with ``digest`` ``ids_crc32``, the
    CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "start", "n_tokens")] + [T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.LongType()))])

    def rows(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        stops = np.cumsum(sizes)
        if digest:
            raw = memoryview(ids.astype("<u4").tobytes())
            values = pa.array([zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), sizes.tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(stops - sizes + first), pa.array(sizes), values], schema=schema)
            return
        for k in range(0, len(sizes), 256):  # ids are wide: few documents a batch
            b, n = stops[k : k + 256], sizes[k : k + 256]
            lo = int(b[0] - n[0])
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], b - lo]), pa.int32()), pa.array(ids[lo : int(b[-1])].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[k : k + 256], pa.int64()), pa.array(b - n + first), pa.array(n), values], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches, tokenizing=True):
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                for doc_ids, sizes, ids in unpack_file(read_range(path)):
                    yield from rows(doc_ids, sizes, ids, first)
                    first += len(ids)
                    give_back()

    files = materialize(file_starts(manifest).select("path", "first"), "s8b-files")
    tasks = max(1, -(-files.count() // 4), files.sparkSession.sparkContext.defaultParallelism)  # some files to each task
    return files.repartition(tasks).mapInArrow(read, out)


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's place, length and CRC-32, from the files written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, fresh_path(spark, "s8b")), digest=True)
