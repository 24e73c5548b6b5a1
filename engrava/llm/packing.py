"""Best-fit packing of tokenised documents into sequences of fixed length, after a Martello-Toth dominance reduction.

Packing depends on the pieces' lengths alone, and there are only as many lengths as a sequence is long. So the plan is made on the
histogram of lengths, whole classes of equal sequences at a time, and is a few thousand rows at any size of the input; the pieces then
find their places by their rank among those of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.llm.files import in_slices
from engrava.llm.tokens import VOCABULARIES, vocabulary, word_tokenizer
from engrava.llm.workers import tidied
from engrava.plans.storage import join_small, materialize

#: Tokens in a sequence, and bytes of text split at once.
CAPACITY, SPLIT_BYTES = 1024, 2 << 20


class _Lengths:
    """A multiset of lengths as counts, with the present lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: int(v) for k, v in counts.items() if v}
        self.order = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect.bisect_left(self.order, length))


def _reduce(left: _Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix the sets of one or two pieces that dominate all others with their largest piece (Martello and Toth, 1990, procedure MTRP).

    For the pieces of a length w, from the longest: alone if nothing fits beside; with the longest that fits, if that fills the
    sequence, if no two pieces fit beside, or if no three do and no two are longer together. Each fixing takes as many equal sets as
    there are. What no rule fixes stays.
    """
    fixed = []
    for w in reversed(left.order.copy()):
        room = capacity - w
        while n := left.n.get(w, 0):
            # What is there beside one such piece.
            beside = [(k, left.n[k] - (k == w)) for k in left.order if k <= room and left.n[k] > (k == w)]
            best = beside[-1][0] if beside else None
            small = [k for k, m in beside[:3] for _ in range(min(m, 3))][:3]
            fits = sum(sum(small[: k + 1]) <= room for k in range(len(small)))
            if best is None:
                mates: tuple[int, ...] = ()
            elif fits == 1 or best == room:
                mates = (best,)
            elif fits == 2 and best >= _best_pair(beside, room):
                mates = (best,)
            else:
                break
            many = n if not mates else n // 2 if best == w else min(n, left.n[best])
            fixed.append(((w, *mates), many))
            for length in (w, *mates):
                left.take(length, many)
    return fixed


def _best_pair(beside: list[tuple[int, int]], room: int) -> int:
    """The largest sum of two pieces that fits the room."""
    lengths, best = [k for k, _ in beside], 0
    for k, m in beside:
        at = bisect.bisect_right(lengths, min(room - k, k)) - 1
        if at >= 0 and lengths[at] == k and m < 2:
            at -= 1
        if at >= 0:
            best = max(best, k + lengths[at])
    return best


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence's pieces, in order) and how many sequences each has; every piece is in exactly one.

    The reduction fixes what it can prove; the rest goes best-fit decreasing: each length, from the longest, into the fullest sequences
    that have room, all equal sequences at once, else into new ones.
    """
    if any(k < 1 or k > capacity for k in counts):
        raise ValueError("a length is not between 1 and the capacity")
    left = _Lengths(counts)
    done = _reduce(left, capacity)
    open_: dict[int, list[list]] = {}  # room -> [pattern, sequences]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        for x in open_[room]:
            if x[0] == pattern:
                x[1] += n
                return
        open_[room].append([pattern, n])

    for w in reversed(left.order):
        n = left.n[w]
        while n:
            k = bisect.bisect_left(rooms, w)
            if k == len(rooms):
                each = min(capacity // w, n)
                put(capacity - each * w, (w,) * each, n // each)
                n -= n // each * each
                continue
            room = rooms[k]
            x = open_[room][-1]
            each = min(room // w, n)
            many = min(x[1], n // each)
            x[1] -= many
            pattern = x[0]
            if not x[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            put(room - each * w, (*pattern, *(w,) * each), many)
            n -= each * many
    return done + [(tuple(p), n) for xs in open_.values() for p, n in xs]


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks: pieces of a length with ranks from ``rank`` on lie ``each`` in a sequence, from sequence ``seq`` on, the
    first of them at ``offset``. Ordered by ``key`` = length and rank."""
    rows, next_rank, seq = [], {}, 0
    for pattern, n in plan:
        offset, k = 0, 0
        while k < len(pattern):
            w, each = pattern[k], 1
            while k + each < len(pattern) and pattern[k + each] == w:
                each += 1
            rank = next_rank.get(w, 0)
            rows.append((w, rank, each, seq, offset))
            next_rank[w] = rank + n * each
            offset, k = offset + w * each, k + each
        seq += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "rank": table[:, 1], "each": table[:, 2], "seq": table[:, 3], "offset": table[:, 4]}


_PIECES = "part long, doc_id long, piece int, start long, length long, ids_crc32 long, local long"


def tokenize_pieces(docs: DataFrame, vocab: str = "byte_bpe_50k", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, with ``part`` and ``local``, its rank among the pieces of its length in its partition.

    A document of more than ``capacity`` ids is cut from its end: all its pieces are full but, maybe, the first. A null text counts as
    empty. Lazy; to be materialised once, as the ranks hold for one run.
    """
    name, spaced = VOCABULARIES[vocab]
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("local", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokenizer, ranks = TaskContext.get().partitionId(), word_tokenizer(vocabulary(name), spaced), [0] * (capacity + 1)
        for batch in tidied((c for b in batches for c in in_slices(b)), tokenizing=True):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.batch(batch.column("text"), SPLIT_BYTES)):
                raw = memoryview(ids + end)
                n = len(raw) // 4
                stops = range(n - (n - 1) // capacity * capacity, n + 1, capacity)
                start = 0
                for k, stop in enumerate(stops):
                    rows.append((part, doc_id, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), ranks[stop - start]))
                    ranks[stop - start] += 1
                    start = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


def pack_documents(docs: DataFrame, vocab: str = "byte_bpe_50k", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    The texts are tokenised where they lie and never shuffled. The driver gets the histogram of lengths (at most ``capacity`` rows) and
    makes the plan. A piece's rank among those of its length is its rank in its partition plus what earlier partitions hold, so a length
    that a third of all pieces share makes no task larger. Null doc_ids and repeated rows are packed like any other; an empty table
    gives no rows; extra columns are ignored.
    """
    pieces = materialize(tokenize_pieces(docs, vocab, end_id, capacity), "pieces")
    held = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part")
    first = materialize(held.select("part", "length", "n", (F.sum("n").over(before) - F.col("n")).alias("first")), "pieces-first")
    counts = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan_packing(counts, capacity), capacity)
    ranks = join_small(pieces, first.drop("n"), ["part", "length"], "inner")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    lo = np.searchsorted(table["length"], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches, tokenizing=True):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(length), np.int64)
            for w in np.unique(length):
                mine = length == w
                at[mine] = lo[w] + np.searchsorted(table["rank"][lo[w] : lo[w + 1]], rank[mine], side="right") - 1
            k = rank - table["rank"][at]
            each = table["each"][at]
            seq, offset = table["seq"][at] + k // each, table["offset"][at] + k % each * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(seq), pa.array(offset)], schema=out)

    return ranks.select(*key, (F.col("local") + F.col("first")).alias("rank")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents packed."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
