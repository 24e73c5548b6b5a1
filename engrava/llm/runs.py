"""Periodic runs of words, by the suffix tree of Stoye and Gusfield.

A run is a stretch of consecutive words with smallest period q and a length of at least ``max(SHORTEST, 3 * q)`` that no neighbouring word extends keeping that
period. A task takes its texts in packs. The suffix trees of a pack's texts are one forest: suffixes are sorted by doubling, inner nodes are the intervals of the
longest common prefixes. In each node of depth q the leaves outside its largest child are held against those q words before and after them: two leaves of different
children that lie q apart are a branching tandem repeat of period q. Rotated to the left as far as it goes, a repeat becomes the maximal run that it ends.

A run that counts repeats 16 words of its text (its length less q is at least 16), so only texts with 16 words in a row twice get a tree; others have no run.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from engrava.llm.workers import tidied

SHORTEST, REPEATS = 24, 3
#: Words that a pack holds, unless one text alone has more.
PACK_WORDS = 1 << 18
_words = re.compile("[^\x20\x09-\x0d]+").findall
_nothing = hashlib.sha256(b"").hexdigest()
SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's words: every tenth id's text, by its hash, repeats from word ``a`` with period ``p``; a null id's text stays."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _numbered(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts in a row, with a number of its own after each text, and where texts start. Equal words of different texts differ."""
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    codes = pa.array(itertools.chain.from_iterable(texts), pa.string()).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    ids = np.full(starts[-1], len(codes.dictionary), np.int64)
    ids[np.delete(np.arange(len(ids)), starts[1:] - 1)] = codes.indices
    return ids + text * (len(codes.dictionary) + 1), starts


def _repeating(ids: np.ndarray, starts: np.ndarray, width_log: int = 4) -> np.ndarray:
    """Which texts hold ``2 ** width_log`` words in a row twice: equal windows are doubled, those met once are left out at each step."""
    at, n = np.arange(len(ids)), len(ids)
    names = ids
    for k in range(width_log + 1):
        if k:
            width = 1 << (k - 1)
            at = at[at + width < n]
            after = names[at + width]
            at, after = at[after >= 0], after[after >= 0]
            keys = names[at] * np.int64(n + 1) + after
        else:
            keys = names
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, bool)
        again = ~new
        again[:-1] |= ~new[1:]
        names = np.full(n, -1, np.int64)
        names[at[order[again]]] = np.cumsum(new)[again]
        at = np.sort(at[order[again]])
    found = np.zeros(len(starts) - 1, bool)
    found[np.searchsorted(starts, at, "right") - 1] = True
    return found


def _forest(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, its inverse, common prefixes of neighbours (0 before the first), and names of all windows of 1, 2, 4, ... words."""
    n = len(ids)
    names = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    while True:
        last, width = names[-1], 1 << (len(names) - 1)
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = last[width:].astype(np.int64) + 1
        keys = last * np.int64(n + 1) + after
        order = np.argsort(keys, kind="stable")
        new = np.concatenate([[0], (keys[order][1:] != keys[order][:-1]).cumsum()])
        rank = np.empty(n, np.int32)
        rank[order] = new
        if new[-1] == n - 1:
            break
        names.append(rank)
    common = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    for k in range(len(names) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(i, j) < n)
        same = inside[names[k][i[inside]] == names[k][j[inside]]]
        common[1 + same] += 1 << k
        i[same] += 1 << k
        j[same] += 1 << k
    return order, rank, common, names


def _smaller_children(common: np.ndarray) -> np.ndarray:
    """Rows ``depth, first, last, child's first, child's last`` for each child but the largest of each inner node below the root, as positions in the suffix array."""
    found: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, int, list[int]]] = [(0, 0, [])]
    for r, depth in enumerate(common.tolist() + [0]):
        if not r:
            continue
        first = r - 1
        while stack[-1][0] > depth:
            d, first, borders = stack.pop()
            if len(borders) == 1:
                middle = borders[0]
                found.append((d, first, r - 1, first, middle - 1) if 2 * middle < first + r else (d, first, r - 1, middle, r - 1))
                continue
            edges = [first, *borders, r]
            sizes = [b - a for a, b in zip(edges, edges[1:])]
            largest = sizes.index(max(sizes))
            found.extend((d, first, r - 1, a, b - 1) for k, (a, b) in enumerate(zip(edges, edges[1:])) if k != largest)
        if stack[-1][0] == depth:
            stack[-1][2].append(r)
        else:
            stack.append((depth, first, [r]))
    return np.array(found, np.int64).reshape(-1, 5)


def _tandem_repeats(ids: np.ndarray, order: np.ndarray, rank: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandem repeats: leaves outside a node's largest child against those one depth before and after."""
    n, found = len(ids), []
    children = _smaller_children(common)
    sizes = children[:, 4] - children[:, 3] + 1
    for part in np.array_split(np.arange(len(children)), 1 + int(sizes.sum()) // (1 << 22)):
        depth, first, last, a, _ = children[part].T
        each = np.repeat(np.arange(len(part)), sizes[part])
        leaf = order[a[each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])]
        q = depth[each]
        for left in (leaf, leaf - q):
            other = left + q if left is leaf else left
            ok = (left >= 0) & (left + q < n)
            at = rank[np.where(ok, other, 0)]
            ok &= (at >= first[each]) & (at <= last[each])
            left, period = left[ok], q[ok]
            # The end of a text has a number of its own, so a repeat never reads past it.
            branching = ids[left + period] != ids[np.minimum(left + 2 * period, n - 1)]
            found.append(np.stack([left[branching], period[branching]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1]


def find_runs(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of all runs of each text, by start, then period."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return runs
    ids, starts = _numbered(texts)
    found = _repeating(ids, starts)
    if not found.any():
        return runs
    some, sizes = np.flatnonzero(found), np.diff(starts)
    ids = ids[np.repeat(found, sizes)]
    starts = np.concatenate([[0], np.cumsum(sizes[found])])
    order, rank, common, names = _forest(ids)
    left, q = _tandem_repeats(ids, order, rank, common)
    end = left + 2 * q
    for k in range(len(names) - 1, -1, -1):  # rotate to the left, in steps of halving width
        back = left - (1 << k)
        ok = back >= 0
        ok[ok] = names[k][back[ok]] == names[k][back[ok] + q[ok]]
        left = np.where(ok, back, left)
    length = end - left
    keep = length >= np.maximum(SHORTEST, REPEATS * q)
    shortest: dict[tuple[int, int], int] = {}
    for a, n, p in sorted(zip(left[keep].tolist(), length[keep].tolist(), q[keep].tolist()), key=lambda x: -x[2]):
        shortest[a, n] = p  # a multiple of a run's period gives the same stretch
    for (a, n), p in sorted(shortest.items(), key=lambda x: (x[0][0], x[1])):
        text = int(np.searchsorted(starts, a, "right")) - 1
        runs[some[text]].append((a - int(starts[text]), n, p))
    return runs


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """Each run's first period stays; what any run holds after it goes."""
    drop = np.zeros(len(words) + 1, np.int64)
    for a, n, p in runs:
        drop[a + p] += 1
        drop[a + n] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d] if runs else words


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period, compared exactly; of equal ones the first, then the one of the shortest period."""
    best = None
    for a, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = (a, n, p)
    return best


def _rows(ids: list, texts: list[list[str]]) -> Iterator[tuple]:
    for doc_id, words, runs in zip(ids, texts, find_runs(texts)):
        best = strongest(runs)
        a, n, p = best or (None, None, None)
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
        kept = " ".join(collapsed(words, runs))
        digest = hashlib.sha256(lines.encode()).hexdigest() if runs else _nothing
        yield doc_id, len(words), len(runs), a, n, p, 1000 * n // p if best else None, digest, hashlib.sha256(kept.encode()).hexdigest()


def _packs(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[tuple[list, list[list[str]]]]:
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = _words(text.as_py() or "")
            words = planted(doc_id, words) if plant else words
            if held and held + len(words) > PACK_WORDS:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            held += len(words)
    if ids:
        yield ids, texts


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``doc_id, n_words, n_runs``, the strongest run's ``start, length, period, exponent_milli``, and digests of all runs and of the text without their repeats.

    One row per row; nothing is shuffled, a text is read whole where it lies. Null and empty texts have no words and no run; repeated rows fare alike, null ids
    are ids; an empty table gives no rows; extra columns are ignored. The memory of a text grows with its words times the logarithm of the longest passage that it
    repeats. ``plant`` puts the contract's repeats into every tenth text first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in tidied(_packs(batches, plant)):
            cols = list(zip(*_rows(ids, texts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 7 + [pa.string()] * 2)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op13_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True).drop("n_words")
