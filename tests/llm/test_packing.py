import random
import zlib
from collections import Counter

import numpy as np
import pytest

from engrava.llm import packing
from tests.llm.helpers import SF, awkward, clashing, docs_of
from tests.llm.test_tokens import plain


def fewest(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= items[k]:
                at = rooms.index(r)
                rooms[at] -= items[k]
                go(k + 1, rooms)
                rooms[at] += items[k]
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(150))
def test_reduction_loses_nothing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 12, 20])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
    left = packing._Lengths(Counter(items))
    fixed = packing._reduce(left, capacity)
    rest = [k for k, n in left.n.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity)
    plan = packing.plan_packing(Counter(items), capacity)
    got = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= capacity
        got.update({k: n * c for k, c in Counter(pattern).items()})
    assert got == Counter(items)


def fewest_at_least(lengths, capacity=1024):
    """Martello and Toth's bound L2: pieces over half a sequence lie alone, and the rest fills what they leave or takes sequences of its own."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = [x for x in lengths if x > capacity / 2]
        room = sum(capacity - x for x in alone if x <= capacity - k)
        best = max(best, len(alone) + max(0, -(-(sum(x for x in lengths if k <= x <= capacity / 2) - room) // capacity)))
    return best


def check(rows, got, ids, capacity=1024):
    want = []
    for doc_id, text in rows:
        mine = [*ids(text), 2]
        first = len(mine) - (len(mine) - 1) // capacity * capacity
        cuts = [0, *range(first, len(mine) + 1, capacity)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(mine[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= capacity
    return len(sequences), fewest_at_least([r[3] for r in want], capacity)


def test_op10_packs_every_piece(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, least = check(rows, packing.op10_best_fit(spark, SF).collect(), plain("byte_bpe_50k")[1])
    assert n <= least * 1.01 + 1


def test_awkward_documents(spark):
    docs = awkward(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], packing.pack_documents(clashing(spark, docs)).collect(), plain("byte_bpe_50k")[1])


def test_many_equal_lengths(spark):
    docs = docs_of(spark, [(k % 7, None) for k in range(3000)]).repartition(5)
    n, least = check([(r.doc_id, r.text) for r in docs.collect()], packing.pack_documents(docs).collect(), plain("byte_bpe_50k")[1])
    assert n == least == 3


def test_lengths_out_of_range():
    with pytest.raises(ValueError):
        packing.plan_packing({0: 1})
