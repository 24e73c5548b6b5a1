from collections import defaultdict

import numpy as np
import pytest

from engrava.llm import mixing
from tests.llm.helpers import SF, awkward, clashing, docs_of


def water(sizes, share=1.5, most=2.0):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    held = set()
    while True:
        free = [k for k in names if k not in held]
        rest = share * sum(sizes.values()) - sum(most * sizes[k] for k in held)
        total = sum(weight[k] for k in free)
        target = {k: most * sizes[k] if k in held else rest * weight[k] / total for k in names}
        over = [k for k in free if target[k] > most * sizes[k] + 1e-9]
        if not over:
            return target
        held |= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = {f"s{k}": int(rng.choice([0, rng.integers(1, 100), rng.integers(1, 10_000)])) for k in range(rng.integers(1, 12))}
    if seed % 2:
        sizes[None] = 77
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(water(sizes))


def slow_level(sizes, target, most=2.0):
    """c by bisection."""
    from math import floor

    x = [max(1, floor(mixing.STEPS * s / (s + mixing.HALF))) / mixing.STEPS for s in sizes]
    words = lambda c: sum(min(most, c * a) * s for a, s in zip(x, sizes))
    lo, hi = 0.0, most * mixing.STEPS
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if words(mid) < target else (lo, mid)
    return [min(most, lo * a) for a in x]


def test_expected_copies_and_how_often_documents_are_taken(spark):
    """Inclusion odds differ within a source; over many documents of a size the share that is taken is theirs."""
    rng = np.random.default_rng(3)
    rows = [(k, source, int(rng.choice([3, 20, 60, 300, 2000])), k) for source, n in (("a", 9000), ("b", 6000), ("c", 3000)) for k in range(n)]
    sized = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key long, source string, size long, one long, row long").withColumn("key", __import__("pyspark.sql.functions", fromlist=["xxhash64"]).xxhash64("source", "one"))
    got = mixing.mix(sized).collect()
    for source in "abc":
        mine = [r for r in got if r.source == source]
        want = slow_level([r.size for r in mine], mine[0].target)
        assert [r.expected for r in mine] == pytest.approx(want, rel=1e-9)
        assert len({round(e, 6) for e in want}) > 2
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 2000
        for size in (3, 20, 60, 300, 2000):
            of = [r for r in mine if r.size == size]
            p = of[0].expected % 1
            assert all(r.copies - int(r.expected) in (0, 1) for r in of)
            assert np.mean([r.copies for r in of]) == pytest.approx(of[0].expected, abs=4 * (max(p * (1 - p), 1e-4) / len(of)) ** 0.5 + 0.01)


def test_targets_of_many_sources(spark):
    sizes = {f"s{k}": k * 37 % 1009 for k in range(3000)}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    assert got == pytest.approx(water(sizes))


def test_op5(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = mixing.op5_pareto_mix(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len((rows[r.doc_id].text or "").encode().split()) and 0 <= r.taken <= 2 * r.size
        s = rows[r.doc_id].source
        sizes[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    target = water(sizes)
    for r in got:
        assert r.source_size == sizes[rows[r.doc_id].source] and r.target == pytest.approx(target[rows[r.doc_id].source])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))


def test_awkward_documents(spark):
    docs = awkward(spark)
    got = mixing.mix_sources(clashing(spark, docs))
    assert got.count() == docs.count()
    assert all(r.taken <= 2 * r.size for r in got.collect())
    mixed = mixing.mixed_documents(clashing(spark, docs))
    assert mixed.columns == clashing(spark, docs).columns
    words = sum(len((r.text or "").encode().split()) for r in mixed.collect())
    assert words == sum(r.taken for r in got.collect())
    assert mixing.mix_sources(docs_of(spark, [])).count() == mixing.mixed_documents(docs_of(spark, [])).count() == 0


def test_a_source_of_equal_rows(spark):
    docs = docs_of(spark, [(1, "a b c", "en", "hot")] * 900 + [(k, "one two three four", "en", "other") for k in range(50)])
    got = mixing.mix_sources(docs).collect()
    for size in (2700, 200):
        mine = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4


def test_the_plan_has_no_python(spark):
    plan = mixing.mixed_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
