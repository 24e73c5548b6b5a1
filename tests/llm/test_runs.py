"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

from engrava.llm.runs import collapsed, find_runs, op13_suffix_runs, periodic_runs, strongest
from tests.llm.helpers import SF, awkward, clashing, docs_of

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(w):
    """Every maximal stretch of every period; of equal stretches the shortest period."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        a = 0
        while a + q < len(w):
            b = a
            while b + q < len(w) and w[b] == w[b + q]:
                b += 1
            if b > a and b + q - a >= max(24, 3 * q):
                found.setdefault((a, b + q - a), q)
            a = max(b, a + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    drop = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_random_texts_with_planted_repeats():
    rnd, total = random.Random(5), 0
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            n = rnd.randint(0, 150)
            w = [str(rnd.randrange(rnd.choice([1, 2, 3, 5]))) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n else 0):
                a, p, m = rnd.randrange(n), rnd.randint(1, 12), rnd.randint(1, 100)
                for i in range(a + p, min(n, a + m)):
                    w[i] = w[i - p]
            texts.append(w)
        want = [brute(w) for w in texts]
        assert find_runs(texts) == want
        total += sum(map(len, want))
    assert total > 100


def test_the_bounds_of_a_run():
    x = [f"w{k}" for k in range(50)]
    assert find_runs([["a"] * 23, ["a"] * 24, x[:8] * 3, x[:8] * 2 + x[:7], x[:9] * 3, (x[:9] * 3)[:-1]]) == [[], [(0, 24, 1)], [(0, 24, 8)], [], [(0, 27, 9)], []]
    assert find_runs([]) == [] and find_runs([[], []]) == [[], []]


def test_multiples_of_a_period_and_neighbouring_runs():
    w = ["q"] + ["a", "b"] * 20 + ["a", "c", "d"] * 9 + ["z"]
    assert find_runs([w])[0] == brute(w) and len(brute(w)) == 2
    assert collapsed(w, brute(w)) == [x for i, x in enumerate(w) if not any(a + q <= i < a + n for a, n, q in brute(w))]


def test_strongest_is_exact():
    assert strongest([(0, 30, 10), (5, 24, 8), (40, 3 * 10**17 + 1, 10**17)]) == (40, 3 * 10**17 + 1, 10**17)
    assert strongest([(0, 30, 10), (5, 24, 8)]) == (0, 30, 10) and strongest([]) is None


def test_long_repeats():
    w = ["x"] + [f"w{k % 700}" for k in range(40_000)] + ["y"] * 5_000
    assert find_runs([w, w[:100]]) == [[(1, 40_000, 700), (40_001, 5_000, 1)], []]


def test_awkward_tables(spark):
    for df in (awkward(spark), clashing(spark, awkward(spark))):
        got = sorted(map(tuple, periodic_runs(df).drop("n_words").collect()), key=repr)
        want = [brute_row(r.doc_id, r.text, False) for r in awkward(spark).collect() if len(r.text or "") < 1000]
        assert [r for r in got if r[0] not in (5, 6)] == sorted(want, key=repr)
        assert [r[1:6] for r in got if r[0] in (5, 6)] == [(1, 0, 60_000, 997, 60180)] * 3
    assert periodic_runs(docs_of(spark, [])).count() == 0


def test_query_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r) for r in op13_suffix_runs(spark, SF).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    small = [r for r in rows if len(r.text or "") < 6000]
    assert [got[r.doc_id] for r in small] == [brute_row(r.doc_id, r.text, True) for r in small]
    assert sum(r[1] for r in got.values()) > 5
