"""Channels against brute force: overlapping ranges, bridges, shortest paths, neighbours."""

import itertools
import random
from collections import deque
from datetime import date, timedelta

from pyspark.sql import functions as F

from engrava.operators import channels, recall, vectors

DAY = date(1999, 12, 25)


def test_ranges_overlap_as_by_brute_force(spark):
    rng = random.Random(6)

    def some(n, first):
        rows = []
        for k in range(n):
            a = DAY + timedelta(rng.randint(-4000, 4000))
            rows.append((first + k, a, rng.choice([a, None, a + timedelta(rng.choice([0, 1, 6, 30, 365, 3650])), a - timedelta(1)])))
        return [*rows, (first + n, None, DAY), (first + n + 1, date(1, 1, 1), date(9999, 12, 30)), (first + n + 2, date(1, 1, 1), None)]

    left, right = some(60, 0), some(80, 1000)
    end = lambda r: r[2] or r[1]
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] and b[1] and end(a) >= a[1] and end(b) >= b[1] and a[1] <= end(b) and b[1] <= end(a))
    frame = lambda rows: spark.createDataFrame(rows, "id long, start date, end date")
    got = sorted(tuple(r) for r in channels.overlapping(frame(left), frame(right)).collect())
    assert got == want and len(want) > 100  # each pair once
    plan = channels.overlapping(frame(left), frame(right))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_range_is_few_pieces(spark):
    spans = spark.createDataFrame([(0, 3653), (5, 6), (1, 4_000_000)], "lo int, hi int").select("lo", "hi", channels._pieces("lo", "hi").alias("p")).collect()
    for r in spans:
        days = sum(1 << x.level for x in r.p)
        assert days == r.hi - r.lo and len(r.p) <= 2 * channels.LEVELS
        assert min(x.at << x.level for x in r.p) == r.lo
    assert [len(r.p) for r in spans][1] == 1


def test_temporal_channel_without_times_or_words(spark):
    facts = spark.createDataFrame([(1, 1, "a", "is", "b", 0.9, None, None, None), (2, 1, None, None, None, None, DAY, None, DAY), (3, 2, "zebra", "in", "zoo", 0.0, DAY, DAY, None)], "id long, memory_id long, subject string, predicate string, object string, confidence double, start date, end date, anchor date")
    queries = spark.createDataFrame([(1, "zebra", DAY, DAY), (2, "", None, None), (3, "nothing", DAY - timedelta(900), DAY - timedelta(800))], "query_id int, query string, start date, end date")
    got = {(r.query_id, r.memory_id): (r.score, r.fact_id) for r in channels.temporal_channel(facts, queries).collect()}
    assert got == {(1, 1): (round(0.35 + 1.1 + 0.1 + 0.75, 6), 2), (1, 2): (round(0.35 * 1.5 + 0.35 + 1.1, 6), 3), (2, 1): (0.45, 2), (2, 2): (0.35, 3)}


def test_bridges_by_all_pairs(spark):
    rng = random.Random(9)
    names = {e: rng.choice(["x", "y", f"n{e}"]) for e in range(8)}
    facts = [(k, rng.randrange(25), rng.randrange(8), rng.choice(["p", "Q ", "", "r", None]), rng.choice(["x", "y", "", "o1", "o2", "o3", None, f"z{k}"])) for k in range(70)]
    asked = [(1, e, names[e]) for e in (0, 1, 2)] + [(2, e, names[e]) for e in (3, 4)] + [(3, 5, names[5])] + [(4, e, names[e]) for e in (6, 7, 0)]
    low = lambda x: (x or "").strip().lower()
    want = {}
    for q in (1, 2, 3, 4):
        mine = [f for f in facts if any(a[0] == q and a[1] == f[2] for a in asked)]
        for a, b in itertools.permutations(mine, 2):
            if a[2] == b[2]:
                continue
            named = any((f[4] or "").lower() == names[f[2]].lower() for f in (a, b))
            score = 0.95 if a[1] == b[1] else 0.88 if low(a[4]) and low(a[4]) == low(b[4]) else 0.72 if low(a[3]) and low(a[3]) == low(b[3]) else 0.85 if named else 0
            if score > want.get((q, a[0]), 0):
                want[q, a[0]] = score
    got = channels.bridge_facts(spark.createDataFrame(facts, "id long, memory_id long, entity_id long, predicate string, object string"), spark.createDataFrame(asked, "query_id int, entity_id long, name string"))
    assert {(r.query_id, r.id): r.score for r in got.collect()} == want and len(set(want.values())) == 4


def test_shortest_paths_by_search(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(55)] + [(100, k) for k in range(0, 60, 3)] + [(7, 7), (200, 201)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def depths(start):
        found, todo = {start: 0}, deque([start])
        while todo:
            x = todo.popleft()
            for y in near.get(x, ()):
                if y not in found:
                    found[y] = found[x] + 1
                    todo.append(y)
        return found

    pairs = [(k, rng.randrange(60), rng.randrange(60)) for k in range(25)] + [(90, 5, 5), (91, 200, 1), (92, 999, 1), (93, 200, 201)]
    want = set()
    for k, a, b in pairs:
        x, y = depths(a), depths(b)
        d = x.get(b, 99)
        if d <= 5:
            want |= {(k, v, x[v], d) for v in x if v in y and x[v] + y[v] == d}
    got = channels.shortest_paths(spark.createDataFrame(edges, "source_fact_id long, target_fact_id long"), spark.createDataFrame(pairs, "pair_id int, source long, target long"), 5)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {r[3] for r in rows} >= {0, 1, 2, 3}


def test_neighbours_and_their_activation(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    got = channels.neighbour_edges(vectors.index(rows, 64), rows, 6, 0.5)
    exact = vectors.brute(rows, rows, 64, 6).where("cosine >= 0.5")
    pair = lambda df: {(r[0], r[1]) for r in df.collect()}
    assert len(pair(got) & pair(exact)) >= 0.9 * len(pair(exact))
    seeds = rows.where("id = 0").select(F.col("id").alias("node"), F.lit(1.0).alias("activation"))
    edges = [(r.source_fact_id, r.target_fact_id, r.confidence) for r in got.collect()]
    want = {0: 1.0}
    for _ in range(2):
        new = dict(want)
        for a, b, c in edges + [(b, a, c) for a, b, c in edges]:
            if a in want and want[a] * 0.7 * c >= 0.1:
                new[b] = max(new.get(b, 0), want[a] * 0.7 * c)
        want = new
    spread = {r.node: r.activation for r in recall.spread_activation(got, seeds).collect()}
    assert {k: round(v, 6) for k, v in spread.items()} == {k: round(v, 6) for k, v in want.items()}
    facts = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "id long, memory_id long")
    active = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.5), (1, 12, 0.05)], "query_id int, id long, activation double")
    assert [tuple(r) for r in channels.results_of_facts(active, facts, 0.1).collect()] == [(1, 1, 0.5, 10, 2)]
