import random

from engrava.operators.graph import connected_components
from engrava.operators.lifecycle import last_reinforced


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((1, 1), (40, 30), (300, 280)):
        pairs = [(rng.randrange(n) - 5, rng.randrange(n) - 5) for _ in range(m)] + [(7000 + k, 7001 + k) for k in range(25)] + [(9000, 9100 + k) for k in range(40)]
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        linked = {x for a, b in pairs if a != b for x in (a, b)}
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
        assert got == {x: find(x) for x in linked}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).count() == 0


def test_reinforcement_is_the_fold(spark):
    from datetime import datetime

    rows = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id long, created_at timestamp_ntz")
    log = spark.createDataFrame([(1, 1, "search", datetime(2024, 1, 11)), (2, 1, "import", datetime(2024, 1, 3))], "id long, fact_id long, access_type string, created_at timestamp_ntz")
    day, start = 86400.0, 1704067200.0
    at = 0 + 0.8 * (2 * day - 0)
    at += 0.3 * (10 * day - at)
    assert last_reinforced(rows, log).first().at == start + round(at, 1)
