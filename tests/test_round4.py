"""Forms in dense ranges of digits: what meets is what is alike."""

from engrava.operators import admission


def test_forms_one_edit_apart_meet_only_each_other(spark):
    names = [f"customer{k:09d}" for k in range(0, 1500, 1)] + [f"customer{k:08d}" for k in range(40)] + ["aab", "ab", "customer00000001x1", "ünïcödé fórm", "ünïcödé fôrm", "a" * 12, "a" * 13]
    forms = spark.createDataFrame([("g" if k % 3 else "h", "p", o, (float(-(k % 4)), k), k) for k, o in enumerate(names)], "s string, p string, o string, rank struct<c: double, id: long>, node long")

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b))))

    group = lambda k: k % 3 == 0
    want = {(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if group(a) == group(b) and 10 <= max(len(names[a]), len(names[b])) <= 19 and apart(names[a], names[b])}
    met = [tuple(sorted((r.x, r.y))) for r in admission._one_edit(forms, 0.9).collect()]
    assert len(met) == len(set(met)) and set(met) == want and any(len(names[a]) != len(names[b]) for a, b in want)
    got = {tuple(sorted((r["first"], r.node))) for r in admission._similar_pairs(forms, 0.9).collect()}
    assert got == want


def test_temporal_channel_by_all_pairs(spark):
    import random
    from datetime import date, timedelta

    from pyspark.sql import functions as F

    from engrava.operators import channels

    rng = random.Random(8)
    day = date(1999, 12, 25)
    some = lambda: rng.choice([None, day + timedelta(rng.randint(-300, 300))])
    facts = []
    for k in range(700):
        start = some()
        facts.append((k, rng.randrange(260), rng.choice(["Ann", "Joann", None]), rng.choice(["is", "isle of"]), rng.choice(["zebra", "Zoo keeper", "big zoo"]), rng.choice([0.2, 0.5, 0.9]), start, start and rng.choice([None, start + timedelta(rng.choice([-1, 0, 1, 40, 400]))]), some()))
    # Held within words: "zeb", "ann is", "oann isle"; beside other signs: "zoo,".
    texts = ["zebra", "zeb", "ann is", "oann isle", "ann is zebra", "zoo,", "--", "", None, "nothing of it", "keeper zoo"]
    queries = [(n, t, start, start and rng.choice([None, start + timedelta(rng.choice([-1, 0, 20, 90]))])) for n, (t, start) in enumerate((t, some()) for t in texts * 3)]
    f = spark.createDataFrame(facts, "id long, memory_id long, subject string, predicate string, object string, confidence double, start date, end date, anchor date")
    q = spark.createDataFrame(queries, "query_id int, query string, start date, end date")
    like = {(r.query_id, r.id): r.x for r in f.crossJoin(q.select("query_id", "query")).select("query_id", "id", F.coalesce(channels.text_score(F.coalesce("query", F.lit("")), F.col("subject"), F.col("predicate"), F.col("object")), F.lit(0.0)).alias("x")).collect()}
    want = set()
    for n, _, a, b in queries:
        b, found = b or a, {}
        for i, m, _, _, _, sure, start, end, anchor in facts:
            end = end or start
            timed = bool(a and start and a <= b and start <= end and start <= b and end >= a)
            dated = bool(a and anchor and a <= anchor <= b)
            score = round(0.35 * like[n, i] + 0.35 * (start is not None) + 0.1 * (anchor is not None) + 0.15 * sure + 1.1 * timed + 0.75 * dated, 5)
            if score > 0 and (a is None or score >= 0.55):
                found[m] = max(found.get(m, (0, 0)), (score, -i))
        for rank, (m, (score, i)) in enumerate(sorted(found.items(), key=lambda x: (-x[1][0], x[0]))[:20], 1):
            want.add((n, m, score, -i, rank))
    got = {(r.query_id, r.memory_id, round(r.score, 5), r.fact_id, r.rank) for r in channels.temporal_channel(f, q).collect()}
    assert got == want and len(got) > 400


def test_similar_objects_broadcasts_only_what_was_counted(spark, monkeypatch):
    from engrava.plans.storage import join_small

    plans = []

    def written(df, name, keep=False, materialize=admission.materialize):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name, keep)

    monkeypatch.setattr(admission, "materialize", written)
    monkeypatch.setattr(admission, "join_small", lambda big, small, on, how="left": join_small(big, small, on, how, rows=0))
    names = [*(f"customer{7 * k:09d}" for k in range(30)), *(f"a longer name of several words {7 * k:04d}" for k in range(10))]
    facts = [(k, "s", "p", o, (k % 7) / 7, None) for k, o in enumerate(names)]
    rows = spark.createDataFrame(facts, "id long, subject string, predicate string, object string, confidence double, superseded_by long").selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' AS created_at")
    got = admission.similar_objects(rows)
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert [name for name, plan in plans if "Broadcast" in plan] == [] and any("SortMergeJoin" in plan for _, plan in plans)
    assert got.count() > 5


def _side(rng, size, memories, most):
    import numpy as np
    import pyarrow as pa

    held = [np.unique(rng.integers(0, memories, rng.integers(1, most))) for _ in range(size)]
    return held, pa.table({"s": [f"{size}-{k}" for k in range(size)], "ms": pa.array(held, pa.list_(pa.int64()))})


def test_memories_meet_whole_one_by_one_and_by_bits(monkeypatch):
    import numpy as np

    from engrava.operators import meetings

    rng = np.random.default_rng(3)
    for memories, most in ((40, 12), (900, 400), (5000, 9)):
        (xs, a), (ys, b) = _side(rng, 90, memories, most), _side(rng, 210, memories, most)
        for same, left, right, other in ((False, a, b, ys), (True, a, a, xs)):
            shared = {(i, j): n for i, x in enumerate(xs) for j, y in enumerate(other) if (not same or j > i) and (n := len(np.intersect1d(x, y)))}
            for many, share, held, at_once in ((64, 300, 64 << 20, 2_000_000), (1, 1 << 30, 2000, 500), (1, 1 << 30, 64 << 20, 500), (1 << 30, 1, 0, 900)):
                for name, value in (("MANY", many), ("MANY_SHARE", share), ("FLAG_BYTES", held), ("AT_ONCE", at_once)):
                    monkeypatch.setattr(meetings, name, value)
                for least in (1, 2, 3):
                    got = [t for x, y, n in meetings._meet(left, right, same, least) for t in zip(x.tolist(), y.tolist(), n.tolist())]
                    assert len(got) == len(set(got)) and {(i, j): n for i, j, n in got} == {p: n for p, n in shared.items() if n >= least}
                    strong = [t for x, y in meetings._strong(left, right, same, least, lambda: np.zeros(len(other), bool)) for t in zip(x.tolist(), y.tolist())]
                    assert {(i, j) for i, j in strong if not same or j > i} == {p for p, n in shared.items() if n >= least} and strong == sorted(strong, key=lambda t: t[0])
                    one = np.arange(len(other)) % 3 > 0
                    fewer = {t for x, y in meetings._strong(left, right, same, least, lambda: one) for t in zip(x.tolist(), y.tolist())}
                    for i in range(len(xs)):  # all that aren't known as one, and one at least of those that are
                        mine = {j for k, j in strong if k == i}
                        assert {j for k, j in fewer if k == i and not one[j]} == {j for j in mine if not one[j]}
                        assert bool([j for k, j in fewer if k == i and one[j]]) == bool([j for j in mine if one[j]])
