"""Chunks, recall items, grouped context and exploration against plain folds."""

import random

import pytest
from pyspark.sql import functions as F

from engrava.operators import context


def slow_chunks(text, window, overlap=200):
    most = window * 3 // 4 * 4
    if not text:
        return []
    if len(text.encode()) // 4 <= window * 3 // 4:
        return [(0, text)]
    out, pos = [], 0
    while True:
        end = min(pos + most, len(text))
        if end < len(text):
            at = text[pos:end].rfind("\n\n", most * 2 // 3)
            end = pos + at if at >= 0 else end
        out.append((pos, text[pos:end]))
        if end >= len(text):
            return [x for x in out if x[1].strip()]
        pos = end - overlap


def test_chunks_tile_every_text(spark):
    rng = random.Random(3)
    texts = [None, "", "short", "x" * 1200, "x" * 1201, "é" * 700, "a\n\n" * 900, " " * 5000, "\n\n" * 2000]
    texts += ["".join(rng.choice(["word ", "\n\n", "\n", "é"]) for _ in range(rng.randint(100, 2500))) for _ in range(25)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    got = {}
    for r in context.overlapping_chunks(rows, 400).orderBy("id", "start").collect():
        got.setdefault(r.id, []).append((r.start, r.text))
    for k, text in enumerate(texts):
        assert got.get(k, []) == slow_chunks(text, 400), k
        pieces = got.get(k, [])
        assert all(b[0] == a[0] + len(a[1]) - 200 for a, b in zip(pieces, pieces[1:]))
    with pytest.raises(ValueError):
        context.overlapping_chunks(rows, 100)


def test_grouped_context_by_a_plain_fold(spark):
    rng = random.Random(7)
    items = [(q, r + 1, rng.choice(["s1", "s2", "é", "s3"]), f"f{r}", rng.random(), rng.choice("aé") * rng.choice([5, 60, 300, 900])) for q in range(12) for r in range(rng.randint(1, 9))]
    want = {}
    for q in range(12):
        groups = {}
        for _, rank, scene, source, score, content in sorted(x for x in items if x[0] == q):
            groups.setdefault(scene, []).append(f"[{rank}] source:{source} score:{score:.2f}\n{content[:200]}")
        left, texts = 900, []
        for i, (scene, blocks) in enumerate(groups.items()):
            lines = [f"Source group {i + 1} — {scene}"]
            for b in blocks:
                if len("\n\n".join([*lines, b]).encode()) + 1 > left:
                    break
                lines.append(b)
            if len(lines) == 1:
                continue
            text = "\n\n".join(lines)
            if len(text.encode()) + 2 > left:
                break
            texts.append(text)
            left -= len(text.encode()) + 2
        want[q] = "\n\n".join(texts)
    got = context.grouped_context(spark.createDataFrame(items, "query_id int, rank int, scene string, source string, score double, content string"), 900, 200)
    assert {r.query_id: r.context for r in got.collect()} == want and len({len(x) for x in want.values()}) > 5


def test_recall_order(spark):
    items = spark.createDataFrame(
        [
            (1, 1, 0.5, "core", "preference", "I prefer the dark theme", [7], ["preference"], "prompt_safe"),
            (1, 2, 0.9, "core", "rule", "always use tabs", [], [], "evidence_only"),
            (1, 3, 0.5, "capture", "preference", "theme " * 200, [8], ["kv"], "evidence_only"),
            (2, 1, 0.5, "core", "preference", "I prefer the dark theme", [7], ["preference"], "prompt_safe"),
            (2, 2, 0.9, "core", "rule", "always use tabs", [], [], "evidence_only"),
        ],
        "query_id int, id long, score double, source_tier string, memory_class string, content string, fact_ids array<long>, fact_types array<string>, visibility string",
    )
    queries = spark.createDataFrame([(1, "What theme do I prefer?"), (2, "tabs policy")], "query_id int, query string")
    got = {(r.query_id, r.id): (r.rank_score, r["rank"]) for r in context.recall_rank(items, queries).collect()}
    # Focus of the first: theme, prefer. Of the second: tabs, policy.
    assert got[1, 1] == (round(0.5 + 0.10 + 0.18 + 0.95 * 1.0 + 0.25, 9), 1)
    assert got[1, 2] == (round(0.9 - 0.18 - 0.45 - 0.20, 9), 3)
    assert got[1, 3] == (round(0.5 + 0.18 + 0.65 * 0.5 - 0.10 + 0.125 - (300 - 70) / 500, 9), 2)
    assert got[2, 1] == (0.6, 2) and got[2, 2] == (round(0.9 + 0.70 * 0.5, 9), 1)


def test_exploration_with_a_hub(spark):
    rng = random.Random(5)
    edges = [(0, k, "relates_to", round(rng.random(), 3)) for k in range(1, 120)] + [(rng.randrange(120), rng.randrange(120), "supports", round(rng.random(), 3)) for _ in range(240)]
    facts = {k: round(rng.random(), 3) for k in range(115)}
    best = {}
    for a, b, _, c in edges:
        for x, y in ((a, b), (b, a)):
            if x != y and c >= 0.2:
                best[x, y] = max(best.get((x, y), 0), c)
    near = {}
    for (a, b), c in best.items():
        near.setdefault(a, []).append((-c, b))
    roots = [(1, 0), (2, 5), (2, 6), (3, 119), (4, 50)]
    kept_want, edges_want = set(), set()
    for root in {r for r, _ in roots}:
        hops = {n: 0 for r, n in roots if r == root and n in facts}
        todo = list(hops)
        for hop in (1, 2):
            new = {b for n in todo for _, b in sorted(near.get(n, []))[:4] if b in facts and b not in hops}
            hops |= {b: hop for b in new}
            todo = list(new)
        kept = sorted(hops, key=lambda n: (hops[n], -facts[n], n))[:12]
        kept_want |= {(root, n, hops[n], facts[n], i + 1) for i, n in enumerate(kept)}
        for a, b, t, c in edges:
            if c >= 0.2 and a in kept and b in kept:
                top = max(x[3] for x in edges if x[:3] == (a, b, t))
                edges_want.add((root, a, b, t, top))
    e = spark.createDataFrame(edges, "source_fact_id long, target_fact_id long, edge_type string, confidence double")
    f = spark.createDataFrame([(k, c, f" S{k % 9}") for k, c in facts.items()], "id long, confidence double, subject string")
    nodes, between = context.explore(e, f, spark.createDataFrame(roots, "root int, node long"), 2, 4, 12, 0.2)
    assert {tuple(r) for r in nodes.collect()} == kept_want
    assert {tuple(r) for r in between.select("root", "source_fact_id", "target_fact_id", "edge_type", "confidence").collect()} == edges_want
    named = {r.subject for r in context.connected_subjects(nodes, f).where(F.col("root") == 1).collect()}
    assert " S0" not in named and named


@pytest.mark.parametrize("threshold", [0.7, 0.3, 1.0, 0.05])
def test_watches_by_their_index(spark, threshold, monkeypatch):
    from engrava.operators import retrieval

    monkeypatch.setattr(retrieval, "FEW_RUNS", 256 if threshold > 0.5 else 2)

    rng = random.Random(11)
    words = ["alpha", "Beta", "é", "ab", "gam", "xyz", "the", "aaaa", "q"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) if k else None) for k in range(60)]
    watches = [(k, " ".join(rng.choice([*words, "zzz", "lph", "ta x"]) for _ in range(rng.randint(1, 4)))) for k in range(40)] + [(90, ""), (91, "  ")]
    df, table = spark.createDataFrame(rows, "id long, content string"), spark.createDataFrame(watches, "watch_id long, query string")
    score = F.round(retrieval.watch_score(F.col("content"), F.col("query")), 6)
    want = df.crossJoin(table).select("watch_id", "id", score.alias("score")).where(F.col("score") >= threshold)
    got = retrieval.watch_matches(df, table, threshold)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not want.isEmpty()
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
