from engrava.operators import clusters, ranking, retrieval
from engrava.streaming import events


def test_markdown_export_keeps_whole_contents(spark):
    long = "a line\n" + "x" * 500
    rows = spark.createDataFrame([(2, "b.md", "second"), (1, "b.md", long), (3, "", "none")], "id long, source_file string, content string")
    got = {r.id: (r.source_file, r.part) for r in ranking.markdown_export(rows).collect()}
    assert got == {1: ("b.md", f"## Source: b.md\n\n{long}\n\n"), 2: ("b.md", "second\n\n"), 3: ("Unknown Source", "## Source: Unknown Source\n\nnone\n\n")}


def go_score(content, query):
    text, terms = content.lower(), query.lower().split()
    counts = [text.count(t) for t in terms]
    if not any(counts):
        return 0.0
    boost = min(1.5, 1 + 0.1 * max(0, sum(counts) - len(terms)))
    return min(1.0, sum(c > 0 for c in counts) / len(terms) * boost + 0.2 * (query.lower() in text))


def test_watch_matches_counts_substrings_repeats_and_the_phrase(spark):
    watches = [(1, "deploy zebra"), (2, "log error rate"), (3, "C++ a"), (4, "aa bb cc dd")]
    texts = ["Deploy deployed redeploy deploy deploys deploy deploy", "logging errors rated", "the log error rate", "c++ and C", "aaaa bb", "nothing", "aa bb cc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    want = {(w, i, round(go_score(t, q), 6)) for w, q in watches for i, t in enumerate(texts) if round(go_score(t, q), 6) >= 0.7}
    assert (1, 0, 0.75) in want
    assert {tuple(r) for r in retrieval.watch_matches(rows, watches, 0.7).collect()} == want
    table = spark.createDataFrame(watches, "watch_id long, query string")
    assert {tuple(r) for r in events.watch_stream(rows, table).collect()} == want


def test_topic_clusters_have_every_subject(spark):
    rows = [(m, s) for m in (1, 2) for s in ("A", "b ", "c")] + [(3, "c"), (3, "d"), (4, "e")]
    got = clusters.topic_clusters(spark.createDataFrame(rows, "memory_id long, subject string"))
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e")]


def test_assign_by_subject_falls_back_on_the_memory(spark):
    facts = "id long, memory_id long, subject string, project_id string"
    known = spark.createDataFrame([(1, 1, "Ann", "p"), (2, 1, "Bob", "q"), (3, 1, "Cy", "q"), (4, 2, "Dee", "r")], facts)
    new = spark.createDataFrame([(10, 1, " ann", None), (11, 1, "New", None), (12, 2, "New", None), (13, 3, "New", None), (14, 2, " ", None)], facts)
    assert sorted(map(tuple, clusters.assign_by_subject(new, known).collect())) == [(10, "p"), (11, "q"), (12, "r")]


def test_similar_objects_is_the_greedy_choice(spark):
    import random

    from engrava.operators import admission

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def similarity(a, b):
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        p, q = set(a.split()), set(b.split())
        return max(len(p & q) / len(p | q), 1 - lev(a, b) / max(len(a), len(b)))

    rng = random.Random(3)
    bases = ["the quick brown fox jumps", "a slow red dog", "berlin office building", "one two three four five six seven eight nine ten"]
    facts = []
    for k in range(160):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice("abc ")
        facts.append((k, rng.choice(["Ann", " ann"]), rng.choice(["is", "has"]), "".join(text) if k % 20 else "", round(rng.random(), 1), None if k % 13 else 5))
    rows = spark.createDataFrame(facts, "id long, subject string, predicate string, object string, confidence double, superseded_by long").selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' AS created_at")
    want, winners = set(), {}
    norm = lambda s: " ".join(s.lower().split())
    for f in sorted((f for f in facts if f[5] is None), key=lambda f: (-f[4], f[0])):
        won = winners.setdefault((norm(f[1]), f[2]), [])
        best = max(((similarity(norm(w[3]), norm(f[3])), -n, w[0]) for n, w in enumerate(won)), default=(0, 0, 0))
        if best[0] >= 0.9:
            want.add((f[0], best[2], round(best[0], 9)))
        else:
            won.append(f)
    assert {(r.loser_id, r.winner_id, round(r.similarity, 9)) for r in admission.similar_objects(rows).collect()} == want and want


def test_binary_files_are_told_by_their_first_bytes(spark, tmp_path):
    from engrava.sources import documents

    (tmp_path / "late.txt").write_bytes(b"x" * 600 + b"\xff" + b" tail")
    (tmp_path / "cut.txt").write_bytes(b"y" * 511 + "é".encode() + b" end")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe" * 10)
    (tmp_path / "nul.txt").write_bytes(b"text\x00more")
    got = {r.path.rsplit("/", 1)[-1] for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert got == {"late.txt", "cut.txt"}
