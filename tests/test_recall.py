from engrava.operators import recall


def test_skip_packing_goes_on_past_a_large_item(spark):
    rows = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate([300, 400, 100, 50, 10])] + [(2, 1, 500)], "query_id int, rank int, tokens int")
    assert sorted((r.query_id, r.rank) for r in recall.skip_packing(rows, 3, 450).collect()) == [(1, 1), (1, 3), (1, 4)]


def test_overlapping_results_go(spark):
    base = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(1, 1, "a", base), (1, 2, "a", base + " more"), (1, 3, "b", base), (1, 4, "a", "other words here"), (1, 5, "a", "")], "query_id int, rank int, source_file string, content string")
    assert sorted(r.rank for r in recall.drop_overlapping(rows).collect()) == [1, 3, 4, 5]


def test_chunks_are_split_and_joined(spark):
    para = "word " * 60
    text = "tiny\n\n" + "\n\n".join([para] * 8) + "\n\n" + "x" * 4000 + "\n\nend"
    got = [r.text for r in recall.normalize_chunks(spark.createDataFrame([("p", text), ("q", None), ("r", "short")], "path string, content string")).orderBy("path", "position").collect()]
    assert got[-1] == "short" and got[0].startswith("tiny")
    assert all(len(x) <= 1600 for x in got) and "".join("".join(got[:-1]).split()) == "".join(text.split())


def test_history_ends_in_a_cycle(spark):
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, None), (4, 99)], "id long, superseded_by long")
    assert recall.fact_history(rows, 3).count() == 6
