from engrava.operators import importing, keyword, vectors, writes

BIG = "/root/testdata/sf0.01"


def test_recall_of_the_vector_index(spark):
    rows = spark.read.parquet(f"{BIG}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    dim = len(rows.first().vector)
    found, queries = vectors.index(rows, dim), rows.where("id % 20 = 0")
    assert found.rows.where("t = 0").count() == rows.count()
    exact = vectors.brute(rows, queries, dim)
    assert vectors.recall(vectors.search(found, queries), exact) >= 0.9


def test_vectors_without_a_direction_are_left_out(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (None, [1.0, 0.0])], "id long, vector array<double>")
    found = vectors.index(rows.where("id IS NOT NULL"), 2, tables=4, bits=2)
    got = vectors.search(found, rows.where("id IN (1, 3, 4)"), k=5).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 2)}
    assert vectors.search(vectors.index(rows.limit(0), 2), rows.limit(0)).count() == 0


def test_repeated_keys_and_empty_tables(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "c")], "id long, v string")
    assert sorted(map(tuple, writes.added(table, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert writes.updated(table, new.limit(0)).count() == 2 and writes.numbered(table.limit(0), table).count() == 2
    with_null = spark.createDataFrame([(1, None)], "id long, v string")
    assert writes.updated(table, with_null).where("id = 1").first().v is None


def test_queries_are_parsed():
    assert keyword.parse('say "hello there" a') == (["say"], ["hello there"], [], [])
    assert keyword.parse("NOT bad good -worse AND pre* x-ray") == (["good", "ray"], [], ["bad", "worse"], ["pre"])


def test_keyword_search_on_small_texts(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox"), (2, "the lazy dog"), (3, "quick quick dogs"), (4, None), (5, "")], "id long, content string")
    found = keyword.index(rows, buckets=4, files=2)
    ids = lambda q: sorted((r.id, r.how) for r in keyword.search(found, rows, q).collect())
    assert ids("quick fox") == [(1, "and")]
    assert ids("lazy fox") == [(1, "or"), (2, "or")]
    assert ids("quick -fox") == [(3, "and")]
    assert ids('"quick brown"') == [(1, "and")] and ids("dog*") == [(2, "and"), (3, "and")]
    assert ids("uick") == [(1, "like"), (3, "like")] and ids("zebra") == []
    scores = {r.id: r.score for r in keyword.search(found, rows, "quick").collect()}
    assert scores[3] > scores[1] > 0
    assert keyword.search(keyword.index(rows.limit(0)), rows.limit(0), "quick").count() == 0


def test_flatten_and_front_matter(spark):
    rows = spark.createDataFrame([(1, '{"a": [1, {"b": null}], "c": true, "d": 1.5, "e": {}}'), (2, "[]"), (3, "no"), (4, '"x"'), (5, None)], "id long, value string")
    got = sorted((r.id, r.path, r.value) for r in importing.flatten(rows).collect())
    assert got == [(1, "a[0]", "1"), (1, "a[1].b", "null"), (1, "c", "true"), (1, "d", "1.5"), (4, "", "x")]
    texts = spark.createDataFrame([("---\nk: 1\nk: 2\nbad\n---\nbody",), ("---\nk: 1\nno end",), ("",), (None,)], "t string")
    from pyspark.sql import functions as F

    found = [r.f for r in texts.select(importing.front_matter(F.col("t")).alias("f")).collect()]
    assert (found[0].metadata, found[0].body.strip()) == ({"k": "2"}, "body") and found[1].body == "---\nk: 1\nno end" and found[2].body == "" and found[3].body is None


def test_exported_facts_are_whole_and_in_order(spark, tmp_path):
    from engrava.operators import exports
    from engrava.plans import views

    rows = views.facts(spark, "/root/testdata/sf0.001")
    exports.write_facts(rows, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == exports.FACT_COLUMNS and back.count() == rows.count()
    exports.write_facts(rows, f"{tmp_path}/json", "json")
    ids = [r.id for r in spark.read.json(f"{tmp_path}/json").orderBy("id").collect()]
    assert ids == sorted(r.id for r in rows.select("id").collect())
