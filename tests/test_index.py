"""Batch search against single searches, and stored indexes against ones made anew."""

import re
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from engrava.operators import batch_search, keyword, stored, vectors
from engrava.plans import versions

QUERIES = ["the of", 'the "of the"', "and -the", "NOT AND the and", "co* the", "in", "the zzznowhere", "zzznowhere", "", '"', "é", "- *", '"the" NOT "x y" of', "THE Of AND to OR in -and -of zz*", "th* -the", "a b c", '"zzz of" the', "x*y the*"]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    some = spark.createDataFrame([(10_001, ""), (10_002, None), (10_003, "the"), (10_004, "- * \" literal")], "id long, content string")
    return docs.unionByName(some)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")


def listed(df, *names):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in df.collect())


def test_parsing_is_that_of_single_searches(spark, asked):
    got = {}
    for r in batch_search.parsed(asked).collect():
        got.setdefault(r.query_id, set()).add((r.kind, r.term))
    for k, text in enumerate(QUERIES):
        q = keyword.parse(text)
        words = {w for w in [*q.must, *(w for p in q.phrases for w in p.split())] if len(w) > 1}
        want = {("must", w) for w in words} | {("phrase", p) for p in q.phrases} | {("without", w) for w in q.without} | {("prefix", p) for p in q.prefixes}
        assert got.get(k, set()) == want, text


@pytest.mark.parametrize("block, first", [(512, 4), (8, 1)])
def test_equals_single_searches(spark, rows, asked, monkeypatch, block, first):
    monkeypatch.setattr(batch_search, "BLOCK", block)
    monkeypatch.setattr(batch_search, "FIRST", first)
    index = keyword.index(rows, 8, 2)
    got = batch_search.search_all(index, rows, asked, 7)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 6), r.how))
    for k, text in enumerate(QUERIES):
        single = [(round(r.score, 9), r.id, r.how) for r in keyword.search(index, rows, text).collect()]
        single = sorted(single, key=lambda x: (-x[0], x[1]))[:7]
        assert sorted(by.get(k, [])) == [(n + 1, i, round(s, 6), how) for n, (s, i, how) in enumerate(single)], text


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "Alpha"), (2, "beta noise"), (3, "gamma"), (4, "alpha beta")], "id int, content string")
    results = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (1, 4, 3), (2, 3, 1)], "query_id int, id int, rank int")
    cases = spark.createDataFrame([(1, ["ALPHA", ""], 2, 1, 0.5, 0), (2, ["alpha"], 1, 1, 0.0, 0), (3, ["x"], 5, 1, 0.0, 0)], "query_id int, expected array<string>, k int, min_hits int, min_precision double, max_noisy int")
    out = batch_search.evaluate(results, rows, cases, ["NOISE"])
    assert listed(out, *out.columns) == [(1, 3, 1, 0.5, 0.5, 1, False), (2, 1, 0, 0.0, 0.0, 0, True), (3, 0, 0, 0.0, 0.0, 0, False)]
    assert tuple(batch_search.summary(out).first()) == (3, 1, 0.333333, 0.166667, 0.166667, 1)


def postings(index):
    return listed(index.postings, "term", "id", "tf", "length"), listed(index.totals, "docs", "average")


def test_stored_keyword_index_is_one_made_anew(spark, rows, tmp_path):
    path = f"file://{tmp_path}/k"
    v = stored.create_keyword(spark, path)
    assert postings(stored.open_keyword(spark, path))[0] == []
    v = stored.append_keyword(v, rows.where("id % 2 = 0"))
    early = postings(stored.open_keyword(spark, path))
    v = stored.append_keyword(v, rows.where("id % 2 = 1"))
    changed = rows.where("id % 5 = 0").withColumn("content", F.lit("new contents here"))
    v = stored.append_keyword(v, changed)
    v = stored.delete(v, spark.range(0, 60).toDF("id"))
    want = rows.where("id >= 60").withColumn("content", F.when(F.col("id") % 5 == 0, "new contents here").otherwise(F.coalesce("content", F.lit(""))))
    fresh = postings(keyword.index(want, 16, 2))
    assert postings(stored.open_keyword(spark, path)) == fresh
    c = stored.compact_keyword(spark, v)
    assert postings(stored.open_keyword(spark, path)) == fresh and len(c.segments) == 1
    assert postings(stored.open_keyword(spark, path, 1)) == early  # a reader of an old version isn't disturbed
    assert versions.vacuum(spark, path) == 4 and postings(stored.open_keyword(spark, path)) == fresh
    with pytest.raises(FileNotFoundError):
        stored.open_keyword(spark, path, 1)
    back = stored.append_keyword(versions.open_version(spark, path), rows.where("id = 0"))
    assert stored.open_keyword(spark, path).postings.where("id = 0").count() > 0 and back.number == c.number + 1


def test_two_writers(spark, rows, tmp_path):
    v = stored.create_keyword(spark, f"file://{tmp_path}/w")
    stored.append_keyword(v, rows.where("id = 1"))
    with pytest.raises(FileExistsError):
        stored.append_keyword(v, rows.where("id = 2"))
    assert [r.id for r in stored.open_keyword(spark, f"file://{tmp_path}/w").postings.select("id").distinct().collect()] == [1]
    with pytest.raises(FileNotFoundError):
        versions.open_version(spark, f"file://{tmp_path}/nothing")


def test_another_session_opens_it(spark, rows, tmp_path):
    stored.append_keyword(stored.create_keyword(spark, f"file://{tmp_path}/s"), rows)
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from engrava.operators import stored
print("HELD", stored.open_keyword(spark, "file://{tmp_path}/s").totals.first().docs)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=__file__.rpartition("/tests/")[0])
    assert f"HELD {rows.count()}" in out.stdout, out.stderr[-2000:]


def test_stored_vectors_keep_their_recall(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path, asked = f"file://{tmp_path}/v", rows.where("id % 20 = 0 and id >= 100")
    v = stored.create_vectors(spark, path, 64)
    v = stored.append_vectors(v, rows.where("id % 2 = 0"))
    v = stored.append_vectors(v, rows.where("id % 2 = 1"))
    v = stored.append_vectors(v, rows.where("id % 7 = 0").withColumn("vector", F.transform("vector", lambda x: -x)))
    v = stored.delete(v, rows.where("id < 100").select("id"))
    now = rows.where("id >= 100").withColumn("vector", F.when(F.col("id") % 7 == 0, F.transform("vector", lambda x: -x)).otherwise(F.col("vector")))
    exact = vectors.brute(now, asked, 64)
    found = vectors.search(stored.open_vectors(spark, path), asked)
    assert vectors.recall(found, exact) >= 0.9 and found.where("id < 100").isEmpty()
    stored.compact_vectors(spark, v)
    assert vectors.recall(vectors.search(stored.open_vectors(spark, path), asked), exact) >= 0.9


def test_postings_are_dealt_once_a_row_for_each_text_and_bucket(spark):
    from engrava.functions import text as T

    texts = [(k, " ".join(f"w{(k * j) % 37}" for j in range(k))) for k in range(60)] + [(7, "again w3 w3"), (7, "again w3 w3"), (99, None)]
    words = spark.createDataFrame(texts, "id long, content string").select("id", T.tokens(F.col("content")).alias("w"))
    found = keyword.postings_of(words, 16, 4)
    want = {}
    for i, t in texts:
        w = re.findall("[a-z0-9]{2,}", t or "")
        for x in set(w):
            at = (i, x, len(w))
            want[at] = want.get(at, 0) + w.count(x)
    assert {(r.id, r.term, r.length): r.tf for r in found.collect()} == want and found.count() == len(want)
    assert all(r.bucket == zlib.crc32(r.term.encode()) % 16 for r in found.collect())
    fresh = keyword.postings_of(words, 16, 4)  # its plan isn't run yet
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_search_reads_the_postings_once(spark):
    rows = spark.createDataFrame([(1, "the common cat"), (2, "the cat"), (3, "a comet, the comet"), (3, "a comet, the comet")], "id long, content string")
    found = keyword.search(keyword.index(rows), rows, "the com*")
    assert "postings" not in found._jdf.queryExecution().optimizedPlan().toString() and not [x for x in found.inputFiles() if "/postings-" in x and "keyword" not in x]
    assert sorted((r.id, r.how) for r in found.collect()) == [(1, "and"), (3, "and")]
    assert [r.id for r in keyword.search(keyword.index(rows), rows, '"the cat" -common').collect()] == [2]
