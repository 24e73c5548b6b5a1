"""Incremental import and components: replays, restarts, and equality with what is made anew."""

import random
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engrava.operators import admission, graph, incremental
from engrava.plans import ranks, storage, versions
from engrava.streaming import sync


def record(spark, *rows):
    """Rows are (external_id, content, minute), with deleted or not, and a source."""
    full = [(r[0], r[4] if len(r) > 4 else "a.md", r[1], "", "p", "", datetime(2024, 1, 1, 0, r[2]), len(r) > 3 and bool(r[3])) for r in rows]
    return spark.createDataFrame(full, sync.RECORD)


def contents(spark, path):
    return sorted(r.content for r in sync.table(spark, path, "memories").collect())


def outcomes(spark, path):
    row = sync.table(spark, path, "ledger").orderBy(F.desc("batch")).first()
    return row.fetched, row.imported, row.replaced, row.unchanged, row.stale, row.duplicate, row.deleted


def test_batches_of_records(spark, tmp_path):
    path = f"file://{tmp_path}/sync"
    sync.create(spark, path)
    first = record(spark, ("x", "Name: Ann\n\nmore text", 1), ("y", "second", 1), ("z", "third", 1), ("x", "older", 0), ("yz", "second", 1), (None, "lost", 1))
    v1 = sync.sync(spark, path, "hub", first, 0)
    assert contents(spark, path) == ["Name: Ann\n\nmore text", "second", "third"] and outcomes(spark, path) == (5, 3, 0, 0, 0, 1, 0)
    assert sync.since(spark, path, "hub") == "2024-01-01 00:01:00" and sync.since(spark, path, "other") is None
    assert [r.object for r in sync.table(spark, path, "facts").collect()] == ["Ann"] and sync.table(spark, path, "chunks").count() == 4
    assert sync.sync(spark, path, "hub", first, 0).number == v1.number  # the ledger has it
    sync.sync(spark, path, "hub", first, 1)  # the same contents under another number
    assert contents(spark, path) == ["Name: Ann\n\nmore text", "second", "third"] and outcomes(spark, path) == (5, 0, 0, 3, 0, 1, 0)
    ids = {r.external_id: r.id for r in sync.table(spark, path, "records").collect()}
    sync.sync(spark, path, "hub", record(spark, ("x", "Name: Bob", 5), ("y", "stale", 0), ("z", "gone", 6, True), ("q", "new", 2), ("nobody", "", 2, True)), 2)
    assert contents(spark, path) == ["Name: Bob", "new", "second"] and outcomes(spark, path) == (5, 1, 1, 0, 2, 0, 1)
    assert [r.object for r in sync.table(spark, path, "facts").collect()] == ["Bob"]
    now = {r.external_id: r.id for r in sync.table(spark, path, "records").collect()}
    assert now["y"] == ids["y"] and now["x"] > max(ids.values()) and "z" not in now
    assert set(now.values()) == {r.id for r in sync.table(spark, path, "memories").collect()} == {r.id for r in sync.table(spark, path, "chunks").collect()}
    sync.sync(spark, path, "other", record(spark, ("x", "Name: Bob", 5)), 0)  # another provider's ids are its own
    assert contents(spark, path) == ["Name: Bob", "Name: Bob", "new", "second"]
    sync.sync(spark, path, "hub", record(spark).limit(0), 3)
    before = contents(spark, path)
    sync.compact(spark, path)
    assert contents(spark, path) == before and sync.table(spark, path, "ledger").count() == 5
    assert sorted(r.content for r in sync.table(spark, path, "memories", 1).collect()) == ["Name: Ann\n\nmore text", "second", "third"]


def test_stream_that_restarts(spark, tmp_path):
    path, files = f"file://{tmp_path}/sync", f"file://{tmp_path}/in"
    sync.create(spark, path)
    run = lambda check: sync.sync_stream(spark.readStream.schema(sync.RECORD).option("maxFilesPerTrigger", 1).parquet(files), path, "hub", f"file://{tmp_path}/{check}", check).awaitTermination(300)
    record(spark, ("a", "one", 1), ("b", "two", 1)).coalesce(1).write.mode("append").parquet(files)
    run("c")
    record(spark, ("a", "uno", 2), ("c", "three", 2)).coalesce(1).write.mode("append").parquet(files)
    run("c")
    run("c")
    assert contents(spark, path) == ["three", "two", "uno"] and sync.table(spark, path, "ledger").count() == 2
    run("d")  # the checkpoint is lost: all comes again
    assert contents(spark, path) == ["three", "two", "uno"]
    assert sync.table(spark, path, "records").count() == 3


def test_a_failed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/sync"
    sync.create(spark, path)
    sync.sync(spark, path, "hub", record(spark, ("a", "one", 1)), 0)
    monkeypatch.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        sync.sync(spark, path, "hub", record(spark, ("a", "changed", 2)), 1)
    monkeypatch.undo()
    assert contents(spark, path) == ["one"]
    sync.sync(spark, path, "hub", record(spark, ("a", "changed", 2)), 1)
    assert contents(spark, path) == ["changed"]


def listed(df):
    return sorted(map(tuple, df.collect()))


def test_components_after_each_batch(spark, tmp_path):
    rng, every = random.Random(8), []
    v = incremental.create(spark, f"file://{tmp_path}/cc")
    assert incremental.components(spark, v).isEmpty()
    for step in range(5):
        batch = [(rng.randrange(120), rng.randrange(120)) for _ in range(18)] + [(5, 5), (None, 3), (1000 + step, 1001 + step)]
        every += batch
        edges = spark.createDataFrame(batch, "src long, dst long")
        v = incremental.insert_edges(v, edges)
        want = listed(graph.connected_components(spark.createDataFrame(every, "src long, dst long")))
        assert listed(incremental.components(spark, v)) == want
        if step == 2:
            again = incremental.insert_edges(v, edges)  # changes nothing
            assert listed(incremental.components(spark, again)) == want and versions.live(spark, again, "nodes").count() == versions.live(spark, v, "nodes").count()
            v = incremental.compact(spark, again)
            assert listed(incremental.components(spark, v)) == want


def test_only_touched_clusters_are_written(spark, tmp_path):
    v = incremental.create(spark, f"file://{tmp_path}/cc")
    v = incremental.insert_edges(v, spark.range(1, 500).selectExpr("id * 10 AS src", "id * 10 + 1 AS dst"))
    v = incremental.insert_edges(v, spark.createDataFrame([(10, 20), (31, 7)], "src long, dst long"))
    last = v.segments[-1]["folder"]
    assert spark.read.parquet(f"{last}/labels").count() == 3 and spark.read.parquet(f"{last}/nodes").count() == 1
    assert {r.node: r.component for r in incremental.components(spark, v).where("node IN (20, 31, 30, 40)").collect()} == {20: 10, 30: 7, 31: 7, 40: 40}


def test_clusters_are_updated_or_made_anew(spark):
    names = "id long, memory_id long, subject string, superseded_by long, state string"
    facts = [(k, k // 3, f"s{k % 30}", None, "active") for k in range(90)] + [(100, 0, " New ", None, "active"), (101, 77, "alone", None, "active"), (102, 1, "gone", None, "retired")]
    df = spark.createDataFrame(facts, names)
    members = spark.createDataFrame([(f"s{k}", "c0" if k < 3 else "c1") for k in range(30)], "subject string, cluster string")
    new = spark.createDataFrame([(100,), (101,), (102,)], "id long")
    got = {r.subject: r.cluster for r in incremental.update_clusters(df, new, members).collect()}
    assert got["new"] == "c0" and "alone" not in got and len(got) == 31
    assert not incremental.needs_rebuild(df, new, members) and incremental.needs_rebuild(df, df.select("id"), members) and incremental.needs_rebuild(df, new, members.limit(0))


def test_scratch_of_one_thread_spares_anothers(spark):
    open_, done, found = threading.Event(), threading.Event(), []

    def other():
        open_.wait(60)
        found.append(storage.materialize(spark.range(7), "other"))
        done.set()

    t = threading.Thread(target=other)
    t.start()
    with storage.scratch(spark):
        mine = storage.materialize(spark.range(5), "mine")
        open_.set()
        done.wait(120)
        assert mine.count() == 5
    t.join()
    assert found[0].count() == 7
    with pytest.raises(Exception):
        mine.count()


def test_numbers_without_a_gap(spark):
    rows = spark.range(1000).repartition(7)
    got = ranks.numbered(rows, "n").collect()
    assert sorted(r.n for r in got) == list(range(1000))
    assert all(r.n == 999 - r.id for r in ranks.numbered(rows, "n", [F.desc("id")]).collect())
    assert ranks.numbered(rows.limit(0), "n").count() == 0


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.6, 0.4])
def test_similar_pairs_lose_none(spark, threshold):
    from engrava.functions import text as T

    rng = random.Random(2)
    bases = ["abcdefghijkl", "the quick brown fox", "zz", "a b c d e f g h i j k l", "q" * 30, "x"]
    seen = set()
    while len(seen) < 90:
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "z", " b", "c"])
            text = text or ["y"]
        seen.add((rng.choice("st"), " ".join("".join(text).split()) or "y"))
    rows = [(s, "p", o, (k * 7) % 90, k) for k, (s, o) in enumerate(sorted(seen))]
    forms = spark.createDataFrame(rows, "s string, p string, o string, rank long, node long").withColumn("rank", F.struct("rank"))
    a, b = forms.toDF("s", "p", "ao", "ar", "an"), forms.toDF("s", "p", "bo", "br", "bn")
    want = a.join(b, ["s", "p"]).where("ar < br").withColumn("x", T.object_similarity(F.col("ao"), F.col("bo"))).where(F.col("x") >= threshold).select("an", "bn", "x")
    assert listed(admission._similar_pairs(forms, threshold)) == listed(want) and not want.isEmpty()
