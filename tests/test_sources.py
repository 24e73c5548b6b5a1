from datetime import datetime

from engrava.sources import documents as D
from engrava.streaming import events as S


def test_files_formats_and_binaries(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# T\n\nhello world")
    (tmp_path / "sub" / "b").write_text('{"x": [1, 2], "y": null}')
    (tmp_path / "c.bin").write_bytes(b"ab\0cd")
    (tmp_path / "d.dat").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "e.TXT").write_text("@@ 0 p\n")
    got = {r.path.rsplit("/", 1)[1]: r.format for r in D.read_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.md": "markdown", "b": "json", "e.TXT": "text"}
    assert [r.format for r in D.read_files(spark, f"file://{tmp_path}", include=[".md"], exclude=[".md"]).collect()] == ["markdown"]


def test_markdown_sections(spark):
    text = "# Title\nintro\n## A\none\n### B\ntwo\n```\n## not a header\n```\n## C\n\nthree"
    got = D.markdown_sections(spark.createDataFrame([("p", text)], "path string, content string")).orderBy("first_line").collect()
    assert [(r.section, r.first_line) for r in got] == [("", 1), ("A", 3), ("A > B", 5), ("C", 10)]
    assert got[2].text == "two\n```\n## not a header\n```" and got[3].text == "three"


def test_json_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", '[1, {"b": 2}]'), ("o", '{"k": "v", "n": null}'), ("s", "3"), ("bad", "{")], "path string, content string")
    assert sorted(map(tuple, D.json_rows(rows).collect())) == [("a", "0", "1"), ("a", "1", '{"b":2}'), ("o", "k", '"v"'), ("o", "n", "null"), ("s", "", "3")]
    (tmp_path / "t.csv").write_text('Name,Role\nAda,"x, y"\nBob,\n')
    assert sorted(r.value for r in D.table_rows(spark, f"file://{tmp_path}/t.csv").collect()) == ['{"Name":"Ada","Role":"x, y"}', '{"Name":"Bob"}']


def test_tags(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("see #Alpha and a#no #beta/x",)], "c string").select(D.tags(F.col("c"), F.array(F.lit("Front"))).alias("t")).first()
    assert row.t == ["front", "alpha", "beta/x"]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(1, 7, "a", datetime(2024, 1, 1, 0, 5)), (2, 7, "b", datetime(2024, 1, 1, 0, 50)), (3, 7, "a", datetime(2024, 1, 1, 1, 5))], "id long, fact_id long, agent_id string, created_at timestamp")
    log.write.parquet(f"file://{tmp_path}/log")
    stream = S.read_log(spark, f"file://{tmp_path}/log", log.schema)
    q = S.access_counts(stream).writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.start.hour, r.n, r.agents) for r in spark.table("counts").collect()) == [(0, 2, 2), (1, 1, 1)]
    rows = spark.createDataFrame([(1, "x y z", datetime(2024, 1, 1)), (2, "x y z", datetime(2024, 1, 1)), (3, "x q", datetime(2024, 1, 1))], "id long, content string, imported_at timestamp")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/mem")
    mem = S.read_log(spark, f"file://{tmp_path}/mem", rows.schema)
    q = S.first_seen(mem).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 2
    watches = spark.createDataFrame([(1, ["x", "y"])], "watch_id long, terms array<string>")
    q = S.watch_stream(mem, watches).writeStream.format("memory").queryName("watched").option("checkpointLocation", f"file://{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("watched").collect()) == [1, 2]
