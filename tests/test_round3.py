"""Findings of round 3."""

import random
from collections import Counter
from itertools import combinations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from engrava.operators import clusters, extraction, meetings, recall, temporal, vectors
from engrava.plans import views
from engrava.queries import QUERIES


def test_words_end_where_ascii_words_do(spark):
    texts = ["é2024-01-02", "ß+49 30 1234567ä", "Mayö", "́May 5, 2021", "May\x0b5", "éann@x.org", "(555) 123-4567é", "a2024-01-02", "plain"]
    got = {tuple(r) for r in extraction.regex_facts(spark.createDataFrame(list(enumerate(texts)), "id long, content string")).collect()}
    table = pa.table({"id": list(range(len(texts))), "content": texts})  # noqa: F841
    want = set()
    for kind, p in extraction.PATTERNS.items():
        want |= set(duckdb.sql(f"SELECT id, '{kind}', trim(v), count(*) FROM (SELECT id, unnest(regexp_extract_all(content, '{p}', 1)) AS v FROM \"table\") GROUP BY ALL").fetchall())
    assert got == want and {(0, "iso_date", "2024-01-02", 1), (2, "natural_date", "May", 1)} <= got and 7 not in {r[0] for r in got}


def test_assign_by_subject_without_the_memory(spark, tmp_path):
    facts = "id long, memory_id long, subject string, project_id string"
    known = spark.createDataFrame([(1, 1, "Ann", "p"), (2, 1, "Bob", "q")], facts)
    new = spark.createDataFrame([(10, 1, "ann", None), (11, 1, "New", None)], facts)
    assert [tuple(r) for r in clusters.assign_by_subject(new, known, by_memory=False).collect()] == [(10, "p")]
    # Customer 2 has no order but number 9: its subject has no vote, yet its memory has.
    keys = [9, 18, 1009, 2, 1]
    orders = pa.table({"o_orderkey": keys, "o_custkey": [2, 1, 1, 1, 1], "o_orderstatus": ["F"] * 5, "o_totalprice": [1.0] * 5, "o_orderpriority": ["x"] * 5})
    at = duckdb.sql("SELECT TIMESTAMP '1995-01-01' AS t FROM range(5)").arrow()
    at = at.read_all() if hasattr(at, "read_all") else at
    pq.write_table(orders.append_column("o_orderdate", at.column("t")), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"c_custkey": [1, 2], "c_name": ["A", "B"], "c_mktsegment": ["m", "n"], "c_nationkey": [0, 0], "c_acctbal": [0.0, 0.0]}), tmp_path / "customer.parquet")
    got = {tuple(r) for r in QUERIES["assign_by_subject"](spark, str(tmp_path)).collect()}
    assert got == {(18, "m")}


def test_pairs_are_dealt_by_their_number(spark):
    rng = random.Random(3)
    rows = [(b, rng.randrange(40)) for b in range(300) for _ in range(rng.randrange(9))]
    got = views.pair_counts(spark.createDataFrame(rows, "batch long, fact_id long"), 100)
    want = Counter(p for b in range(300) for p in combinations(sorted({x for k, x in rows if k == b}), 2))
    assert {(r.fact_id_a, r.fact_id_b): r["count"] for r in got.collect()} == want
    assert got.select(F.spark_partition_id()).distinct().count() > 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert views.pair_counts(spark.createDataFrame([], "batch long, fact_id long")).isEmpty()


def _weights(rows):
    return Counter(p for m in {m for m, _ in rows} for p in combinations(sorted({s for k, s in rows if k == m}), 2))


def test_meetings_in_blocks_of_any_size(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(60), f"s{rng.randrange(90)}") for _ in range(420)]
    each = meetings.subjects_of(spark.createDataFrame(rows, "memory_id long, subject string"))
    want = _weights(rows)
    for block in (7, 40, 1000):
        assert {(r.a, r.b): r.weight for r in meetings.weights(each, block).collect()} == want
        edges = [tuple(r) for r in meetings.forest(each, 2, block).collect()]
        find = lambda links: {tuple(sorted(c)) for c in _parts(links)}
        assert find(edges) == find([p for p, n in want.items() if n >= 2])
        grouped = each.withColumn("grp", F.substring("s", -1, 1))
        inside = Counter(a[-1] for a, b in want if a[-1] == b[-1])
        assert {r.grp: r.n for r in meetings.pairs_inside(grouped, block).collect() if r.n} == inside
    assert meetings.weights(each.limit(0)).isEmpty()


def _parts(links):
    parts = []
    for a, b in links:
        met = [p for p in parts if a in p or b in p]
        parts = [p for p in parts if p not in met] + [{a, b}.union(*met)]
    return parts


def test_no_pair_of_subjects_is_shuffled(spark):
    rows = spark.createDataFrame([(m, f"s{k}") for m in range(3) for k in range(400)], "memory_id long, subject string")
    plan = clusters.subject_weights(rows)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate(keys=[a#" not in plan
    got = clusters.topic_clusters(rows)
    assert {r.cluster for r in got.collect()} == {"s0"} and got.count() == 400


def test_near_duplicates_in_time_in_runs_of_any_size(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rng.randrange(30))) for _ in range(12)]
    rows = [(k, rng.randrange(900), rng.choice(texts) + rng.choice(["", " aa", " zz"])) for k in range(160)]
    table = spark.createDataFrame(rows, "id long, s int, content string").withColumn("imported_at", F.expr("timestampadd(SECOND, s, TIMESTAMP_NTZ '2024-01-01 00:00:00')"))
    bags = {k: Counter(w for w in c.split() if w) for k, _, c in rows}
    want = set()
    for k, t, _ in rows:
        before = sorted(((u, o) for o, u, _ in rows if 0 <= t - u <= 100 and (u < t or o < k)), reverse=True)[:9]
        for _, o in before:
            dot = sum(n * bags[o][w] for w, n in bags[k].items())
            if dot and round(dot / (sum(n * n for n in bags[k].values()) ** 0.5 * sum(n * n for n in bags[o].values()) ** 0.5), 9) >= 0.95:
                want.add((k, o))
    for block in (5, 16, 512):
        assert {(r.id, r.other) for r in recall.near_duplicates_in_time(table, 100, 9, 0.95, block=block).collect()} == want and want


def test_search_compares_blocks_and_keeps_ties_by_id(spark):
    rng = random.Random(9)
    rows = [(k, [rng.choice([1.0, 0.5, -1.0]) for _ in range(4)]) for k in range(300)]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    exact = {tuple(r) for r in vectors.brute(table, table, 4, 7).collect()}
    for block in (20, 4096):  # one bit, both buckets probed: every row meets every query
        got = vectors.search(vectors.index(table, 4, tables=2, bits=1), table, 7, block=block)
        assert {tuple(r) for r in got.collect()} == exact
    assert "CoGroupsInArrow" in got._jdf.queryExecution().toString()


def test_each_literal_is_normalized_once(spark):
    pairs = [("yesterday", "2024-03-31"), ("12 March 2021", None), ("12 March 2021", ""), (None, ""), ("no time", "2024-03-31")]
    rows = spark.createDataFrame([(k, *pairs[k % 5]) for k in range(50)], "id long, literal string, anchor string")
    want = {r.id: r.f for r in rows.select("id", temporal.normalize(F.col("literal"), F.col("anchor")).alias("f")).collect()}
    got = temporal.normalized(rows)
    assert {r.id: r.f for r in got.collect()} == want and want[0].value == "2024-03-30" and want[1].value == "2021-03-12"
    assert "regexp_extract" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_found_once_for_all_hops(spark):
    seen = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "source_fact_id long, target_fact_id long, confidence double").coalesce(1)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = recall.spread_activation(table.mapInArrow(count, table.schema), spark.createDataFrame([(1, 1.0)], "node long, activation double"))
    assert {r.node: r.activation for r in got.collect()} == {1: 1.0, 2: 0.7, 3: 0.49} and seen.value == 2
