"""Queries of the temporal, bridge and neighbour channels, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engrava.operators import channels, recall, vectors
from engrava.plans import views as V
from engrava.registry import query

_SPANS = """spans AS (SELECT l_orderkey AS id, min(CAST(l_shipdate AS DATE)) AS "start", max(CAST(l_shipdate AS DATE)) AS "end" FROM lineitem GROUP BY 1),
asked AS (SELECT row_number() OVER (ORDER BY "start", "end") AS id, "start", "end" FROM (SELECT DISTINCT unnest([date_trunc('month', o_orderdate), date_trunc('year', o_orderdate), DATE '1990-01-01', date_trunc('month', o_orderdate)])::DATE AS "start",
 unnest([last_day(o_orderdate), (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE, DATE '1999-12-31', date_trunc('month', o_orderdate)])::DATE AS "end" FROM orders))"""


def _spans(s, d):
    """From an order's first line to its last."""
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.col("l_shipdate").cast("date")).alias("start"), F.max(F.col("l_shipdate").cast("date")).alias("end"))


@query("temporal_overlaps", 'SELECT a."start" AS first_day, a."end" AS last_day, count(*) AS spans, CAST(sum(s.id) AS BIGINT) AS ids FROM asked a JOIN spans s ON s."start" <= a."end" AND s."end" >= a."start" GROUP BY 1, 2', _SPANS)
def _(s, d):
    """The orders' months, years, decade and first days of months, against all spans."""
    at = F.col("o_orderdate").cast("date")
    month, year = F.trunc(at, "month"), F.trunc(at, "year")
    decade = [F.lit(x).cast("date") for x in ("1990-01-01", "1999-12-31")]
    ranges = F.explode(F.array(*[F.struct(a.alias("start"), b.alias("end")) for a, b in ((month, F.last_day(at)), (year, F.date_sub(F.add_months(year, 12), 1)), decade, (month, month))]))
    asked = s.read.parquet(f"{d}/orders.parquet").select(ranges.alias("r")).select("r.*").distinct().select(F.struct("start", "end").alias("id"), "start", "end")
    met = channels.overlapping(asked, _spans(s, d))
    return met.groupBy("left_id").agg(F.count("*").alias("spans"), F.sum("right_id").alias("ids")).select(F.col("left_id.start").alias("first_day"), F.col("left_id.end").alias("last_day"), "spans", "ids")


_TIMED = """timed AS (SELECT o_orderkey AS id, o_custkey AS memory_id, c_name AS subject, o_orderpriority AS predicate, c_mktsegment AS object, least(1.0, o_totalprice / 400000.0)::DOUBLE AS confidence,
 CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS "start", CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) END AS "end", CASE WHEN o_custkey % 2 = 0 THEN min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) END AS anchor
 FROM orders JOIN customer ON o_custkey = c_custkey),
asking AS (SELECT n_nationkey AS query_id, 'urgent ' || lower(n_name) || ' building' AS query, CASE WHEN n_nationkey % 4 <> 3 THEN DATE '1994-01-01' + CAST(n_nationkey * 31 AS INTEGER) END AS "start",
 CASE WHEN n_nationkey % 4 <> 3 THEN DATE '1994-01-01' + CAST(n_nationkey * 31 + n_nationkey % 3 * 20 AS INTEGER) END AS "end" FROM nation)"""
_ONES = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"
_LIKE = f"""len(list_intersect(list_distinct({_ONES.format('query')}), {_ONES.format('text')})) / len(list_distinct({_ONES.format('query')})) + CASE WHEN contains(text, query) THEN 0.35 ELSE 0.0 END"""
_CHANNEL = f"""{_TIMED}, pairs AS (SELECT query_id, memory_id, id, q."start" IS NOT NULL AS resolved,
  round(0.35 * ({_LIKE}) + CASE WHEN f."start" IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN anchor IS NOT NULL THEN 0.1 ELSE 0 END + 0.15 * confidence
   + CASE WHEN f."start" <= q."end" AND f."end" >= q."start" THEN 1.1 ELSE 0 END + CASE WHEN anchor BETWEEN q."start" AND q."end" THEN 0.75 ELSE 0 END::DOUBLE, 6) AS score
  FROM asking q CROSS JOIN (SELECT *, lower(concat_ws(' ', subject, predicate, object)) AS text FROM timed) f),
best AS (SELECT query_id, memory_id, max(score) AS score, max_by(id, (score, -id)) AS fact_id FROM pairs WHERE score > 0 AND (NOT resolved OR score >= 0.55) GROUP BY 1, 2),
channel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM best QUALIFY rank <= 20)"""


def _timed(s, d):
    orders, customer = s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/customer.parquet")
    first = orders.groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date")).alias("first"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(first, "o_custkey")
    at = F.col("o_orderdate").cast("date")
    named = F.col("o_orderkey") % 3 != 0
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("memory_id"), F.col("c_name").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("c_mktsegment").alias("object"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 400000.0).cast("double").alias("confidence"), F.when(named, at).alias("start"), F.when(named, F.date_add(at, (F.col("o_orderkey") % 40).cast("int"))).alias("end"), F.when(F.col("o_custkey") % 2 == 0, F.col("first")).alias("anchor"),
    )


def _asking(s, d):
    k, known = F.col("n_nationkey"), F.col("n_nationkey") % 4 != 3
    day = lambda n: F.when(known, F.date_add(F.lit("1994-01-01").cast("date"), n.cast("int")))
    text = F.concat(F.lit("urgent "), F.lower("n_name"), F.lit(" building"))
    return s.read.parquet(f"{d}/nation.parquet").select(k.alias("query_id"), text.alias("query"), day(k * 31).alias("start"), day(k * 31 + k % 3 * 20).alias("end"))


@query("temporal_channel", "SELECT query_id, memory_id, score, fact_id, CAST(rank AS INTEGER) AS rank FROM channel", _CHANNEL)
def _(s, d):
    """What orders say of times, for a query a nation."""
    return channels.temporal_channel(_timed(s, d), _asking(s, d))


@query("temporal_boost", f"""SELECT query_id, r.id, round(r.score * CASE WHEN EXISTS (SELECT 1 FROM asking q WHERE q.query_id = r.query_id AND q."start" IS NOT NULL) THEN CASE WHEN named THEN 1.08 ELSE 1.0 END * CASE WHEN dated THEN 1.05 ELSE 1.0 END
  * CASE WHEN EXISTS (SELECT 1 FROM timed t JOIN asking q ON q.query_id = r.query_id AND t."start" <= q."end" AND t."end" >= q."start" WHERE t.memory_id = r.id) THEN 1.2 ELSE 1.0 END ELSE 1.0 END::DOUBLE, 6) AS score
  FROM (SELECT o_custkey % 25 AS query_id, o_custkey AS id, max(o_totalprice / 400000.0)::DOUBLE AS score FROM orders GROUP BY 1, 2) r
  JOIN (SELECT memory_id, bool_or("start" IS NOT NULL) AS named, bool_or(anchor IS NOT NULL) AS dated FROM timed GROUP BY 1) m ON m.memory_id = r.id""", _TIMED)
def _(s, d):
    orders = s.read.parquet(f"{d}/orders.parquet")
    results = orders.groupBy((F.col("o_custkey") % 25).alias("query_id"), F.col("o_custkey").alias("id")).agg(F.max(F.col("o_totalprice") / 400000.0).cast("double").alias("score"))
    return channels.temporal_boost(results, _timed(s, d), _asking(s, d).where("start IS NOT NULL"))


_ASKED = """entities AS (SELECT c_nationkey AS query_id, c_custkey AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN 'f' ELSE c_name END AS name FROM customer WHERE c_acctbal > 8500)"""
_PAIRED = f"""{_ASKED}, known AS (SELECT query_id, f.id, memory_id, entity_id, lower(trim(predicate)) AS p, lower(trim(object)) AS o, lower(object) = lower(name) AS self FROM facts f JOIN entities USING (entity_id)),
scored AS (SELECT a.query_id, a.id, a.memory_id, max(CASE WHEN a.memory_id = b.memory_id THEN 0.95 WHEN a.o <> '' AND a.o = b.o THEN 0.88 WHEN a.p <> '' AND a.p = b.p THEN 0.72 WHEN a.self OR b.self THEN 0.85 ELSE 0 END)::DOUBLE AS score
 FROM known a JOIN known b ON a.query_id = b.query_id AND a.entity_id <> b.entity_id GROUP BY 1, 2, 3)"""


def _entities(s, d):
    name = F.when(F.col("c_custkey") % 4 == 0, F.lit("f")).otherwise(F.col("c_name"))
    return s.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 8500").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("entity_id"), name.alias("name"))


@query("bridge_facts", "SELECT query_id, id, memory_id, score FROM scored WHERE score > 0", _PAIRED)
def _(s, d):
    """What ties a nation's wealthiest customers together."""
    return channels.bridge_facts(V.facts(s, d), _entities(s, d))


@query("bridge_results", "SELECT query_id, memory_id, max(round(top * 0.9 * score, 9)) AS score, max_by(id, (round(top * 0.9 * score, 9), -id)) AS fact_id, count(*) AS facts FROM scored JOIN (SELECT n_nationkey AS query_id, (n_nationkey + 1) / 10.0::DOUBLE AS top FROM nation WHERE n_nationkey % 5 <> 0) USING (query_id) WHERE score > 0 GROUP BY 1, 2", _PAIRED)
def _(s, d):
    fused = s.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("query_id"), ((F.col("n_nationkey") + 1) / 10.0).cast("double").alias("score"))
    return channels.bridge_results(V.facts(s, d), _entities(s, d), fused)


_PATHS = """both_ways AS MATERIALIZED (SELECT source_fact_id AS a, target_fact_id AS b FROM edges UNION SELECT target_fact_id, source_fact_id FROM edges),
ends AS MATERIALIZED (SELECT source AS pair_id, source, target FROM (SELECT node AS source, lead(node) OVER (ORDER BY node) AS target FROM (SELECT DISTINCT a AS node FROM both_ways WHERE a % 40 = 1)) WHERE target IS NOT NULL),
walk(pair_id, side, node, depth) AS (SELECT pair_id, 'a', source, 0 FROM ends UNION SELECT pair_id, 'b', target, 0 FROM ends UNION SELECT pair_id, side, b, depth + 1 FROM walk JOIN both_ways ON a = node WHERE depth < 4),
reached AS (SELECT pair_id, side, node, min(depth) AS depth FROM walk GROUP BY 1, 2, 3),
met AS (SELECT x.pair_id, x.node, x.depth AS step, x.depth + y.depth AS distance FROM reached x JOIN reached y ON x.pair_id = y.pair_id AND x.node = y.node AND x.side = 'a' AND y.side = 'b')"""


@query("shortest_paths", "SELECT pair_id, node, CAST(step AS INTEGER) AS step, CAST(distance AS INTEGER) AS distance FROM met WHERE distance <= 4 QUALIFY distance = min(distance) OVER (PARTITION BY pair_id)", _PATHS)
def _(s, d):
    """Between every fortieth part and the next of these."""
    e = V.edges(s, d)
    nodes = e.select(F.col("source_fact_id").alias("node")).union(e.select("target_fact_id")).where("node % 40 = 1").distinct()
    pairs = nodes.select(F.col("node").alias("source"), F.lead("node").over(Window.orderBy("node")).alias("target")).where("target IS NOT NULL")
    return channels.shortest_paths(e, pairs.select(F.col("source").alias("pair_id"), "source", "target"), 4)


@query("activation_results", "SELECT 1 AS query_id, memory_id, max(x) AS score, max_by(node, (x, -node)) AS fact_id, count(*) AS facts FROM (SELECT node, CAST(round(max(x), 9) AS DOUBLE) AS x FROM (SELECT r AS node, 1.0 AS x FROM root UNION ALL SELECT node, x FROM h1 UNION ALL SELECT node, x FROM h2) GROUP BY 1) JOIN facts ON facts.id = node WHERE x >= 0.2 GROUP BY 2", "root AS (SELECT min(least(source_fact_id, target_fact_id)) AS r FROM edges WHERE confidence >= 0.4), dir AS (SELECT source_fact_id AS a, target_fact_id AS b, confidence AS c FROM edges UNION ALL SELECT target_fact_id, source_fact_id, confidence FROM edges), h1 AS (SELECT b AS node, CAST(max(0.7 * c) AS DOUBLE) AS x FROM dir WHERE a = (SELECT r FROM root) AND 0.7 * c >= 0.1 GROUP BY 1), h2 AS (SELECT b AS node, max(x * 0.7 * c) AS x FROM h1 JOIN dir ON a = node WHERE x * 0.7 * c >= 0.1 GROUP BY 1)")
def _(s, d):
    e = V.edges(s, d)
    seeds = e.where("confidence >= 0.4").agg(F.least(F.min("source_fact_id"), F.min("target_fact_id")).alias("node")).withColumn("activation", F.lit(1.0))
    active = recall.spread_activation(e, seeds).select(F.lit(1).alias("query_id"), F.col("node").alias("id"), "activation")
    return channels.results_of_facts(active, V.facts(s, d), 0.2)


@query("neighbour_activation", None)
def _(s, d):
    """What every twentieth vector brings to mind over edges to the nearest, two hops far; the index's recall is tested."""
    rows = V.embeddings(s, d).select(F.col("memory_id").alias("id"), "vector")
    edges = channels.neighbour_edges(vectors.index(rows, 64), rows, 6, 0.5)
    return recall.spread_activation(edges, rows.where("id % 20 = 0").select(F.col("id").alias("node"), F.lit(1.0).alias("activation")))
