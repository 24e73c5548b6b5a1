"""Queries of chunks, recall items, grouped context and exploration, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.operators import batch_search, context, keyword
from engrava.plans import views as V
from engrava.queries_index import _queries
from engrava.registry import query

# Windows of 1,000 tokens: pieces of 3,000 characters, cut at a blank line in the last 1,000.
_CUT = """CASE WHEN pos + 3000 < n AND contains(substring(content, pos + 2001, 1000), chr(10) || chr(10))
 THEN pos + 2000 + length(substring(content, pos + 2001, 1000)) - length(list_last(string_split(substring(content, pos + 2001, 1000), chr(10) || chr(10)))) - 2 ELSE least(pos + 3000, n) END"""


@query("overlapping_chunks", r"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS position, CAST(pos AS INTEGER) AS start, substring(content, pos + 1, stop - pos) AS text FROM cuts WHERE trim(regexp_replace(substring(content, pos + 1, stop - pos), '\s+', ' ', 'g')) <> ''", f"""
texts AS (SELECT id, content, length(content) AS n, strlen(content) // 4 <= 750 AS small FROM memories WHERE content <> ''),
cuts(id, content, n, pos, stop) AS (SELECT id, content, n, 0, CASE WHEN small THEN n ELSE {_CUT.replace('pos', '0')} END FROM texts
 UNION ALL SELECT id, content, n, pos, {_CUT} FROM (SELECT id, content, n, stop - 200 AS pos FROM cuts WHERE stop < n))""")
def _(s, d):
    return context.overlapping_chunks(V.memories(s, d), 1000)


_FOUND = """found AS (SELECT id % 7 AS query_id, id, (id % 97) / 97.0::DOUBLE AS score, (['core', 'journal', 'capture', '', 'transient'])[CAST(id % 5 AS INTEGER) + 1] AS source_tier, memory_class FROM memories),
told AS (SELECT memory_id AS id, count(*) AS every, count(*) FILTER (active) AS live, max(CASE WHEN active THEN confidence ELSE 0 END) AS confidence, max(CASE WHEN active AND fact_type IN ('preference', 'decision') THEN confidence ELSE 0 END) AS durable
 FROM (SELECT *, superseded_by IS NULL AND state <> 'retired' AND memory_id % 4 <> 1 AS active FROM facts WHERE id % 9 = 0) GROUP BY 1),
item AS (SELECT f.*, coalesce(every, 0) AS every, coalesce(live, 0) AS live, coalesce(confidence, 0) AS confidence, coalesce(durable, 0) AS durable, source_tier NOT IN ('capture', 'transient') AS lasting FROM found f LEFT JOIN told USING (id))"""


def _found(s, d):
    rows = V.memories(s, d)
    tier = F.expr("element_at(array('core', 'journal', 'capture', '', 'transient'), cast(id % 5 as int) + 1)")
    found = rows.select((F.col("id") % 7).alias("query_id"), "id", ((F.col("id") % 97) / 97.0).alias("score"), tier.alias("source_tier"), "memory_class", "content")
    live = F.expr("superseded_by IS NULL AND state <> 'retired' AND memory_id % 4 <> 1")
    return context.recall_items(found, V.facts(s, d).where("id % 9 = 0").select("id", "memory_id", "fact_type", "confidence", live.alias("active")))


@query("recall_items", """SELECT query_id, id, visibility, array_to_string(CASE visibility WHEN 'prompt_safe' THEN [] WHEN 'evidence_only' THEN list_filter(['evidence_only', CASE WHEN live = 0 THEN 'no_active_facts' END, CASE WHEN NOT lasting THEN 'transient_source' END, CASE WHEN memory_class = 'scratch' THEN 'scratch_class' END, CASE WHEN live > 0 AND confidence < 0.6 THEN 'low_confidence' END], lambda x: x IS NOT NULL) ELSE [visibility] END, ',') AS reasons
FROM (SELECT *, CASE WHEN durable >= 0.6 OR durable >= 0.45 AND score >= 0.6 OR memory_class IN ('rule', 'decision', 'preference', 'identity') AND lasting AND score >= 0.45 OR live > 0 AND lasting AND confidence >= 0.85 THEN 'prompt_safe'
 WHEN live = 0 AND every > 0 THEN 'retired' WHEN live = 0 AND source_tier = 'journal' THEN 'journal_only' ELSE 'evidence_only' END AS visibility FROM item)""", _FOUND)
def _(s, d):
    return _found(s, d).select("query_id", "id", "visibility", F.array_join("reasons", ",").alias("reasons"))


@query("recall_rank", None)
def _(s, d):
    """Recall items in the order in which a question would have them; tests hold the order against brute force."""
    asked = ["what do I prefer in the", "which decision of the", "rule of an", "who am i", "config is on", "the", "tell me about that?"]
    queries = V.memories(s, d).select((F.col("id") % 7).alias("query_id")).distinct().withColumn("query", F.element_at(F.array(*map(F.lit, asked)), F.col("query_id").cast("int") + 1))
    return context.recall_rank(_found(s, d), queries).select("query_id", "id", "rank_score", "rank")


@query("grouped_context", None)
def _(s, d):
    """What passages' beginnings find, as context of 6,000 bytes a passage; tests hold it against a plain fold."""
    rows = V.memories(s, d)
    found = batch_search.search_all(keyword.index(rows, 16, 4), rows, _queries(s, d, 5), 10)
    items = found.join(rows.select("id", "content", "source_file", "project"), "id").select("query_id", "rank", F.col("project").alias("scene"), F.col("source_file").alias("source"), "score", "content")
    return context.grouped_context(items)


_EXPLORED = """two_ways AS MATERIALIZED (SELECT a, b, max(c) AS c FROM (SELECT source_fact_id AS a, target_fact_id AS b, confidence AS c FROM edges WHERE confidence >= 0.4 UNION ALL SELECT target_fact_id, source_fact_id, confidence FROM edges WHERE confidence >= 0.4) GROUP BY 1, 2),
followed AS MATERIALIZED (SELECT a, b FROM two_ways JOIN facts ON facts.id = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 3),
steps(root, node, hop) AS (SELECT CAST(a % 5 AS INTEGER), a, 0 FROM two_ways JOIN facts ON facts.id = a WHERE a % 50 < 5 UNION SELECT root, b, hop + 1 FROM steps JOIN followed ON a = node WHERE hop < 2),
kept AS MATERIALIZED (SELECT root, node, hop, confidence, row_number() OVER (PARTITION BY root ORDER BY hop, confidence DESC, node) AS place FROM (SELECT root, node, min(hop) AS hop FROM steps GROUP BY 1, 2) JOIN facts ON facts.id = node QUALIFY place <= 40)"""


def _explored(s, d):
    e, f = V.edges(s, d), V.facts(s, d)
    strong = e.where("confidence >= 0.4")
    known = strong.join(f.select(F.col("id").alias("target_fact_id")), "target_fact_id", "left_semi").join(f.select(F.col("id").alias("source_fact_id")), "source_fact_id", "left_semi")
    nodes = strong.select(F.col("source_fact_id").alias("node")).union(strong.select("target_fact_id")).distinct().where("node % 50 < 5")
    return context.explore(known, f, nodes.select((F.col("node") % 5).cast("int").alias("root"), "node"), 2, 3, 40, 0.4)


@query("explored_facts", "SELECT root, node, CAST(hop AS INTEGER) AS hop, confidence, CAST(place AS INTEGER) AS place FROM kept", _EXPLORED)
def _(s, d):
    """Around the parts of five classes, no more than three edges from each, forty facts a class."""
    return _explored(s, d)[0]


@query("explored_edges", "SELECT x.root, source_fact_id, target_fact_id, edge_type, max(edges.confidence)::DOUBLE AS confidence FROM edges JOIN kept x ON x.node = source_fact_id JOIN kept y ON y.node = target_fact_id AND y.root = x.root WHERE edges.confidence >= 0.4 GROUP BY 1, 2, 3, 4", _EXPLORED)
def _(s, d):
    return _explored(s, d)[1].select("root", "source_fact_id", "target_fact_id", "edge_type", "confidence")
