"""Queries of what belongs to a subject, of writes, and of import, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.operators import importing, subjects, vectors, writes
from engrava.plans import drafts as D
from engrava.plans import views as V
from engrava.registry import query

_ACTIVE = "superseded_by IS NULL AND state NOT IN ('retired', 'superseded')"
_FIRST, _LAST = "1994-01-01", "1998-06-30"
_RANGE = f"CAST({{0}}created_at AS DATE) BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}'"
_MAIN = "Customer#000000010"
_MAIN_BASE = f"base AS (SELECT * FROM facts WHERE lower(subject) = lower('{_MAIN}') AND {_RANGE.format('')} AND (confidence >= 0.3 OR superseded_by IS NOT NULL))"


@query("timeline_facts", f"SELECT f.id, subject, round(confidence, 9) AS confidence, coalesce(source_file, '') AS source_file, superseded_by IS NOT NULL AS superseded FROM facts f LEFT JOIN memories m ON m.id = f.memory_id WHERE lower(subject) IN ('customer#000000010', 'customer#000000013', 'customer#000000016') AND {_RANGE.format('')} AND (lower(subject) = 'customer#000000010' OR confidence >= 0.3 OR superseded_by IS NOT NULL)")
def _(s, d):
    found = subjects.timeline_facts(V.facts(s, d), V.memories(s, d), [_MAIN, " customer#000000013", "CUSTOMER#000000016", "", _MAIN], _MAIN, _FIRST, _LAST, 0.3)
    return found.select("id", "subject", F.round("confidence", 9).alias("confidence"), "source_file", "superseded")


_NEIGHBOURS = "near AS (SELECT target_fact_id AS id FROM links WHERE source_fact_id IN (SELECT id FROM base) UNION SELECT source_fact_id FROM links WHERE target_fact_id IN (SELECT id FROM base))"
_LINKS = "links AS (SELECT id AS source_fact_id, id + 7 AS target_fact_id FROM facts)"
_RELATED = f"SELECT s AS subject FROM (SELECT lower(subject) AS s, max(confidence) AS c, max(created_at) AS t FROM facts WHERE {{0}} AND lower(subject) <> lower('{_MAIN}') AND trim(subject) <> '' AND {_RANGE.format('')} GROUP BY 1) ORDER BY c DESC, t DESC, s LIMIT 8"


@query("related_subjects", _RELATED.format("id IN (SELECT id FROM near)"), f"{_MAIN_BASE}, {_LINKS}, {_NEIGHBOURS}")
def _(s, d):
    rows = V.facts(s, d)
    return subjects.related_subjects(rows, rows.select(F.col("id").alias("source_fact_id"), (F.col("id") + 7).alias("target_fact_id")), _MAIN, _FIRST, _LAST, 0.3)


@query("subjects_of_same_memories", _RELATED.format("memory_id IN (SELECT memory_id FROM base)"), _MAIN_BASE)
def _(s, d):
    return subjects.subjects_of_same_memories(V.facts(s, d), _MAIN, _FIRST, _LAST, 0.3)


@query("induced_pairs", "SELECT fact_id_a, fact_id_b, count FROM cooccurrence WHERE fact_id_a % 3 = 1 AND fact_id_b % 3 = 1")
def _(s, d):
    pairs = V.cooccurrence(s, d)
    nodes = pairs.selectExpr("fact_id_a AS node").union(pairs.selectExpr("fact_id_b")).distinct().where("node % 3 = 1")
    return subjects.induced_pairs(pairs, nodes)


@query("described_nodes", "SELECT c_custkey AS node, coalesce(n, 0) AS facts, last, coalesce(p, '') AS providers FROM customer LEFT JOIN (SELECT lower(subject) AS s, count(*) AS n, CAST(max(created_at) AS DATE) AS last, string_agg(DISTINCT nullif(regexp_extract(lower(source_file), '^([^:/]+)[:/]', 1), ''), ',' ORDER BY nullif(regexp_extract(lower(source_file), '^([^:/]+)[:/]', 1), '')) AS p FROM facts LEFT JOIN notes ON notes.id = memory_id GROUP BY 1) ON s = lower(c_name)", D.SQL["notes"])
def _(s, d):
    nodes = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("subject"))
    return subjects.describe_nodes(nodes, V.facts(s, d), D.notes(s, d))


_MEMBERS = "members AS (SELECT id AS fact_id, entity_id % 6 AS cluster_id FROM facts)"


def _members(s, d):
    return V.facts(s, d).selectExpr("id AS fact_id", "entity_id % 6 AS cluster_id")


@query("cluster_facts", "SELECT id FROM facts WHERE id IN (SELECT fact_id FROM members WHERE cluster_id = 4) ORDER BY confidence DESC, id DESC LIMIT 200", _MEMBERS)
def _(s, d):
    return subjects.cluster_facts(V.facts(s, d), _members(s, d), 4, 200).select("id")


@query("top_subjects_of_clusters", "SELECT cluster_id, subject, count(*) AS n FROM facts JOIN members ON fact_id = id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, subject) <= 5", _MEMBERS)
def _(s, d):
    return subjects.top_subjects(V.facts(s, d), _members(s, d))


@query("subject_page", f"SELECT CAST(rank AS INTEGER) AS rank, id, total FROM (SELECT id, row_number() OVER (ORDER BY confidence DESC, id) - 1 AS rank, count(*) OVER () AS total FROM facts WHERE {_ACTIVE} AND lower(subject) = lower('{_MAIN}')) WHERE rank >= 3 AND rank < 8")
def _(s, d):
    return subjects.subject_page(V.facts(s, d), _MAIN, 3, 5)


@query("impact_roots", f"SELECT id AS node FROM facts WHERE {_ACTIVE} AND lower(subject) = lower('{_MAIN}') AND confidence >= 0.2 ORDER BY confidence DESC, id LIMIT 6")
def _(s, d):
    return subjects.impact_roots(V.facts(s, d), _MAIN, 0.2, 6)


@query("impact_page", "SELECT CAST(rank AS INTEGER) AS rank, id FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM notes) WHERE rank BETWEEN 20 AND 29", D.SQL["notes"])
def _(s, d):
    return subjects.page(D.notes(s, d), 20, 10, F.desc("score"), F.asc("id")).select("rank", "id")


@query("sparse_chains", "SELECT id AS source_fact_id, next AS target_fact_id FROM (SELECT id, lead(id) OVER (PARTITION BY lower(subject) ORDER BY id) AS next FROM facts WHERE lower(subject) NOT IN (SELECT lower(a.subject) FROM links JOIN facts a ON a.id = source_fact_id JOIN facts b ON b.id = target_fact_id WHERE lower(a.subject) = lower(b.subject))) WHERE next IS NOT NULL", _LINKS)
def _(s, d):
    rows = V.facts(s, d)
    return subjects.sparse_chains(rows, rows.select(F.col("id").alias("source_fact_id"), (F.col("id") + 7).alias("target_fact_id")))


@query("belief_report", f"SELECT id, sources, coalesce(n, 0) AS accesses, state = 'active' AND coalesce(n, 0) >= 3 AND confidence >= 0.5 AS promotes FROM (SELECT * FROM facts WHERE {_ACTIVE}) f JOIN (SELECT lower(subject) AS s, lower(predicate) AS p, lower(object) AS o, count(DISTINCT memory_id) AS sources FROM facts WHERE {_ACTIVE} GROUP BY 1, 2, 3) ON s = lower(subject) AND p = lower(predicate) AND o = lower(object) LEFT JOIN (SELECT fact_id, count(*) AS n FROM accesses GROUP BY 1) ON fact_id = id")
def _(s, d):
    return subjects.belief_report(V.facts(s, d), V.accesses(s, d))


# Writes


@query("add_memories", "SELECT id FROM memories WHERE id % 3 = 0 UNION ALL SELECT min(id) FROM memories WHERE id % 3 = 1 AND (source_file, content) NOT IN (SELECT (source_file, content) FROM memories WHERE id % 3 = 0) GROUP BY source_file, content")
def _(s, d):
    rows = V.memories(s, d)
    return writes.add_memories(rows.where("id % 3 = 0"), rows.where("id % 3 = 1")).select("id")


@query("update_memories", "SELECT id, CASE WHEN id % 4 = 0 THEN 'p' || id ELSE project END AS project, CASE WHEN id % 4 = 0 THEN 'rule' ELSE memory_class END AS memory_class FROM memories")
def _(s, d):
    rows = V.memories(s, d)
    changes = rows.where("id % 4 = 0").select("id", F.concat(F.lit("p"), "id").alias("project"), F.lit("rule").alias("memory_class"))
    return writes.updated(rows, changes.unionByName(s.range(1).select(F.lit(-5).cast("long").alias("id"), F.lit("x").alias("project"), F.lit("y").alias("memory_class")))).select("id", "project", "memory_class")


@query("soft_delete_memories", "SELECT id, CASE WHEN id % 10 = 0 THEN TIMESTAMP '2023-01-01' WHEN id % 5 = 0 THEN TIMESTAMP '2024-06-01' END AS deleted_at FROM memories")
def _(s, d):
    rows = V.memories(s, d).withColumn("deleted_at", F.expr("CASE WHEN id % 10 = 0 THEN TIMESTAMP_NTZ '2023-01-01 00:00:00' END"))
    return writes.soft_deleted(rows, rows.where("id % 5 = 0"), "2024-06-01 00:00:00").select("id", "deleted_at")


@query("delete_by_source", "SELECT id FROM memories WHERE source_file NOT IN ('notes/src1.md', 'notes/src2.csv', 'notes/src3')")
def _(s, d):
    gone = s.createDataFrame([("notes/src1.md",), ("notes/src2.csv",), ("notes/src3",)], "source_file string")
    return writes.deleted_by(V.memories(s, d), "source_file", gone).select("id")


@query("set_fact_state", "SELECT id, CASE WHEN id % 6 = 0 THEN 'retired' ELSE state END AS state FROM facts")
def _(s, d):
    rows = V.facts(s, d)
    return writes.with_value(rows, rows.where("id % 6 = 0"), "state", F.lit("retired")).select("id", "state")


@query("set_fact_confidence", "SELECT id, round(CASE WHEN id % 6 = 0 THEN 0.25 ELSE confidence END::DOUBLE, 9) AS confidence FROM facts")
def _(s, d):
    rows = V.facts(s, d)
    return writes.with_value(rows, rows.where("id % 6 = 0"), "confidence", F.lit(0.25)).select("id", F.round("confidence", 9).alias("confidence"))


@query("set_fact_type", "SELECT id, CASE WHEN id % 6 = 0 THEN 'kv' ELSE fact_type END AS fact_type FROM facts")
def _(s, d):
    rows = V.facts(s, d)
    return writes.with_value(rows, rows.where("id % 6 = 0"), "fact_type", F.lit("kv")).select("id", "fact_type")


@query("accept_proposals", "SELECT id, CASE WHEN severity = 'critical' THEN 'accepted' ELSE 'pending' END AS status FROM alerts", D.SQL["alerts"])
def _(s, d):
    rows = D.alerts(s, d).withColumn("status", F.lit("pending"))
    return writes.with_value(rows, rows.where("severity = 'critical'"), "status", F.lit("accepted")).select("id", "status")


@query("log_events", "SELECT id, agent_id FROM accesses UNION ALL SELECT (SELECT max(id) FROM accesses) + row_number() OVER (ORDER BY id), 'new' FROM accesses WHERE id % 100 = 0")
def _(s, d):
    rows = V.accesses(s, d).select("id", "agent_id")
    return writes.numbered(rows, rows.where("id % 100 = 0").select(F.lit("new").alias("agent_id")))


@query("count_denied", "SELECT agent_id AS key, CAST(count(*) AS BIGINT) AS value FROM accesses GROUP BY 1 UNION ALL SELECT 'denied', 3")
def _(s, d):
    counters = V.accesses(s, d).groupBy(F.col("agent_id").alias("key")).agg(F.count("*").alias("value"))
    return writes.counted(counters, s.createDataFrame([("denied", 1), ("denied", 2)], "key string, value long"))


@query("reinforce_facts", "SELECT id, CASE WHEN id % 5 = 0 THEN greatest(created_at, TIMESTAMP '1997-01-01') ELSE created_at END AS last_reinforced FROM facts")
def _(s, d):
    rows = V.facts(s, d).withColumn("last_reinforced", F.col("created_at"))
    return writes.reinforced(rows, rows.where("id % 5 = 0"), "1997-01-01 00:00:00").select("id", "last_reinforced")


# Import


@query("front_matter", "SELECT id, CASE WHEN id % 3 = 0 THEN 'n' || id END AS title, CASE WHEN id % 3 = 0 THEN 'b: c' END AS note, md5(CASE WHEN id % 3 = 0 THEN chr(10) || 'body ' || id WHEN id % 3 = 1 THEN 'plain ' || id ELSE '--- open ' || id END) AS body FROM facts")
def _(s, d):
    k = F.col("id")
    marked = F.concat(F.lit("---\ntitle: old\n title:  n"), k, F.lit(" \nempty:\n: no key\nnote: b: c\n---\n\nbody ").cast("string"), k)
    text = F.when(k % 3 == 0, F.regexp_replace(marked, "\n\n", "\n\n")).when(k % 3 == 1, F.concat(F.lit("plain "), k)).otherwise(F.concat(F.lit("--- open "), k))
    made = V.facts(s, d).select("id", importing.front_matter(text).alias("f"))
    return made.select("id", F.col("f.metadata")["title"].alias("title"), F.col("f.metadata")["note"].alias("note"), F.md5(F.concat(F.when(k % 3 == 0, F.lit("\n")).otherwise(F.lit("")), F.regexp_replace("f.body", "^\n+", ""))).alias("body"))


@query(
    "flattened_json",
    """SELECT id, unnest(['a.b', 'a.c[0]', 'a.c[1].d', 'e', 'f']) AS path, unnest([CAST(id AS VARCHAR), 'x', 'true', 'null', subject]) AS value FROM facts""",
)
def _(s, d):
    text = F.to_json(F.struct(F.struct(F.col("id").alias("b")).alias("a"), F.col("subject").alias("f")))
    whole = F.concat(F.lit('{"a": {"b": '), F.col("id"), F.lit(', "c": ["x", {"d": true}]}, "e": null, "f": '), F.to_json(F.struct("subject")).substr(F.lit(12), F.length(F.to_json(F.struct("subject"))) - 12), F.lit("}"))
    rows = V.facts(s, d).select("id", whole.alias("value"), text.alias("_"))
    broken = rows.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("{not json").alias("value"))
    return importing.flatten(rows.select("id", "value").unionByName(broken))


@query(
    "augmented_texts",
    """SELECT id, concat_ws(' ', CASE WHEN trim(section) <> '' THEN 'meta_has_source_section' END, CASE WHEN regexp_matches(source_file, 'memory|docs/|readme|decision|rule|prd|design|spec|architecture|roadmap', 'i') THEN 'meta_path_positive' END,
    CASE WHEN regexp_matches(source_file, '/tmp/', 'i') THEN 'meta_path_negative' END, 'meta_memory_class_big_rule', CASE WHEN strlen(content) < 20 THEN 'meta_len_tiny' ELSE 'meta_len_short' END, CASE WHEN id % 2 = 0 THEN 'meta_multiline' END,
    CASE WHEN regexp_matches(content, '\\b(status|import|search|test|build)\\b', 'i') THEN 'meta_ops_keyword' END, CASE WHEN regexp_matches(content, '/[a-z0-9]', 'i') THEN 'meta_endpoint_or_config' END) || chr(10) || content AS text
    FROM (SELECT id, source_file, section, CASE WHEN id % 2 = 0 THEN content || chr(10) || 'two' || chr(10) || 'three' ELSE content END AS content FROM notes)""",
    D.SQL["notes"],
)
def _(s, d):
    content = F.when(F.col("id") % 2 == 0, F.concat("content", F.lit("\ntwo\nthree"))).otherwise(F.col("content"))
    return D.notes(s, d).select("id", importing.augmented(content, F.col("source_file"), F.col("section"), F.lit("Big Rule")).alias("text"))


_MODEL = [("the", 1.5, -0.4), ("status", 2.0, -1.0), ("we decided", 3.0, 2.0), ("decided", 2.5, 1.0), ("plain words", 3.5, -2.0), ("she", 2.2, 0.7)]
_VALUES = ", ".join(f"('{f}', {i}::DOUBLE, {c}::DOUBLE)" for f, i, c in _MODEL)


@query(
    "keep_scores",
    """SELECT n.id, round(CASE WHEN norm IS NULL THEN 0 ELSE 1 / (1 + exp(-(dot / norm - 0.3))) END::DOUBLE, 9) AS score FROM notes n LEFT JOIN (SELECT id, sum(x * coef) AS dot, sqrt(sum(x * x)) AS norm FROM
    (SELECT id, feature, count(*) * idf AS x, coef FROM grams JOIN model USING (feature) GROUP BY id, feature, idf, coef) GROUP BY id) k ON k.id = n.id""",
    f"{D.SQL['notes']}, model AS (SELECT * FROM (VALUES {_VALUES}) AS t(feature, idf, coef)), w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9_]+') AS w FROM notes), grams AS (SELECT id, unnest(w) AS feature FROM w UNION ALL SELECT id, w[k] || ' ' || w[k + 1] FROM w, unnest(range(1, greatest(len(w), 1))) AS t(k))",
)
def _(s, d):
    model = s.createDataFrame(_MODEL, "feature string, idf double, coef double")
    return importing.keep_scores(D.notes(s, d).select("id", F.col("content").alias("text")), model, -0.3).select("id", F.round("score", 9).alias("score"))


# Approximate vectors


@query("vector_neighbours", None)
def _(s, d):
    """The ten closest vectors of every twentieth one, by the index; tests hold its recall."""
    rows = V.embeddings(s, d).select(F.col("memory_id").alias("id"), "vector")
    return vectors.search(vectors.index(rows, 64), rows.where("id % 20 = 0"))


@query("vector_neighbours_exact", "SELECT query_id, id, round(cosine, 6) AS cosine FROM (SELECT a.memory_id AS query_id, b.memory_id AS id, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) AS cosine FROM vectors a JOIN vectors b ON a.memory_id <> b.memory_id WHERE a.memory_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) <= 10")
def _(s, d):
    rows = V.embeddings(s, d).select(F.col("memory_id").alias("id"), "vector")
    return vectors.brute(rows, rows.where("id % 20 = 0"), 64).select("query_id", "id", F.round("cosine", 6).alias("cosine"))
