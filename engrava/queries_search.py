"""Queries of the stages of a search, of keyword search over postings, of lists and of entities, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.operators import entities, exports, keyword, listing, ranking, results, statistics
from engrava.plans import drafts as D
from engrava.plans import views as V
from engrava.plans.views import AS_OF
from engrava.registry import query

_NOTES = D.SQL["notes"]
_ACTIVE = "superseded_by IS NULL AND state NOT IN ('retired', 'superseded')"
_P = "lower(trim(source_file))"
_TIER = f"""CASE WHEN {_P} = 'memory.md' OR ends_with({_P}, '/memory.md') THEN 'core' WHEN ends_with({_P}, '.md') AND regexp_matches({_P}, '(^|/)memory/') THEN 'journal'
 WHEN regexp_matches({_P}, '(^|/)shared-context/') THEN 'context' WHEN contains({_P}, 'auto-capture') THEN 'capture' WHEN regexp_matches({_P}, '^/(var/folders|tmp)/') THEN 'transient' ELSE '' END"""
_CONNECTOR = "regexp_matches(lower(source_file), '^(github|gmail|calendar|drive|slack|discord|telegram|notion|obsidian):')"
_MEMORY = f"(ends_with({_P}, 'memory.md') OR contains({_P}, 'memory/'))"
_CAPTURED = f"contains({_P}, 'auto-capture')"
_WRAPPER = "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in results.WRAPPERS) + ")"
_LOW = "regexp_matches(trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')), 'fire the test|run test|run the test|heartbeat ok')"


@query("source_tiers", f"SELECT id, {_TIER} AS tier, round(CASE WHEN {_P} = '' THEN 1.0 ELSE CASE {_TIER} WHEN 'core' THEN 1.575 WHEN 'journal' THEN 1.365 WHEN 'context' THEN 1.26 WHEN 'capture' THEN 0.441 WHEN 'transient' THEN 0.735 ELSE CASE WHEN {_CONNECTOR} THEN 0.97 ELSE 1.05 END END END::DOUBLE, 9) AS weight FROM notes", _NOTES)
def _(s, d):
    path = F.col("source_file")
    return D.notes(s, d).select("id", results.source_tier(path).alias("tier"), F.round(results.source_weight(path), 9).alias("weight"))


for _intent, _held in (("memory", _MEMORY), ("connector", _CONNECTOR), ("import", f"NOT {_MEMORY} AND NOT {_CONNECTOR}")):

    @query(f"results_of_intent_{_intent}", f"SELECT id FROM notes WHERE {_held}", _NOTES)
    def _(s, d, intent=_intent):
        return results.of_intent(D.notes(s, d), intent).select("id")


@query("capture_penalty", f"SELECT id, round(score * CASE WHEN {_CAPTURED} AND {_WRAPPER} THEN 0.15 WHEN {_CAPTURED} AND {_LOW} THEN 0.05 ELSE 1.0 END::DOUBLE, 9) AS score FROM notes", _NOTES)
def _(s, d):
    return results.capture_penalty(D.notes(s, d)).select("id", F.round("score", 9).alias("score"))


@query("hybrid_prior", f"SELECT id, round(least(1.25, greatest(0.05, CASE WHEN ends_with({_P}, '/memory.md') OR ends_with({_P}, '/user.md') THEN 1.06 ELSE 1.0 END::DOUBLE * CASE WHEN {_CAPTURED} THEN 0.92 * CASE WHEN {_WRAPPER} THEN 0.35 WHEN {_LOW} THEN 0.55 ELSE 1.0 END ELSE 1.0 END::DOUBLE)), 9) AS prior FROM notes", _NOTES)
def _(s, d):
    return D.notes(s, d).select("id", F.round(results.hybrid_prior(F.col("source_file"), F.col("content")), 9).alias("prior"))


@query("low_signal_query", f"SELECT id FROM notes WHERE NOT ({_CAPTURED} AND ({_WRAPPER} OR {_LOW}))", _NOTES)
def _(s, d):
    return results.suppress_low_signal(D.notes(s, d), "HEARTBEAT_OK").select("id")


@query("off_topic_low_signal", f"SELECT id FROM notes WHERE NOT {_LOW}", _NOTES)
def _(s, d):
    return results.suppress_low_signal(D.notes(s, d), "what did Ann decide").select("id")


@query("suppression_fails_safe", f"SELECT id FROM notes WHERE {_LOW}", _NOTES)
def _(s, d):
    rows = D.notes(s, d)
    return results.suppress_low_signal(rows.where(results.is_low_signal(F.col("content"))), "anything").select("id")


@query("wrapper_noise", f"SELECT id FROM notes WHERE NOT ({_CAPTURED} AND {_WRAPPER})", _NOTES)
def _(s, d):
    return results.suppress_wrappers(D.notes(s, d)).select("id")


@query("results_by_metadata", "SELECT id FROM notes WHERE (lower(agent_id) = 'agent1' OR lower(agent_name) = 'agent1') AND (channel = 'irc' OR channel_name = 'irc') AND CAST(imported_at AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1997-06-30'", _NOTES)
def _(s, d):
    return results.of_metadata(D.notes(s, d), agent="AGENT1", channel="irc", after="1994-01-01", before="1997-06-30").select("id")


@query("metadata_boosts", "SELECT id, round(score * CASE WHEN lower(agent_id) = 'agent2' THEN 1.08 ELSE 1 END::DOUBLE * CASE WHEN channel = 'mail' THEN 1.05 ELSE 1 END::DOUBLE * CASE WHEN session_key = 'S2' THEN 1.15 ELSE 1 END::DOUBLE, 9) AS score FROM notes", _NOTES)
def _(s, d):
    return results.metadata_boosts(D.notes(s, d), "agent2", "Mail", "s2").select("id", F.round("score", 9).alias("score"))


@query("confidence_decay", f"SELECT n.id, round(score * (0.8 + 0.2 * coalesce(e, 1.0)), 9) AS score FROM notes n LEFT JOIN (SELECT memory_id, avg(effective) AS e FROM aged WHERE {_ACTIVE} GROUP BY 1) c ON c.memory_id = n.id", f"{_NOTES}, aged AS (SELECT *, confidence * exp(-decay_rate * (epoch(TIMESTAMP '{AS_OF}') - epoch(created_at)) / 86400.0) AS effective FROM facts)")
def _(s, d):
    mean = statistics.aged(V.facts(s, d), AS_OF).where(_ACTIVE).groupBy("memory_id").agg(F.avg("effective").alias("effective"))
    return results.confidence_decay(D.notes(s, d), mean).select("id", F.round("score", 9).alias("score"))


@query(
    "metadata_prefix",
    """SELECT id, CASE WHEN p = '' THEN '' ELSE p || chr(10) END AS prefix FROM (SELECT id, concat_ws(' ', CASE WHEN agent_id <> '' THEN 'agent:' || agent_id END, CASE WHEN agent_name NOT IN ('', agent_id) THEN 'agent:' || agent_name END,
    CASE WHEN channel <> '' THEN 'channel:' || channel END, CASE WHEN channel_name <> '' THEN 'channel:' || channel_name END, CASE WHEN surface NOT IN ('', channel) THEN 'surface:' || surface END,
    CASE WHEN model <> '' THEN 'model:' || model END, CASE WHEN timestamp_start <> '' THEN 'date:' || left(timestamp_start, 10) END) AS p FROM notes)""",
    _NOTES,
)
def _(s, d):
    return D.notes(s, d).select("id", results.metadata_prefix().alias("prefix"))


_SCOPED = "scoped AS (SELECT id AS memory_id, CASE id % 3 WHEN 0 THEN '' ELSE 'agent' || (id % 4) END AS agent_id, CASE id % 5 WHEN 0 THEN 's9' ELSE '' END AS session_id, '' AS project_id FROM drafts WHERE id % 2 = 0)"


@query("memories_in_scope", "SELECT n.id FROM notes n LEFT JOIN scoped f ON f.memory_id = n.id WHERE lower(coalesce(nullif(f.agent_id, ''), n.agent_id)) IN ('agent1', 'agent2') AND lower(coalesce(nullif(f.session_id, ''), n.session_key)) IN ('s1', 's9')", f"{_NOTES}, {D.SQL['drafts']}, {_SCOPED}")
def _(s, d):
    facts = D.drafts(s, d).where("id % 2 = 0").selectExpr("id AS memory_id", "CASE id % 3 WHEN 0 THEN '' ELSE concat('agent', id % 4) END AS agent_id", "CASE id % 5 WHEN 0 THEN 's9' ELSE ' ' END AS session_id", "'' AS project_id")
    notes = D.notes(s, d).withColumn("project", F.lit(""))
    return results.in_scope(facts, notes, agents=["Agent1", "agent2"], sessions=["S1", "s9"])


@query("pinned_directives", "SELECT 'directive' AS kind, id, (SELECT max(score) FROM notes) + 1 AS score FROM notes WHERE id % 50 = 0 UNION ALL SELECT 'memory', id, score FROM notes", _NOTES)
def _(s, d):
    notes = D.notes(s, d)
    return results.pin_directives(notes, notes.where("id % 50 = 0"))


@query("reranked", "SELECT query_id, id, CAST(place AS INTEGER) AS place FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos < 6 THEN 0 ELSE 1 END, CASE WHEN pos < 6 THEN CASE WHEN id % 5 = 0 THEN base ELSE (id * 7 % 13) / 13.0 END END DESC NULLS LAST, CASE WHEN pos < 6 THEN base END DESC NULLS LAST, pos) AS place FROM cand) WHERE place <= 8", f"{_NOTES}, cand AS (SELECT id % 40 AS query_id, id, score AS base, row_number() OVER (PARTITION BY id % 40 ORDER BY score DESC, id) - 1 AS pos FROM notes)")
def _(s, d):
    from pyspark.sql import Window

    notes = D.notes(s, d).withColumn("query_id", F.expr("id % 40"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1
    cand = notes.select("query_id", "id", F.col("score").alias("base"), at.alias("at"))
    return results.rerank(cand, notes.where("id % 5 <> 0").select("query_id", "id", F.expr("(id * 7 % 13) / 13.0D").alias("score")), 6, 8)


@query("scene_affinity", "SELECT id, round(CASE WHEN (l < 0.01 AND e = 0 AND t = 0 AND NOT a AND NOT b) OR x < 0.45 THEN 0 ELSE least(x, 0.95) END, 6) AS affinity FROM (SELECT *, 0.2 + 0.25 * p + 0.25 * l + 0.2 * e + 0.1 * t + CASE WHEN a THEN 0.15 ELSE 0 END + CASE WHEN b THEN 0.1 ELSE 0 END AS x FROM s)", "s AS (SELECT o_orderkey AS id, (o_orderkey % 7) / 6.0::DOUBLE AS p, (o_orderkey % 5) / 4.0::DOUBLE AS l, (o_orderkey % 3) / 2.0::DOUBLE AS e, (o_orderkey % 2)::DOUBLE AS t, o_orderkey % 11 = 0 AS a, o_orderkey % 13 = 0 AS b FROM orders)")
def _(s, d):
    k = F.col("o_orderkey")
    part = lambda n: (k % n) / float(n - 1)
    return s.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), F.round(results.scene_affinity(part(7), part(5), part(3), part(2), k % 11 == 0, k % 13 == 0), 6).alias("affinity"))


@query("channel_weights", "SELECT id, CASE s WHEN 'temporal' THEN [0.7, 0.8, 0.3, 1.4] WHEN 'entity' THEN [0.7, 0.8, 1.4, CASE WHEN a THEN 1.0 ELSE 0.3 END] WHEN 'comparison' THEN [0.8, 1.0, 1.2, CASE WHEN a THEN 1.0 ELSE 0.4 END] WHEN 'bridge' THEN [0.9, 1.1, 1.0, CASE WHEN a THEN 1.0 ELSE 0.7 END] ELSE [1.0, 1.0, 0.6, CASE WHEN a THEN 1.0 ELSE 0.4 END] END[4]::DOUBLE AS temporal FROM (SELECT o_orderkey AS id, (['temporal', 'entity', 'comparison', 'bridge', 'plain'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS s, o_orderkey % 2 = 0 AS a FROM orders)")
def _(s, d):
    strategy = F.expr("element_at(array('temporal', 'entity', 'comparison', 'bridge', 'plain'), cast(o_orderkey % 5 as int) + 1)")
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), results.channel_weights(strategy, F.col("o_orderkey") % 2 == 0)[3].alias("temporal"))


@query("entity_profile_results", f"SELECT memory_id, max(score) AS score, min_by(id, (-score, id)) AS fact_id FROM (SELECT memory_id, id, round(1.05 + CASE WHEN contains('what does 5-low say', lower(predicate)) THEN 0.1 ELSE 0.0 END::DOUBLE + 0.15 * confidence, 9) AS score FROM facts WHERE entity_id IN (1, 4, 7, 10, 13) AND superseded_by IS NULL) GROUP BY 1")
def _(s, d):
    text = F.when(F.contains(F.lit("what does 5-low say"), F.lower("predicate")), 0.1).otherwise(0.0)
    return results.profile_results(V.facts(s, d), "what does 5-low say", [1, 4, 7, 10, 13], text)


# Keyword search


_TERMS = "words AS (SELECT id, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda t: length(t) >= 2) AS w FROM memories), totals AS (SELECT count(*) AS docs, avg(len(w)) AS average FROM words)"


def _hits(*terms: str) -> str:
    """A column of the term frequency of each query term; a term that ends in * is a prefix."""
    test = lambda t: f"starts_with(x, '{t[:-1]}')" if t.endswith("*") else f"x = '{t}'"
    tf = ", ".join(f"len(list_filter(w, lambda x: {test(t)})) AS f{k}" for k, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(len(terms)))
    one = " + ".join(f"CASE WHEN f{k} > 0 THEN ln(1 + (docs - d{k} + 0.5) / (d{k} + 0.5)) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len(w) / average)) ELSE 0 END" for k in range(len(terms)))
    return f"{_TERMS}, freq AS (SELECT id, w, {tf} FROM words), df AS (SELECT {df} FROM freq), hits AS (SELECT id, {', '.join(f'f{k}' for k in range(len(terms)))}, round(tanh(({one}) / 10), 6) AS score FROM freq CROSS JOIN df CROSS JOIN totals)"


def _keyword(s, d, text, least=0.0):
    rows = V.memories(s, d)
    return keyword.search(keyword.index(rows), rows, text, least).select("id", F.round("score", 6).alias("score"), "how")


_ANY2, _ALL2 = "(f0 > 0 OR f1 > 0)", "f0 > 0 AND f1 > 0"


@query("keyword_and", f"SELECT id, score, 'and' AS how FROM hits WHERE {_ALL2}", _hits("the", "of"))
def _(s, d):
    return _keyword(s, d, "The of")


@query("keyword_or", f"SELECT id, score, CASE WHEN (SELECT count(*) FROM hits WHERE {_ALL2}) > 0 THEN 'and' ELSE 'or' END AS how FROM hits WHERE {_ANY2} AND ({_ALL2} OR (SELECT count(*) FROM hits WHERE {_ALL2}) = 0)", _hits("the", "zzzznowhere"))
def _(s, d):
    return _keyword(s, d, "the zzzznowhere")


@query("keyword_not", "SELECT id, score, 'and' AS how FROM hits WHERE f0 > 0 AND id NOT IN (SELECT id FROM words WHERE list_contains(w, 'and'))", _hits("the"))
def _(s, d):
    return _keyword(s, d, "the -and")


@query("keyword_phrase", "SELECT id, score, 'and' AS how FROM hits JOIN memories USING (id) WHERE f0 > 0 AND f1 > 0 AND contains(' ' || array_to_string(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda t: t <> ''), ' ') || ' ', ' of the ')", _hits("of", "the"))
def _(s, d):
    return _keyword(s, d, '"of the"')


@query("keyword_prefix", "SELECT id, score, 'and' AS how FROM hits WHERE f0 > 0 AND f1 > 0", _hits("the", "com*"))
def _(s, d):
    return _keyword(s, d, "the com*")


@query("keyword_minimum_score", "SELECT id, score, 'and' AS how FROM hits WHERE f0 > 0 AND score >= 0.05", _hits("com*"))
def _(s, d):
    found = _keyword(s, d, "com*")
    return found.where("score >= 0.05")


@query("keyword_like", "SELECT id, 0.05::DOUBLE AS score, 'like' AS how FROM memories WHERE contains(content, 'é')")
def _(s, d):
    return _keyword(s, d, "é")


# Lists and point reads


@query("facts_of_entities", f"SELECT id FROM facts WHERE {_ACTIVE} AND entity_id IN (1, 4, 7, 10) ORDER BY created_at DESC, id DESC LIMIT 20")
def _(s, d):
    return listing.facts(V.facts(s, d), entities=[1, 4, 7, 10], limit=20).select("id")


@query("facts_with_superseded", "SELECT id FROM facts WHERE memory_id IN (3, 5, 8) AND fact_type = 'kv'")
def _(s, d):
    return listing.facts(V.facts(s, d), fact_type="kv", memories=[3, 5, 8], superseded=True).select("id")


@query("get_memory", "SELECT id, content FROM memories WHERE id = 7")
def _(s, d):
    return listing.memory(V.memories(s, d), 7).select("id", "content")


for _name, _expr in (("content_hash", "sha256(concat(source_file, chr(0), content))"), ("content_only_hash", "sha256(content)")):

    @query(f"find_by_{_name}", f"SELECT id FROM memories WHERE {_expr} IN (SELECT {_expr} FROM memories WHERE id % 9 = 0)")
    def _(s, d, column=_name):
        from engrava.functions import text as T

        rows = V.memories(s, d).withColumn("content_hash", T.hash_with_path(F.col("content"), F.col("source_file"))).withColumn("content_only_hash", T.hash_content(F.col("content")))
        return listing.by_hash(rows, rows.where("id % 9 = 0").select(column).distinct(), column).select("id")


@query("list_alerts", "SELECT id FROM alerts WHERE alert_type = 'match' AND severity = 'info' AND NOT acknowledged AND created_at >= TIMESTAMP '1995-01-01' ORDER BY created_at DESC, id DESC LIMIT 30", D.SQL["alerts"])
def _(s, d):
    return listing.alerts(D.alerts(s, d), "match", "info", acknowledged=False, since="1995-01-01 00:00:00", limit=30).select("id")


@query("acknowledge_all_alerts", "SELECT id, true AS acknowledged FROM alerts", D.SQL["alerts"])
def _(s, d):
    return listing.acknowledged_all(D.alerts(s, d)).select("id", "acknowledged")


@query("list_ledger", "SELECT id FROM accesses WHERE created_at >= TIMESTAMP '2024-01-20' AND agent_id = 'agent2' ORDER BY created_at DESC, id DESC LIMIT 25")
def _(s, d):
    return listing.ledger(V.accesses(s, d).withColumn("project", F.col("agent_id")), "2024-01-20 00:00:00", "agent2", 25).select("id")


@query("list_directives", "SELECT id FROM notes WHERE agent_id = 'Agent2' AND channel = 'irc'", _NOTES)
def _(s, d):
    return listing.directives(D.notes(s, d).withColumn("scope", F.col("agent_id")).withColumn("status", F.col("channel")), "Agent2", "irc").select("id")


@query("list_proposals", "SELECT id FROM alerts WHERE severity = 'critical'", D.SQL["alerts"])
def _(s, d):
    return listing.with_status(D.alerts(s, d).withColumn("status", F.col("severity")), "critical").select("id")


@query("edges_by_type", "SELECT source_fact_id, target_fact_id FROM edges WHERE edge_type = 'supports' ORDER BY source_fact_id DESC, target_fact_id DESC LIMIT 40")
def _(s, d):
    return listing.edges(V.edges(s, d), "supports", limit=40).select("source_fact_id", "target_fact_id")


@query("cooccurrences_of_fact", "SELECT fact_id_a, fact_id_b, count FROM cooccurrence WHERE 7 IN (fact_id_a, fact_id_b) ORDER BY count DESC, fact_id_a, fact_id_b LIMIT 10")
def _(s, d):
    return listing.cooccurrences(V.cooccurrence(s, d), 7, 10)


@query("entity_aliases", "SELECT id, subject FROM names WHERE entity_id = 5", D.SQL["names"])
def _(s, d):
    return listing.aliases(D.names(s, d), 5).select("id", "subject")


@query("watch_digest", "SELECT watch_id, 'watch ' || watch_id AS query, count(*) AS matches, max(created_at) AS last FROM alerts WHERE alert_type = 'match' AND NOT acknowledged AND created_at > TIMESTAMP '1994-06-01' AND watch_id % 2 = 0 AND watch_id < 20 GROUP BY 1", D.SQL["alerts"])
def _(s, d):
    watches = s.range(20).select("id", F.concat(F.lit("watch "), "id").alias("query"), (F.col("id") % 2 == 0).alias("active"))
    return listing.watch_digest(watches, D.alerts(s, d), "1994-06-01 00:00:00")


@query("decay_inferred_edges", "SELECT id FROM alerts WHERE severity <> 'info' OR created_at >= TIMESTAMP '1996-01-01'", D.SQL["alerts"])
def _(s, d):
    rows = D.alerts(s, d).withColumn("source", F.when(F.col("severity") == "info", "inferred").otherwise("explicit"))
    return listing.decayed_edges(rows, "1996-01-01 00:00:00").select("id")


_ONE = f"one AS (SELECT f.* FROM facts f JOIN facts g ON lower(f.subject) = lower(g.subject) AND lower(f.predicate) = lower(g.predicate) AND lower(f.object) <> lower(g.object) AND g.{_ACTIVE.replace('state', 'g.state')} ORDER BY f.id LIMIT 1)"


@query("conflicts_of_fact", f"SELECT f.id, f.agent_id <> one.agent_id AS cross_agent FROM (SELECT f.* FROM facts f JOIN one o ON lower(f.subject) = lower(o.subject) AND lower(f.predicate) = lower(o.predicate) AND f.id <> o.id WHERE f.superseded_by IS NULL AND f.state NOT IN ('retired', 'superseded') AND f.confidence > 0 ORDER BY f.id LIMIT 20) f, one WHERE lower(f.object) <> lower(one.object)", _ONE)
def _(s, d):
    rows = V.facts(s, d)
    key = [F.lower(c) for c in ("subject", "predicate")]
    met = listing.active(rows).select(key[0].alias("_s"), key[1].alias("_p"), F.lower("object").alias("_o"))
    first = rows.join(met, (key[0] == F.col("_s")) & (key[1] == F.col("_p")) & (F.lower("object") != F.col("_o")), "left_semi").orderBy("id").limit(1)
    return listing.conflicts_of(rows, first)


@query("distinct_subjects", f"SELECT count(DISTINCT lower(trim(subject))) AS n FROM facts WHERE {_ACTIVE} AND trim(subject) <> ''")
def _(s, d):
    return listing.subjects(V.facts(s, d))


@query("infer_project_from_path", f"SELECT id, CASE WHEN {_P} = '' THEN '' WHEN contains({_P}, 'capture') THEN 'inbox' WHEN contains({_P}, 'memory') THEN 'memory' WHEN contains({_P}, 'src/') THEN 'code' ELSE '' END AS project FROM notes", _NOTES)
def _(s, d):
    return D.notes(s, d).select("id", ranking.project_of_path(F.col("source_file"), [("Capture", "inbox"), ("memory", "memory"), ("src/", "code")]).alias("project"))


# Entities


_NAME = "trim(regexp_replace(trim(trim({}), '\"''`.,;:!?()[]{{}}<>'), '\\s+', ' ', 'g'))"
_PRONOUNS = ", ".join(f"'{p}'" for p in entities.PRONOUNS)
_NAMED = f"{D.SQL['names']}, named AS (SELECT *, {_NAME.format('subject')} AS n, lower({_NAME.format('subject')}) IN ({_PRONOUNS}) AS pronoun FROM names)"
_ORG = "(inc|corp|llc|ltd|company|group|foundation|bank|agency|institute|university)"
_PLACE = "(city|state|county|island|river|mountain|lake|park|street|avenue|road|district)"


@query("entity_names", "SELECT id, n AS name, n <> '' AND NOT pronoun AND NOT regexp_matches(n, '^\\d+$') AND (length(n) > 1 OR regexp_matches(n, '^\\p{Lu}$')) AS creates FROM named", _NAMED)
def _(s, d):
    return D.names(s, d).select("id", entities.normal_name(F.col("subject")).alias("name"), entities.names_something(F.col("subject")).alias("creates"))


@query("entity_types", f"SELECT id, CASE WHEN fact_type = 'location' THEN 'place' WHEN fact_type = 'identity' AND p THEN 'person' WHEN regexp_matches(n, '\\b{_ORG}\\b', 'i') THEN 'org' WHEN regexp_matches(n, '\\b{_PLACE}\\b', 'i') THEN 'place' WHEN p THEN 'person' ELSE 'concept' END AS type FROM (SELECT *, regexp_matches(n, '^[A-Z][a-z]+( [A-Z][a-z]+){{0,2}}$') AS p FROM named)", _NAMED)
def _(s, d):
    return D.names(s, d).select("id", entities.entity_type(entities.normal_name(F.col("subject")), F.col("fact_type")).alias("type"))


@query("pronoun_entities", "SELECT id, last FROM (SELECT id, pronoun, last_value(CASE WHEN NOT pronoun AND entity_id > 0 THEN entity_id END IGNORE NULLS) OVER (PARTITION BY memory_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM named) WHERE pronoun", _NAMED)
def _(s, d):
    return entities.resolve_pronouns(D.names(s, d)).select("id", F.col("entity_id").alias("last"))


_KNOWN = "known AS (SELECT lower(n) AS k, min(entity_id) AS found FROM named WHERE entity_id > 0 AND id % 2 = 0 GROUP BY 1)"


@query("entity_backfill", "SELECT id, coalesce(found, 0) AS entity_id, CASE WHEN found IS NOT NULL THEN '' WHEN n = '' THEN 'empty_name' WHEN pronoun THEN 'pronoun_without_context' WHEN regexp_matches(n, '^\\d+$') THEN 'numeric_identifier' ELSE 'unresolved' END AS reason FROM named LEFT JOIN known ON k = lower(n) WHERE entity_id = 0", f"{_NAMED}, {_KNOWN}")
def _(s, d):
    rows = D.names(s, d)
    return entities.backfill(rows, rows.where("entity_id > 0 AND id % 2 = 0").select("entity_id", F.col("subject").alias("name")))


_MERGED = f"{D.SQL['names']}, aliases AS (SELECT DISTINCT entity_id, subject AS alias FROM names WHERE entity_id > 0), own AS (SELECT entity_id, 'Entity ' || entity_id AS name FROM names WHERE entity_id > 0 GROUP BY 1)"


@query("merged_aliases", "SELECT entity_id, min(alias) AS alias FROM (SELECT CASE WHEN entity_id = 4 THEN 2 ELSE entity_id END AS entity_id, alias FROM (SELECT * FROM aliases UNION ALL SELECT entity_id, name FROM own WHERE entity_id = 4)) GROUP BY entity_id, lower(alias) HAVING NOT (entity_id = 2 AND lower(alias) = 'entity 2')", _MERGED)
def _(s, d):
    rows = D.names(s, d)
    known = rows.where("entity_id > 0")
    own = known.select("entity_id", F.concat(F.lit("Entity "), "entity_id").alias("name")).distinct()
    return entities.merge(rows, known.select("entity_id", F.col("subject").alias("alias")).distinct(), own, 2, 4)["aliases"]


@query("merged_facts", "SELECT id, CASE WHEN entity_id = 4 THEN 2 ELSE entity_id END AS entity_id FROM names", D.SQL["names"])
def _(s, d):
    rows = D.names(s, d)
    return entities.merge(rows, rows.selectExpr("entity_id", "subject AS alias"), rows.selectExpr("entity_id", "subject AS name"), 2, 4)["facts"].select("id", "entity_id")


@query("entity_profiles", "SELECT entity_id, string_agg('- ' || predicate || ': ' || object, chr(10) ORDER BY confidence DESC, id) AS profile FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, id) AS r FROM names WHERE id % 7 <> 0) WHERE r <= 20 GROUP BY 1", D.SQL["names"])
def _(s, d):
    return entities.profiles(D.names(s, d).withColumn("superseded_by", F.expr("CASE WHEN id % 7 = 0 THEN id END")), 20)


# The stages together, searches of facts, exports


_WEIGHT = f"CASE WHEN {_P} = '' THEN 1.0 ELSE CASE {_TIER} WHEN 'core' THEN 1.575 WHEN 'journal' THEN 1.365 WHEN 'context' THEN 1.26 WHEN 'capture' THEN 0.441 WHEN 'transient' THEN 0.735 ELSE CASE WHEN {_CONNECTOR} THEN 0.97 ELSE 1.05 END END END::DOUBLE"


@query(
    "search_stages",
    f"""SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM (SELECT n.id, round(score * {_WEIGHT} * CASE WHEN lower(agent_id) = 'agent1' THEN 1.08 ELSE 1 END::DOUBLE * (0.8 + 0.2 * coalesce(e, 1.0)), 9) AS score
    FROM notes n LEFT JOIN (SELECT memory_id, avg(confidence) AS e FROM facts GROUP BY 1) c ON c.memory_id = n.id WHERE n.id % 3 = 0 AND NOT ({_CAPTURED} AND {_WRAPPER}) AND NOT {_LOW} ORDER BY score DESC, n.id LIMIT 25)""",
    _NOTES,
)
def _(s, d):
    notes = D.notes(s, d)
    mean = V.facts(s, d).groupBy("memory_id").agg(F.avg("confidence").alias("effective"))
    return results.ranked(notes.where("id % 3 = 0").select("id", "score"), notes, "what was decided", mean, agent="agent1", limit=25)


@query(
    "search_facts",
    f"""SELECT f.id, round(t * {_WEIGHT} * (0.75 + 0.25 * least(1.0, confidence)), 9) AS score FROM (SELECT *, (CASE WHEN contains(lower(subject), '000001') THEN 0.6 ELSE 0.1 END + CASE predicate WHEN '1-URGENT' THEN 0.3 ELSE 0.0 END)::DOUBLE AS t FROM facts) f
    JOIN notes ON notes.id = f.memory_id WHERE t >= 0.3 ORDER BY score DESC, f.id DESC LIMIT 30""",
    _NOTES,
)
def _(s, d):
    text = F.when(F.lower("subject").contains("000001"), 0.6).otherwise(0.1) + F.when(F.col("predicate") == "1-URGENT", 0.3).otherwise(0.0)
    return results.search_facts(V.facts(s, d), D.notes(s, d), text, 0.3, 30)


_TOPICS = {"work": ["status", "host"], "people": ["ann", "bob"]}
_NAMED_DRAFTS = f"{D.SQL['drafts']}, named AS (SELECT trim(subject) AS subject, object, CASE WHEN regexp_matches(lower(subject || ' ' || predicate || ' ' || object), 'status|host') THEN 'work' WHEN regexp_matches(lower(subject || ' ' || predicate || ' ' || object), 'ann|bob') THEN 'people' ELSE 'general' END AS topic FROM drafts WHERE strlen(trim(subject)) BETWEEN 2 AND 40 AND NOT regexp_matches(trim(subject), '^[0-9./$~\\\\]') AND lower(trim(subject)) <> 'unknown'), idx AS (SELECT subject, count(*) AS refs, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics FROM named GROUP BY 1)"


def _entity_index(s, d):
    return exports.entity_index(D.drafts(s, d), _TOPICS, blocked=["UNKNOWN", "spear"], allowed=["Spear"], longest=40)


@query("entity_index", "SELECT subject, refs, topics FROM idx", _NAMED_DRAFTS)
def _(s, d):
    return _entity_index(s, d)


_HUBS = "hubs AS (SELECT *, CASE WHEN regexp_matches(subject, '^[A-Z][a-z]+ [A-Z][a-z]+$') THEN 'person' ELSE 'concept' END AS kind FROM idx WHERE refs >= CASE WHEN subject = 'message 12' THEN 1 WHEN regexp_matches(subject, '^[A-Z][a-z]+ [A-Z][a-z]+$') THEN 3 ELSE 90 END)"


def _hubs_of(s, d):
    kind = F.when(F.col("subject").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$"), "person").otherwise("concept")
    return exports.select_hubs(_entity_index(s, d), kind, 3, 90, allowed=["message 12"])


@query("entity_hubs", "SELECT subject, refs, topics, kind FROM hubs", f"{_NAMED_DRAFTS}, {_HUBS}")
def _(s, d):
    return _hubs_of(s, d)


@query("pruned_hubs", "SELECT subject FROM hubs h WHERE kind <> 'concept' OR len(string_split(topics, ',')) + (SELECT count(DISTINCT o.subject) FROM named n JOIN hubs o ON o.subject <> n.subject AND contains(n.object, o.subject) WHERE n.subject = h.subject) >= 4", f"{_NAMED_DRAFTS}, {_HUBS}")
def _(s, d):
    return exports.prune_weak(_hubs_of(s, d), D.drafts(s, d), 4).select("subject")


@query("graph_lines", "SELECT 'node' AS kind, '{\"id\":' || id || ',\"predicate\":\"' || predicate || '\"}' AS json FROM facts WHERE id < 200 UNION ALL SELECT 'edge', '{\"source_fact_id\":' || source_fact_id || ',\"target_fact_id\":' || target_fact_id || '}' FROM edges WHERE edge_type = 'supports'")
def _(s, d):
    return exports.graph_lines(V.facts(s, d).where("id < 200").select("id", "predicate"), V.edges(s, d).where("edge_type = 'supports'").select("source_fact_id", "target_fact_id"))
