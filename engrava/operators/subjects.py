"""What belongs to a subject, a cluster or a node: facts in a range of days, neighbours, pages, and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.operators.admission import active


def _days(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Rows made between two days, both included."""
    day = F.to_date("created_at")
    return rows.where((day >= F.lit(first).cast("date")) & (day <= F.lit(last).cast("date")))


def _same(column: str, value: str) -> Column:
    return F.lower(column) == value.lower()


def timeline_facts(rows: DataFrame, memories: DataFrame, subjects: list[str], main: str, first: str, last: str, least_confidence: float) -> DataFrame:
    """``id, subject, predicate, object, confidence, source_file, created_at, superseded``: the subjects' facts of some days; of all but the ``main`` subject only confident or superseded ones."""
    names = sorted({s.strip().lower() for s in subjects if s.strip()})
    held = _days(rows, first, last).where(F.lower("subject").isin(names)).where(_same("subject", main) | (F.col("confidence") >= least_confidence) | F.col("superseded_by").isNotNull())
    m = memories.select(F.col("id").alias("memory_id"), "source_file")
    return held.join(m, "memory_id", "left").select("id", "subject", "predicate", "object", "confidence", F.coalesce("source_file", F.lit("")).alias("source_file"), "created_at", F.coalesce(F.col("superseded_by") > 0, F.lit(False)).alias("superseded"))


def _base(rows: DataFrame, subject: str, first: str, last: str, least_confidence: float) -> DataFrame:
    return _days(rows, first, last).where(_same("subject", subject) & ((F.col("confidence") >= least_confidence) | F.col("superseded_by").isNotNull()))


def _most_confident_subjects(rows: DataFrame, subject: str, first: str, last: str, most: int) -> DataFrame:
    other = _days(rows, first, last).where(~_same("subject", subject) & (F.trim("subject") != ""))
    named = other.groupBy(F.lower("subject").alias("subject")).agg(F.max("confidence").alias("confidence"), F.max("created_at").alias("last"))
    return named.orderBy(F.desc("confidence"), F.desc("last"), "subject").limit(most).select("subject")


def related_subjects(rows: DataFrame, edges: DataFrame, subject: str, first: str, last: str, least_confidence: float, most: int = 8) -> DataFrame:
    """``subject``: the ``most`` subjects, by their best confidence, then their last fact, then name, of facts that an edge joins to one of this subject's."""
    base = _base(rows, subject, first, last, least_confidence).select(F.col("id").alias("_b"))
    near = edges.join(base, edges["source_fact_id"] == F.col("_b")).select(F.col("target_fact_id").alias("id")).unionByName(edges.join(base, edges["target_fact_id"] == F.col("_b")).select(F.col("source_fact_id").alias("id")))
    return _most_confident_subjects(rows.join(near.distinct(), "id", "left_semi"), subject, first, last, most)


def subjects_of_same_memories(rows: DataFrame, subject: str, first: str, last: str, least_confidence: float, most: int = 8) -> DataFrame:
    """The same by shared memories, for a store without edges."""
    base = _base(rows, subject, first, last, least_confidence).select("memory_id").distinct()
    return _most_confident_subjects(rows.join(base, "memory_id", "left_semi"), subject, first, last, most)


def induced_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Co-occurring pairs with both facts among ``node``."""
    return pairs.join(nodes.select(F.col("node").alias("fact_id_a")), "fact_id_a", "left_semi").join(nodes.select(F.col("node").alias("fact_id_b")), "fact_id_b", "left_semi")


def describe_nodes(nodes: DataFrame, rows: DataFrame, memories: DataFrame) -> DataFrame:
    """``node, facts, last, providers``: of each node's (``node, subject``) subject its facts, the last day of one, and the kinds of source, in order: what stands before a path's first ``:`` or ``/``."""
    provider = F.regexp_extract(F.lower("source_file"), "^([^:/]+)[:/]", 1)
    m = memories.select(F.col("id").alias("memory_id"), provider.alias("provider"))
    facts = rows.select(F.lower("subject").alias("s"), "memory_id", "created_at").join(m, "memory_id", "left")
    known = facts.groupBy("s").agg(F.count("*").alias("facts"), F.to_date(F.max("created_at")).alias("last"), F.array_join(F.array_sort(F.collect_set(F.nullif("provider", F.lit("")))), ",").alias("providers"))
    return nodes.select("node", F.lower("subject").alias("s")).join(known, "s", "left").select("node", F.coalesce("facts", F.lit(0)).alias("facts"), "last", F.coalesce("providers", F.lit("")).alias("providers"))


def cluster_facts(rows: DataFrame, members: DataFrame, cluster: int, limit: int = 1000) -> DataFrame:
    """A cluster's facts (``members``: ``cluster_id, fact_id``), the most confident first, of equals the later."""
    of = members.where(F.col("cluster_id") == cluster).select(F.col("fact_id").alias("id"))
    return rows.join(of, "id", "left_semi").orderBy(F.desc("confidence"), F.desc("id")).limit(limit)


def top_subjects(rows: DataFrame, members: DataFrame, most: int = 5) -> DataFrame:
    """``cluster_id, subject, n``: each cluster's most frequent subjects, of equals by name."""
    counted = rows.join(members.select(F.col("fact_id").alias("id"), "cluster_id"), "id").groupBy("cluster_id", "subject").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "subject"))
    return counted.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def page(rows: DataFrame, offset: int, limit: int, *order: Column | str) -> DataFrame:
    """``rank`` and the rows from ``offset`` on, ``limit`` of them, in an order: of the rows only the first ``offset + limit`` are ever sorted together."""
    top = rows.orderBy(*order).limit(offset + limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)  # one page and what comes before
    return ranked.where(F.col("rank") >= offset)


def subject_page(rows: DataFrame, subject: str, offset: int, limit: int, least_confidence: float = 0.0) -> DataFrame:
    """``rank, id, total``: a page of a subject's valid facts by confidence, and how many there are."""
    held = active(rows).where(_same("subject", subject) & (F.col("confidence") >= least_confidence)).select("id", "confidence")
    total = held.agg(F.count("*").alias("total"))
    return page(held, offset, limit, F.desc("confidence"), F.asc("id")).crossJoin(F.broadcast(total)).select("rank", "id", "total")


def impact_roots(rows: DataFrame, subject: str, least_confidence: float = 0.0, most: int = 120) -> DataFrame:
    """``node``: the subject's valid facts to start from, the most confident ones."""
    held = active(rows).where(_same("subject", subject) & (F.col("confidence") >= least_confidence))
    return held.orderBy(F.desc("confidence"), "id").limit(most).select(F.col("id").alias("node"))


def sparse_chains(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``source_fact_id, target_fact_id``: a chain by id through the facts of each subject none of whose facts has an edge to another of them."""
    named = rows.select("id", F.lower("subject").alias("s"))
    a, b = named.toDF("source_fact_id", "sa"), named.toDF("target_fact_id", "sb")
    linked = edges.select("source_fact_id", "target_fact_id").join(a, "source_fact_id").join(b, "target_fact_id").where("sa = sb").select(F.col("sa").alias("s")).distinct()
    after = F.lead("id").over(Window.partitionBy("s").orderBy("id"))
    return named.join(linked, "s", "left_anti").select(F.col("id").alias("source_fact_id"), after.alias("target_fact_id")).where("target_fact_id IS NOT NULL")


def belief_report(rows: DataFrame, log: DataFrame, least_accesses: int = 3, least_confidence: float = 0.5) -> DataFrame:
    """``id, sources, accesses, promotes``: of each valid fact how many memories say the same triple, how often it was used, and whether a policy would promote it."""
    key = [F.lower(F.trim(c)).alias(f"_{c}") for c in ("subject", "predicate", "object")]
    live = active(rows).select("id", "memory_id", "state", "confidence", *key)
    said = live.groupBy("_subject", "_predicate", "_object").agg(F.countDistinct("memory_id").alias("sources"))
    used = log.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("accesses"))
    out = live.join(said, ["_subject", "_predicate", "_object"]).join(used, "id", "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)))
    return out.select("id", "sources", "accesses", ((F.col("state") == "active") & (F.col("accesses") >= least_accesses) & (F.col("confidence") >= least_confidence)).alias("promotes"))
