"""Counts, distributions, conflicts, proposals and growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions import text as T
from engrava.operators.admission import active


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def aged(rows: DataFrame, as_of: str) -> DataFrame:
    """Adds ``days`` and ``effective``, the confidence that decay has left."""
    days = T.days_between(F.col("created_at").cast("timestamp_ntz"), instant(as_of))
    return rows.withColumn("days", days).withColumn("effective", F.col("confidence") * F.exp(-F.col("decay_rate") * F.col("days")))


def confidence_distribution(rows: DataFrame, as_of: str) -> DataFrame:
    """``high, medium, low``: facts by effective confidence, cut at 0.7 and 0.3."""
    bucket = lambda c: F.count(F.when(c, 1))
    e = F.col("effective")
    return aged(rows, as_of).agg(bucket(e >= 0.7).alias("high"), bucket((e >= 0.3) & (e < 0.7)).alias("medium"), bucket(e < 0.3).alias("low"))


def freshness(rows: DataFrame, as_of: str, at: str = "created_at") -> DataFrame:
    """Rows of today, of the last week, of the last month, and older."""
    days = F.datediff(instant(as_of), F.col(at))
    bucket = lambda lo, hi: F.count(F.when((days >= lo) & (days < hi), 1))
    return rows.agg(bucket(-(10**6), 1).alias("today"), bucket(1, 7).alias("week"), bucket(7, 30).alias("month"), bucket(30, 10**6).alias("older"))


def access_summary(log: DataFrame) -> DataFrame:
    """For each fact its accesses, by kind, its agents, the last, and whether several agents used it."""
    kinds = [F.count(F.when(F.col("access_type") == k, 1)).alias(f"n_{k}") for k in ("reinforce", "import", "reference", "search")]
    out = log.groupBy("fact_id").agg(F.count("*").alias("n"), *kinds, F.max("created_at").alias("last"), F.countDistinct("agent_id").alias("agents"))
    return out.withColumn("cross_agent", F.col("agents") >= 2)


def conflict_groups(rows: DataFrame, longest_subject: int = 40) -> DataFrame:
    """Subjects and predicates, lower-cased, with more than one object among active facts."""
    s, p = F.lower("subject").alias("s"), F.lower("predicate").alias("p")
    return active(rows).where(F.octet_length("subject") <= longest_subject).groupBy(s, p).agg(F.countDistinct("object").alias("objects"), F.count("*").alias("n")).where("objects > 1")


def conflicts(rows: DataFrame, newest: int = 10) -> DataFrame:
    """``id1, id2``: pairs with differing objects among the ``newest`` facts of each conflict group."""
    rank = F.row_number().over(Window.partitionBy("s", "p").orderBy(F.desc("created_at"), F.desc("id")))
    live = active(rows).select("id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), "object", "created_at")
    top = live.join(conflict_groups(rows).select("s", "p"), ["s", "p"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= newest)
    a, b = (top.select("s", "p", F.col("rank").alias(f"r{x}"), F.col("id").alias(f"id{x}"), F.col("object").alias(f"o{x}")) for x in "12")
    return a.join(b, ["s", "p"]).where("r1 < r2 AND o1 <> o2").select("id1", "id2")


def decay_digest(rows: DataFrame, as_of: str, critical: float = 0.3, warning: float = 0.5) -> DataFrame:
    """For each lower-cased subject its facts below the thresholds and the worst."""
    low = aged(active(rows), as_of).where(F.col("effective") < warning)
    return low.groupBy(F.lower("subject").alias("subject")).agg(F.count(F.when(F.col("effective") < critical, 1)).alias("critical"), F.count(F.when(F.col("effective") >= critical, 1)).alias("warning"), F.round(F.min("effective"), 6).alias("worst"))


def proposals(ledger: DataFrame, since: str, at_least: int = 3) -> DataFrame:
    """Patterns seen often enough since an instant: occurrences and their window."""
    recent = ledger.where((F.col("created_at") >= instant(since)) & (F.col("fix_pattern") != ""))
    out = recent.groupBy("fix_pattern").agg(F.count("*").alias("occurrences"), F.min("created_at").alias("window_start"), F.max("created_at").alias("window_end"), F.min("id").alias("first_id"))
    return out.where(F.col("occurrences") >= at_least)


def stale(rows: DataFrame, as_of: str, least_days: int = 30, below: float = 0.5) -> DataFrame:
    """``id, days, effective`` of active facts that are old and have decayed; whole days count."""
    d = F.floor("days")
    out = aged(active(rows), as_of).withColumn("whole", d).withColumn("e", F.col("confidence") * F.exp(-F.col("decay_rate") * d))
    return out.where((F.col("whole") >= least_days) & (F.col("e") < below)).select("id", F.col("whole").alias("days"), F.round("e", 6).alias("effective"))


def growth(rows: DataFrame, as_of: str, windows: tuple[int, ...] = (1, 7, 30), at: str = "imported_at") -> DataFrame:
    """``source_type, days, n``: rows added in each window, by the kind of their source."""
    ext = T.extension(F.col("source_file"))
    kind = F.when(ext == ".md", "markdown").when(ext.isin(".json", ".yaml", ".yml"), "structured").when(ext.isin(".csv", ".tsv"), "table").otherwise("other")
    age = T.days_between(F.col(at), instant(as_of))
    each = rows.select(kind.alias("source_type"), age.alias("age")).withColumn("days", F.explode(F.array(*map(F.lit, windows))))
    return each.where((F.col("age") >= 0) & (F.col("age") <= F.col("days"))).groupBy("source_type", "days").agg(F.count("*").alias("n"))


def inferred_edges(pairs: DataFrame, edges: DataFrame, at_least: int = 5) -> DataFrame:
    """Edges that co-occurrence suggests where there is none in either direction; 0.5 at five meetings, 0.02 more for each, up to 0.9."""
    known = edges.select(F.least("source_fact_id", "target_fact_id").alias("fact_id_a"), F.greatest("source_fact_id", "target_fact_id").alias("fact_id_b")).distinct()
    new = pairs.where(F.col("count") >= at_least).join(known, ["fact_id_a", "fact_id_b"], "left_anti")
    return new.select("fact_id_a", "fact_id_b", F.round(F.least(F.lit(0.9), 0.5 + 0.02 * (F.col("count") - 5)), 6).alias("confidence"))


def cluster_rollup(rows: DataFrame) -> DataFrame:
    """For each cluster (here a project) its most frequent subject, its facts and their mean confidence."""
    each = rows.groupBy("project_id", "subject").agg(F.count("*").alias("n"), F.sum("confidence").alias("c"))
    best = F.min_by("subject", F.struct(-F.col("n"), F.col("subject")))
    return each.groupBy("project_id").agg(best.alias("name"), F.sum("n").alias("facts"), F.round(F.sum("c") / F.sum("n"), 6).alias("avg_confidence"))


def sessions(log: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """``agent_id, session, n``: a session ends where an agent pauses for longer than the gap."""
    w = Window.partitionBy("agent_id").orderBy("created_at", "id")
    gap = F.timestamp_diff("SECOND", F.lag("created_at").over(w), F.col("created_at")) > 60 * gap_minutes
    marked = log.select("agent_id", "created_at", "id", F.coalesce(gap, F.lit(True)).cast("long").alias("new"))
    return marked.withColumn("session", F.sum("new").over(w)).groupBy("agent_id", "session").agg(F.count("*").alias("n"))
