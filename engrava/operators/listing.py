"""Point reads and lists of the model's tables, by their filters; newest first where a limit asks for an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.operators.admission import active


def _newest(rows: DataFrame, limit: int | None, *order) -> DataFrame:
    return rows if limit is None else rows.orderBy(*(order or (F.desc("created_at"), F.desc("id")))).limit(limit)


def _where(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have these values, or one of several; None asks for nothing."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return rows


def facts(rows: DataFrame, fact_type: str | None = None, agents: list[str] | None = None, memories: list[int] | None = None, entities: list[int] | None = None, superseded: bool = False, limit: int | None = None) -> DataFrame:
    """Facts by type, agents, memories and entities; only those still valid unless ``superseded``."""
    return _newest(_where(rows if superseded else active(rows), fact_type=fact_type, agent_id=agents, memory_id=memories, entity_id=entities), limit)


def by_hash(rows: DataFrame, hashes: DataFrame, column: str = "content_hash") -> DataFrame:
    """Rows whose hash is among ``hashes``."""
    return rows.join(hashes.select(column), column, "left_semi")


def memory(rows: DataFrame, id_: int) -> DataFrame:
    return rows.where(F.col("id") == id_)


def alerts(rows: DataFrame, alert_type: str | None = None, severity: str | None = None, agent: str | None = None, acknowledged: bool | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    out = _where(rows, alert_type=alert_type, severity=severity, agent_id=agent, acknowledged=acknowledged)
    return _newest(out.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")) if since else out, limit)


def acknowledged_all(rows: DataFrame) -> DataFrame:
    """Alerts after all are acknowledged."""
    return rows.withColumn("acknowledged", F.lit(True))


def ledger(rows: DataFrame, since: str, project: str | None = None, limit: int | None = None) -> DataFrame:
    return _newest(_where(rows.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")), project=project), limit)


def directives(rows: DataFrame, scope: str | None = None, status: str | None = None) -> DataFrame:
    return _where(rows, scope=scope, status=status)


def with_status(rows: DataFrame, status: str | None = None) -> DataFrame:
    """Proposals, or watches, of one status; all without one."""
    return _where(rows, status=status)


def edges(rows: DataFrame, edge_type: str | None = None, fact: int | None = None, limit: int | None = None) -> DataFrame:
    """Edges by type and by either end."""
    out = _where(rows, edge_type=edge_type)
    if fact is not None:
        out = out.where((F.col("source_fact_id") == fact) | (F.col("target_fact_id") == fact))
    return _newest(out, limit, F.desc("source_fact_id"), F.desc("target_fact_id"))


def cooccurrences(rows: DataFrame, fact: int | None = None, limit: int | None = None) -> DataFrame:
    """The most frequent pairs, or those with one fact."""
    out = rows if fact is None else rows.where((F.col("fact_id_a") == fact) | (F.col("fact_id_b") == fact))
    return _newest(out, limit, F.desc("count"), "fact_id_a", "fact_id_b")


def aliases(rows: DataFrame, entity: int) -> DataFrame:
    return rows.where(F.col("entity_id") == entity)


def watch_digest(watches: DataFrame, found: DataFrame, since: str) -> DataFrame:
    """``watch_id, query, matches, last``: for each active watch (``id, query, active``) its unacknowledged alerts of matches since an instant."""
    recent = found.where((F.col("alert_type") == "match") & ~F.col("acknowledged") & (F.col("created_at") > F.lit(since).cast("timestamp_ntz")))
    counted = recent.groupBy("watch_id").agg(F.count("*").alias("matches"), F.max("created_at").alias("last"))
    return watches.where("active").select(F.col("id").alias("watch_id"), "query").join(counted, "watch_id")


def decayed_edges(rows: DataFrame, before: str) -> DataFrame:
    """Edges without the inferred ones that were made before an instant."""
    return rows.where((F.col("source") != "inferred") | (F.col("created_at") >= F.lit(before).cast("timestamp_ntz")))


def conflicts_of(rows: DataFrame, fact: DataFrame, limit: int = 20) -> DataFrame:
    """``id, cross_agent``: the first ``limit`` valid facts on one fact's subject and predicate, regardless of case, without those that say the same object."""
    one = fact.select(F.col("id").alias("_id"), F.lower("subject").alias("_s"), F.lower("predicate").alias("_p"), F.lower("object").alias("_o"), F.col("agent_id").alias("_a"))
    met = active(rows).where("confidence > 0").join(F.broadcast(one), (F.lower("subject") == F.col("_s")) & (F.lower("predicate") == F.col("_p")) & (F.col("id") != F.col("_id")))
    return met.orderBy("id").limit(limit).where(F.lower("object") != F.col("_o")).select("id", (F.col("agent_id") != F.col("_a")).alias("cross_agent"))


def subjects(rows: DataFrame) -> DataFrame:
    """``n``: how many subjects valid facts have, regardless of case."""
    return active(rows).where(F.trim("subject") != "").agg(F.countDistinct(F.lower(F.trim("subject"))).alias("n"))


def growth_alerts(storage_bytes: int, facts_day: int, memories_day: int) -> list[str]:
    """Names of the thresholds that a store's size and its growth of a day pass."""
    size = "db_size_high" if storage_bytes >= 1.5 * 2**30 else "db_size_notice" if storage_bytes >= 2**30 else None
    return [x for x in (size, "fact_growth_spike" if facts_day >= 200_000 else None, "memory_growth_spike" if memories_day >= 500 else None) if x]
