"""Lifecycle policies: promotion, retirement, conflict resolution, weighted reinforcement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.operators.admission import active
from engrava.operators.statistics import aged, instant

#: How far an access of a kind moves the last reinforcement towards itself.
REINFORCE = {"reinforce": 1.0, "import": 0.8, "reference": 0.5, "search": 0.3}


def promotable(rows: DataFrame, log: DataFrame, least_accesses: int = 3, least_confidence: float = 0.5) -> DataFrame:
    """``id, accesses``: active facts used often enough and confident enough to become core."""
    used = log.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("accesses"))
    return active(rows).where((F.col("state") == "active") & (F.col("confidence") >= least_confidence)).join(used, "id").where(F.col("accesses") >= least_accesses).select("id", "accesses")


def retirable(rows: DataFrame, log: DataFrame, as_of: str, below: float = 0.2, quiet_days: int = 90) -> DataFrame:
    """Active facts that have decayed below the threshold and weren't used lately; never used counts from creation."""
    last = log.groupBy(F.col("fact_id").alias("id")).agg(F.max("created_at").alias("last"))
    live = aged(active(rows), as_of).where((F.col("state") == "active") & (F.col("effective") < below)).join(last, "id", "left")
    quiet = F.timestamp_diff("SECOND", F.coalesce("last", "created_at"), instant(as_of)) >= 86400 * quiet_days
    return live.where(quiet).select("id", F.round("effective", 6).alias("effective"))


def resolve(pairs: DataFrame, rows: DataFrame, strategy: str, as_of: str) -> DataFrame:
    """``id1, id2, winner`` of conflicting pairs. ``last-write``: the newer, of equals the second. ``highest-confidence``: the more confident after decay, of
    equals the first. ``manual``: none."""
    keep = aged(rows, as_of).select("id", "created_at", "effective")
    a, b = keep.toDF("id1", "at1", "e1"), keep.toDF("id2", "at2", "e2")
    both = pairs.join(a, "id1").join(b, "id2")
    winner: dict[str, Column] = {"last-write": F.when(F.col("at1") > F.col("at2"), F.col("id1")).otherwise(F.col("id2")), "highest-confidence": F.when(F.col("e1") >= F.col("e2"), F.col("id1")).otherwise(F.col("id2")), "manual": F.lit(None).cast("long")}
    return both.select("id1", "id2", winner[strategy].alias("winner"))


def supersede_conflicts(pairs: DataFrame, rows: DataFrame, least_gap: float = 0.02) -> DataFrame:
    """``loser, winner``: in pairs where one fact is more confident by the gap and newer, the other loses, once, to its most confident winner."""
    keep = rows.select("id", "created_at", "confidence")
    a, b = keep.toDF("id1", "at1", "c1"), keep.toDF("id2", "at2", "c2")
    both = pairs.join(a, "id1").join(b, "id2")
    one = both.where((F.col("c1") - F.col("c2") >= least_gap) & (F.col("at1") > F.col("at2"))).selectExpr("id2 AS loser", "id1 AS winner", "c1 AS c")
    two = both.where((F.col("c2") - F.col("c1") >= least_gap) & (F.col("at2") > F.col("at1"))).selectExpr("id1 AS loser", "id2 AS winner", "c2 AS c")
    return one.union(two).groupBy("loser").agg(F.max_by("winner", F.struct("c", "winner")).alias("winner"))


def last_reinforced(rows: DataFrame, log: DataFrame, span_seconds: int = 3600) -> DataFrame:
    """``id, at`` in epoch seconds: the fold of a fact's accesses in order of time, each moving the instant by its weight.

    A run of accesses multiplies the instant's distance from the fact's creation by the product of (1 - w) and adds a sum; two such pairs make one. So each
    span of time of a fact is folded by itself, and then its spans: the accesses of a hot fact lie in as many tasks as it has spans.
    """
    weight = F.lit(0.0)
    for kind, w in REINFORCE.items():
        weight = F.when(F.col("access_type") == kind, w).otherwise(weight)
    made = rows.select(F.col("id").alias("fact_id"), (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("made"))
    steps = log.select("fact_id", F.col("id").alias("k"), (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("t"), weight.alias("w")).join(made, "fact_id")
    steps = steps.select("fact_id", "made", F.floor(F.col("t") / span_seconds).alias("span"), "t", "k", (1 - F.col("w")).alias("p"), (F.col("w") * (F.col("t") - F.col("made"))).alias("s"))
    spans = _folded(steps, ["fact_id", "made", "span"], ["t", "k"])
    whole = _folded(spans, ["fact_id", "made"], ["span"])
    return whole.select(F.col("fact_id").alias("id"), F.round(F.col("made") + F.col("s"), 1).alias("at"))


def _folded(steps: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``p, s`` of each key: the product of its steps' ``p``, and each step's ``s`` times the product of all later ones."""
    after = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    log_p = F.when(F.col("p") > 0, F.log("p")).otherwise(F.lit(-1e3))  # a factor of 0 leaves nothing
    later = F.exp(F.greatest(F.coalesce(F.sum(log_p).over(after), F.lit(0.0)), F.lit(-1e3)))
    return steps.withColumn("_s", F.col("s") * later).groupBy(*key).agg(F.exp(F.greatest(F.sum(log_p), F.lit(-1e3))).alias("p"), F.sum("_s").alias("s"))
