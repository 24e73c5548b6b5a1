"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engrava.plans.storage import join_small, materialize, scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for each node with an edge; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is two aggregations to the minimum (combined before
    the shuffle) and two joins on the node. What a join brings to a node is written first: few rows are broadcast, and beyond that both sides of the merge
    join have a shuffle of their own, so AQE splits hub nodes. The number of rounds grows with the logarithm of the longest path. Each round is written to the shared folder, so the lineage stays short. Self-loops and nulls are dropped, repeated
    and reversed edges count once; an empty edge table gives no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).where("a <> b").distinct()
    spark = e.sparkSession
    with scratch(spark):
        e = materialize(e, "cc")
        state, old = _digest(e), None
        while state[0] and state != old:
            with scratch(spark):
                e = materialize(_small_star(_large_star(e)), "cc", keep=True)
            old, state = state, _digest(e)
        e = materialize(e, "components", keep=True)
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-least")
    out = join_small(both.where("b > a"), least, "a", "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = materialize(e.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
    joined = join_small(e, least, "a", "inner")
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def traverse(edges: DataFrame, start: DataFrame, max_depth: int = 2, least_confidence: float = 0.0) -> DataFrame:
    """``node, depth``: breadth-first over undirected ``source_fact_id, target_fact_id, confidence``, from the ``node``s of ``start``.

    Each level joins only the frontier with the edges and drops what was seen; levels are written, so the plan doesn't grow.
    """
    both = undirected(edges.where(F.col("confidence") >= least_confidence))
    seen = materialize(start.select("node", F.lit(0).alias("depth")).distinct(), "bfs")
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(both, frontier.node == both.a).select(F.col("b").alias("node")).distinct()
        frontier = materialize(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        seen = seen.union(frontier)
    return seen


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions, ``a, b``."""
    one = edges.select(F.col("source_fact_id").alias("a"), F.col("target_fact_id").alias("b"))
    return one.union(one.select(F.col("b").alias("a"), F.col("a").alias("b")))


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("a").alias("node")).agg(F.countDistinct("b").alias("degree"))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``node``."""
    kept = edges.join(nodes.select(F.col("node").alias("source_fact_id")), "source_fact_id", "left_semi")
    return kept.join(nodes.select(F.col("node").alias("target_fact_id")), "target_fact_id", "left_semi")


def impact(edges: DataFrame, facts: DataFrame, start: DataFrame, depth: int = 2, least_confidence: float = 0.0) -> DataFrame:
    """``node, depth, degree, relevance`` of what is reached: 0.78 of the confidence, 0.28 of the share of the largest degree, 0.06 less a step."""
    found = materialize(traverse(edges, start, depth, least_confidence), "impact-reached")
    near = undirected(edges).join(found.select(F.col("node").alias("a")), "a", "left_semi")  # degrees of what was reached only
    counted = near.groupBy(F.col("a").alias("node")).agg(F.countDistinct("b").alias("degree"))
    reached = materialize(found.join(counted, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), "impact")
    top = reached.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top"))
    scored = reached.join(facts.select(F.col("id").alias("node"), "confidence"), "node").crossJoin(F.broadcast(top))
    relevance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.78 * F.col("confidence") + 0.28 * F.col("degree") / F.col("top") - 0.06 * F.col("depth")))
    return scored.select("node", "depth", "degree", F.round(relevance, 6).alias("relevance"))


def chain_edges(facts: DataFrame) -> DataFrame:
    """Each subject's facts linked in order of id, and closed to a ring from three on."""
    by = Window.partitionBy("subject").orderBy("id")
    every = Window.partitionBy("subject")
    rows = facts.select("subject", "id", F.lead("id").over(by).alias("next"), F.min("id").over(every).alias("first"), F.count("*").over(every).alias("n"))
    target = F.coalesce("next", F.when(F.col("n") >= 3, F.col("first")))
    return rows.select(F.col("id").alias("source_fact_id"), target.alias("target_fact_id")).where("target_fact_id IS NOT NULL")
