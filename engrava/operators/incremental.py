"""Connected components kept while edges come in, without a pass over what is known.

A node has a label for ever, and a label a component: the smallest node that can be reached. New edges are drawn between components, of which only those that they touch are looked
at; where these grow together their labels get the new component. Nodes are never written again, labels only as their component changes. ``components`` equals
``graph.connected_components`` of all edges so far.

The clusters of subjects are kept in the same way, or made anew where too many subjects are new (``update_clusters``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.operators import clusters
from engrava.operators.graph import connected_components
from engrava.plans import versions
from engrava.plans.storage import join_small, materialize, scratch
from engrava.plans.versions import Version

#: Fixed value: new subjects, as a share of known ones, above which clusters are made anew.
DRIFT = 0.10


def create(spark: SparkSession, path: str) -> Version:
    return versions.create(spark, path, {"kind": "components"})


def _state(spark: SparkSession, version: Version) -> tuple[DataFrame, DataFrame]:
    """``node, label`` and ``id, component``: labels by their name."""
    nodes, labels = versions.live(spark, version, "nodes"), versions.live(spark, version, "labels")
    if nodes is None:
        nodes, labels = spark.createDataFrame([], "id long, node long, label long"), spark.createDataFrame([], "id long, component long")
    return nodes.select("node", "label"), labels


def components(spark: SparkSession, version: Version) -> DataFrame:
    """``node, component`` for each node with an edge so far."""
    nodes, labels = _state(spark, version)
    return nodes.join(labels.select(F.col("id").alias("label"), "component"), "label").select("node", "component")


def insert_edges(old: Version, edges: DataFrame, src: str = "src", dst: str = "dst") -> Version:
    """The components after ``edges``: self-loops and nulls are dropped; repeated, reversed and known edges change nothing, as does a batch that is run again."""
    spark = edges.sparkSession
    with scratch(spark):
        nodes, labels = _state(spark, old)
        e = materialize(edges.select(F.greatest(src, dst).cast("long").alias("a"), F.least(src, dst).cast("long").alias("b")).where("a <> b").distinct(), "new-edges")
        ends = materialize(e.select(F.col("a").alias("node")).union(e.select("b")).distinct(), "new-ends")
        met = join_small(nodes, ends, "node", "inner")
        here = ends.join(met, "node", "left").join(labels.select(F.col("id").alias("label"), F.col("component").alias("was")), "label", "left")
        here = materialize(here.select("node", F.col("label").isNull().alias("new"), F.coalesce("was", "node").alias("at")), "ends")
        a, b = here.select(F.col("node").alias("a"), F.col("at").alias("x")), here.select(F.col("node").alias("b"), F.col("at").alias("y"))
        drawn = connected_components(e.join(a, "a").join(b, "b").select("x", "y"), "x", "y").select(F.col("node").alias("at"), "component")
        moved = materialize(here.select("at").distinct().join(drawn, "at", "left").select("at", F.coalesce("component", "at").alias("component")), "moved")
        changed = join_small(labels, moved.where("at <> component").select(F.col("at").alias("component"), F.col("component").alias("to")), "component", "inner").select("id", F.col("to").alias("component"))
        changed = materialize(changed, "changed-labels")
        fresh = materialize(here.where("new").join(moved, "at").select(F.lit(None).cast("long").alias("id"), "node", F.col("component").alias("label")), "new-nodes")
        names = fresh.select(F.col("label").alias("id")).distinct().join(join_small(labels, fresh.select(F.col("label").alias("id")).distinct(), "id", "left_semi").select("id"), "id", "left_anti")
        added = names.join(changed.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
        return versions.add(spark, old, {"nodes": fresh, "labels": changed.unionByName(added), "dead": changed.select("id")})


def compact(spark: SparkSession, old: Version) -> Version:
    """One segment, in which a node's label is its component."""
    now = materialize(components(spark, old), "components")
    nodes = now.select(F.lit(None).cast("long").alias("id"), "node", F.col("component").alias("label"))
    return versions.add(spark, old, {"nodes": nodes, "labels": now.select(F.col("component").alias("id"), "component").distinct()}, alone=True)


def needs_rebuild(facts: DataFrame, new: DataFrame, members: DataFrame) -> bool:
    """Whether clusters of subjects (``subject, cluster``) should be made anew when facts ``new`` (``id``) have come: there are none, no subject is known, or over a tenth as many
    are new."""
    live = clusters.active(facts).select("id", F.lower(F.trim("subject")).alias("s")).where("s <> ''").join(new.select(F.col("id").alias("_new")).distinct(), F.col("id") == F.col("_new"), "left")
    by = live.groupBy("s").agg(F.bool_and(F.col("_new").isNotNull()).alias("fresh"))
    n = by.agg(F.count("*").alias("every"), F.count_if("fresh").alias("fresh")).first()
    known = n.every - n.fresh
    return members.isEmpty() or known <= 0 or n.fresh / known > DRIFT


def update_clusters(facts: DataFrame, new: DataFrame, members: DataFrame) -> DataFrame:
    """``subject, cluster`` after facts ``new`` (``id``) have come among ``facts``: made anew if ``needs_rebuild``, else each new subject takes the cluster of most facts of the
    memories that it is in, of equals the first by name; a subject whose memories have none stays without."""
    if needs_rebuild(facts, new, members):
        return clusters.topic_clusters(clusters.active(facts))
    key = F.lower(F.trim("subject"))
    rows = clusters.active(facts).select("id", "memory_id", key.alias("subject"))
    fresh = rows.join(new.select("id").distinct(), "id", "left_semi").where("subject <> ''").select("subject", "memory_id").distinct().join(members, "subject", "left_anti")
    votes = rows.join(members, "subject").join(fresh.select(F.col("subject").alias("of"), "memory_id"), "memory_id").groupBy("of", "cluster").agg(F.count("*").alias("n"))
    chosen = votes.groupBy(F.col("of").alias("subject")).agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("cluster"))
    return members.select("subject", "cluster").unionByName(chosen)
