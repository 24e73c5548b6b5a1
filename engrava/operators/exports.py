"""Exports: entity pages, and tables as files of sorted parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of exported facts, in order.
FACT_COLUMNS = ["id", "memory_id", "subject", "predicate", "object", "fact_type", "confidence", "created_at"]


def topic(text: Column, topics: dict[str, list[str]], other: str = "general") -> Column:
    """The first topic one of whose words a text holds, regardless of case."""
    low, out = F.lower(text), F.lit(other)
    for name, words in reversed(topics.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w.lower()))
        out = F.when(hit, name).otherwise(out)
    return out


def entity_index(rows: DataFrame, topics: dict[str, list[str]], blocked: list[str] | None = None, allowed: list[str] | None = None, longest: int = 60) -> DataFrame:
    """``subject, refs, topics``: subjects that can name a page, how many facts each has, and their topics in order, comma-separated.

    Names of under two or over ``longest`` bytes, or that begin like a number or a path, can't; nor blocked ones (regardless of case), unless allowed.
    """
    name = F.trim("subject")
    ok = (F.octet_length(name) >= 2) & (F.octet_length(name) <= longest) & ~name.rlike(r"^[\d./$~\\]")
    low = F.lower(name)
    free = ~low.isin([b.lower() for b in blocked or []]) | low.isin([a.lower() for a in allowed or []])
    named = rows.where(ok & free).select(name.alias("subject"), topic(F.concat_ws(" ", "subject", "predicate", "object"), topics).alias("topic"))
    return named.groupBy("subject").agg(F.count("*").alias("refs"), F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"))


def select_hubs(index: DataFrame, kind: Column, least: int, least_concept: int, allowed: list[str] | None = None) -> DataFrame:
    """Indexed subjects with references enough for a page: ``least``, ``least_concept`` for concepts, one for allowed names; with ``kind``."""
    need = F.when(F.lower("subject").isin([a.lower() for a in allowed or []]), 1).when(kind == "concept", least_concept).otherwise(least)
    return index.where(F.col("refs") >= need).withColumn("kind", kind)


def prune_weak(hubs: DataFrame, rows: DataFrame, least: int = 2, allowed: list[str] | None = None) -> DataFrame:
    """Hubs (``subject, topics, kind``) without the concepts that lead to fewer than ``least`` topics and other hubs named in their facts' objects.

    An object names a hub if it holds its name anywhere. Objects meet the names by their pairs of characters that a name begins with, so none is compared with every hub.
    """
    names = hubs.select(F.col("subject").alias("hub"), F.substring("subject", 1, 2).alias("_k"))
    facts = rows.select(F.trim("subject").alias("subject"), "object").where(F.length("object") > 1).join(hubs.where("kind = 'concept'").select("subject"), "subject", "left_semi").distinct()
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("object") - 1), lambda k: F.substr("object", k, F.lit(2))))
    pairs = F.concat(pairs, F.array_distinct(F.split("object", "")))  # names of one character
    found = facts.select("subject", "object", F.explode(pairs).alias("_k")).join(names, "_k").where((F.col("subject") != F.col("hub")) & F.contains("object", "hub"))
    met = found.groupBy("subject").agg(F.countDistinct("hub").alias("met"))
    out = hubs.join(met, "subject", "left").withColumn("_out", F.size(F.split("topics", ",")) + F.coalesce("met", F.lit(0)))
    keep = (F.col("kind") != "concept") | F.lower("subject").isin([a.lower() for a in allowed or []]) | (F.col("_out") >= least)
    return out.where(keep).drop("met", "_out")


def write_facts(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Facts in order of id as ``csv`` (with a header in each part) or ``json`` lines, in parts that follow one another."""
    sorted_ = rows.select(*FACT_COLUMNS).orderBy("id")
    (sorted_.write.option("header", True) if kind == "csv" else sorted_.write).format(kind).save(path)


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, json``: a graph's nodes and edges as one JSON object each, to be written as lines."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return one(nodes, "node").unionByName(one(edges, "edge"))
