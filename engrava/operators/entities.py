"""Entities: normal forms of names, types, pronouns, resolution of facts, merging and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
PRONOUNS = ["he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs", "we", "us", "our", "ours", "i", "me", "my", "mine", "you", "your", "yours", "it", "its"]
ORGANISATION = r"(?i)\b(inc|corp|llc|ltd|company|group|foundation|bank|agency|institute|university)\b"
PLACE = r"(?i)\b(city|state|county|island|river|mountain|lake|park|street|avenue|road|district)\b"
PERSON = r"^[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}$"
_EDGE = r"[\"'`.,;:!?()\[\]{}<>]+"


def normal_name(raw: Column) -> Column:
    """Without quotes and punctuation at its ends, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), f"^{_EDGE}|{_EDGE}$", ""), r"\s+", " "))


def is_pronoun(name: Column) -> Column:
    return F.lower(normal_name(name)).isin(PRONOUNS)


def names_something(name: Column) -> Column:
    """Whether a name may become an entity: no pronoun, no number, no single small letter."""
    n = normal_name(name)
    return (n != "") & ~is_pronoun(n) & ~n.rlike(r"^\d+$") & ((F.length(n) > 1) | n.rlike(r"^\p{Lu}$"))


def entity_type(name: Column, fact_type: Column) -> Column:
    """``place``, ``person``, ``org`` or ``concept``, by the fact and then by the name."""
    person = name.rlike(PERSON)
    return F.when(F.lower(F.trim(fact_type)) == "location", "place").when((F.lower(F.trim(fact_type)) == "identity") & person, "person").when(name.rlike(ORGANISATION), "org").when(name.rlike(PLACE), "place").when(person, "person").otherwise("concept")


def resolve_pronouns(rows: DataFrame) -> DataFrame:
    """``id, entity_id`` of facts (``id, memory_id, subject, entity_id``) whose subject is a pronoun: the entity named last before, by id, in the same memory; null if none."""
    before = Window.partitionBy("memory_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(~is_pronoun(F.col("subject")) & (F.col("entity_id") > 0), F.col("entity_id"))
    return rows.select("id", is_pronoun(F.col("subject")).alias("_p"), F.last(named, ignorenulls=True).over(before).alias("entity_id")).where("_p").drop("_p")


def backfill(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """``id, entity_id, reason`` of facts without an entity (0): the one with their subject's name, regardless of case, or else why there is none.

    ``entities`` has ``entity_id, name``; of several with one name the first by id.
    """
    known = entities.groupBy(F.lower(normal_name(F.col("name"))).alias("k")).agg(F.min("entity_id").alias("found"))
    todo = rows.where("entity_id = 0").select("id", normal_name(F.col("subject")).alias("n")).withColumn("k", F.lower("n"))
    reason = F.when(F.col("found").isNotNull(), "").when(F.col("n") == "", "empty_name").when(F.col("k").isin(PRONOUNS), "pronoun_without_context").when(F.col("n").rlike(r"^\d+$"), "numeric_identifier").otherwise("unresolved")
    return todo.join(known, "k", "left").select("id", F.coalesce("found", F.lit(0)).cast("long").alias("entity_id"), reason.alias("reason"))


def merge(rows: DataFrame, aliases: DataFrame, names: DataFrame, keep: int, gone: int) -> dict[str, DataFrame]:
    """Facts and aliases (``entity_id, alias``) after ``gone`` becomes part of ``keep``: its name is an alias of the kept one, each alias once regardless of case."""
    moved = lambda df: df.withColumn("entity_id", F.when(F.col("entity_id") == gone, F.lit(keep)).otherwise(F.col("entity_id")))
    every = aliases.select("entity_id", "alias").unionByName(names.where(F.col("entity_id") == gone).select("entity_id", F.col("name").alias("alias")))
    own = names.where(F.col("entity_id") == keep).select(F.lower("name").alias("_own"))
    once = moved(every).groupBy("entity_id", F.lower("alias").alias("_k")).agg(F.min("alias").alias("alias"))
    kept = once.join(own.withColumn("_e", F.lit(keep)), (F.col("_k") == F.col("_own")) & (F.col("entity_id") == F.col("_e")), "left_anti")
    return {"facts": moved(rows), "aliases": kept.select("entity_id", "alias")}


def profiles(rows: DataFrame, most: int = 200) -> DataFrame:
    """``entity_id, profile``: each entity's ``most`` most confident facts as lines ``- predicate: object``, of equals by id. The page's own limit bounds the list."""
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "id"))
    top = rows.where("superseded_by IS NULL").select("entity_id", "id", F.concat(F.lit("- "), "predicate", F.lit(": "), "object").alias("line"), rank.alias("rank")).where(F.col("rank") <= most)
    lines = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return top.groupBy("entity_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("profile"))
