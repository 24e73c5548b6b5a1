"""Filters and multipliers on ranked results, snippets, overlap and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions import text as T
from engrava.plans.storage import join_small, materialize

#: Parts of a predicate that put it in a group, in order.
PREDICATE_GROUPS = [
    ("uses strategy", "has_strategy"), ("strategy", "has_strategy"), ("runbook", "has_strategy"), ("configured with", "has_config"), ("configures", "has_config"),
    ("config", "has_config"), ("setting", "has_config"), ("runs on", "has_tool"), ("run on", "has_tool"), ("uses", "has_tool"), ("tool", "has_tool"), ("sdk", "has_tool"), ("api", "has_tool"),
    ("located at", "has_location"), ("located in", "has_location"), ("location", "has_location"), ("depends on", "depends_on"), ("requires", "depends_on"), ("blocks", "depends_on"),
    ("blocked by", "depends_on"), ("works with", "related_to"), ("related to", "related_to"), ("connected to", "related_to"), ("associated with", "related_to"),
]


def matches_prefix(path: Column, prefix: str) -> Column:
    """Case-insensitive: the prefix itself, or followed by ``:`` or ``/``."""
    p, q = F.lower(path), prefix.lower()
    return (p == q) | p.startswith(f"{q}:") | p.startswith(f"{q}/")


def lexical_overlap(results: DataFrame, query: str) -> DataFrame:
    """Results that share a token with the query; all of them if none does."""
    terms = F.array(*[F.lit(t) for t in sorted(set(query.lower().split()))])
    marked = results.withColumn("_hit", F.arrays_overlap(T.tokens(F.col("content")), terms))
    some = marked.agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_some"))
    return marked.crossJoin(F.broadcast(some)).where("_hit OR NOT _some").drop("_hit", "_some")


def merge_injected(base: DataFrame, injected: DataFrame) -> DataFrame:
    """``id, score``: the union by id, scores of both added."""
    return base.select("id", "score").union(injected.select("id", "score")).groupBy("id").agg(F.round(F.sum("score"), 9).alias("score"))


def snippet(content: Column, term: str, before: int = 20, length: int = 60) -> Column:
    """The part of a text around the first place of a term, regardless of case; the beginning if it isn't there."""
    at = F.instr(F.lower(content), F.lit(term.lower()))
    return F.when(at > 0, F.substring(content, F.greatest(F.lit(1), at - before), F.lit(length))).otherwise(F.substring(content, 1, length))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` tokens; the tokens themselves in shorter texts."""
    words = T.tokens(text, 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda k: F.array_join(F.slice(words, k, n), " "))
    return F.array_distinct(F.when(F.size(words) >= n, runs).otherwise(words))


def overlap_with_previous(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, overlap``: shared shingles of a turn and the one before, over the fewer."""
    s = turns.select("conv_id", "turn", shingles(F.col("text")).alias("s"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = s.withColumn("p", F.lag("s").over(w)).where("p IS NOT NULL")
    least = F.least(F.size("s"), F.size("p"))
    return both.select("conv_id", "turn", F.round(F.when(least > 0, F.size(F.array_intersect("s", "p")) / least).otherwise(F.lit(0.0)), 9).alias("overlap"))


def cosine_with_previous(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, cosine``: term-frequency cosine of a turn and the one before; turns without a shared term are left out."""
    tf = turns.select("conv_id", "turn", F.explode(T.tokens(F.col("text"))).alias("t")).groupBy("conv_id", "turn", "t").agg(F.count("*").alias("n"))
    norm = tf.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    before = tf.select("conv_id", (F.col("turn") + 1).alias("turn"), "t", F.col("n").alias("m"))
    dot = tf.join(before, ["conv_id", "turn", "t"]).groupBy("conv_id", "turn").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    last = norm.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("norm").alias("before"))
    return dot.join(norm, ["conv_id", "turn"]).join(last, ["conv_id", "turn"]).select("conv_id", "turn", F.round(F.col("dot") / (F.col("norm") * F.col("before")), 9).alias("cosine"))


def fact_text_score(query: str, subject: Column, predicate: Column, obj: Column) -> Column:
    """Share of the query's tokens that a fact holds, and 0.35, 0.15 and 0.10 where the query holds its subject, object or predicate."""
    q = query.lower()
    terms = F.array(*[F.lit(t) for t in sorted(set(q.split()))])
    held = F.array_distinct(T.tokens(F.concat_ws(" ", subject, predicate, obj), 1))
    inside = lambda c, bonus: F.when(F.contains(F.lit(q), F.lower(c)), bonus).otherwise(0.0)
    return F.size(F.array_intersect(held, terms)) / F.size(terms) + inside(subject, 0.35) + inside(obj, 0.15) + inside(predicate, 0.10)


def predicate_group(predicate: Column) -> Column:
    out = F.lit("other")
    for part, group in reversed(PREDICATE_GROUPS):
        out = F.when(F.contains(F.lower(predicate), F.lit(part)), group).otherwise(out)
    return out


def enriched(content: Column, path: Column, section: Column) -> Column:
    """``[stem > section]`` before the content."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.concat(F.lit("["), F.when(section != "", F.concat_ws(" > ", stem, section)).otherwise(stem), F.lit("] "), content)


def infer_project(content: Column, rules: list[tuple[str, list[str]]], least: int = 2) -> Column:
    """The project most of whose keywords a text holds, at least two; of equals the first rule's; else empty."""
    hits = [sum((F.contains(F.lower(content), F.lit(k)).cast("int") for k in keys), F.lit(0)) for _, keys in rules]
    best = F.greatest(*hits)
    out = F.lit("")
    for (name, _), n in reversed(list(zip(rules, hits))):
        out = F.when((n == best) & (best >= least), name).otherwise(out)
    return out


def project_of_path(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The project of the first rule whose pattern a path holds, regardless of case and of which way its slashes lean; else empty."""
    low, out = F.translate(F.lower(path), "\\", "/"), F.lit("")
    for pattern, project in reversed(rules):
        out = F.when(F.contains(low, F.lit(pattern.lower())), project).otherwise(out)
    return out


def best_per_triple(rows: DataFrame) -> DataFrame:
    """``id`` of the most confident fact of each lower-cased triple; of equals the first."""
    s, p, o = (F.lower(F.trim(F.col(c))) for c in ("subject", "predicate", "object"))
    return rows.groupBy(s.alias("s"), p.alias("p"), o.alias("o")).agg(F.min_by("id", F.struct(-F.col("confidence"), F.col("id"))).alias("id")).select("id")


def resolve_entities(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``name, entity_id, how``: a name by its exact form, regardless of case, or by alias; ``create`` if none."""
    exact = entities.select(F.col("canonical_name").alias("name"), F.col("id").alias("e1"))
    loose = entities.groupBy(F.lower("canonical_name").alias("low")).agg(F.min("id").alias("e2"))
    alias = aliases.groupBy(F.lower("alias").alias("low")).agg(F.min("entity_id").alias("e3"))
    rows = names.select(F.trim("name").alias("name")).distinct().withColumn("low", F.lower("name"))
    found = rows.join(exact, "name", "left").join(loose, "low", "left").join(alias, "low", "left")
    how = F.when(F.col("e1").isNotNull(), "exact").when(F.col("e2").isNotNull(), "case").when(F.col("e3").isNotNull(), "alias").otherwise("create")
    return found.select("name", F.coalesce("e1", "e2", "e3").alias("entity_id"), how.alias("how"))


def hubs(rows: DataFrame, least_refs: int = 8) -> DataFrame:
    """Subjects referred to often enough for a page of their own: ``subject, refs, topics``."""
    return rows.groupBy("subject").agg(F.count("*").alias("refs"), F.countDistinct("project_id").alias("topics")).where(F.col("refs") >= least_refs)


def markdown_export(rows: DataFrame) -> DataFrame:
    """``source_file, id, part``: each memory's whole content as its part of its source's page; a source's parts in order of id are the page, and the first has the heading.

    Sources are never gathered: only their first ids are, and these are joined back.
    """
    named = rows.select(F.when(F.coalesce("source_file", F.lit("")) == "", "Unknown Source").otherwise(F.col("source_file")).alias("source_file"), "id", "content")
    first = materialize(named.groupBy("source_file").agg(F.min("id").alias("first")), "first-of-source")
    heading = F.when(F.col("id") == F.col("first"), F.concat(F.lit("## Source: "), "source_file", F.lit("\n\n"))).otherwise("")
    return join_small(named, first, "source_file").select("source_file", "id", F.concat(heading, F.coalesce("content", F.lit("")), F.lit("\n\n")).alias("part"))
