"""Channels of a search beside words and vectors: times, bridges between entities, and neighbours of what was found; for many queries at once.

Each channel gives ``query_id``, what it found, a score, and how it came to it, for fusion with the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions import text as T
from engrava.operators.graph import undirected
from engrava.operators.vectors import Index
from engrava.operators.vectors import search as nearest
from engrava.plans.storage import join_small, materialize, scratch

#: Days of the calendar as numbers from 0 below 2 to this power.
LEVELS = 22
# What a fact's text, its time, its memory's day and its confidence are worth in the temporal channel, and the least score that counts.
TEXT, TIMED, MET, DATED, DATE_MET, SURE, LEAST = 0.35, 0.35, 1.10, 0.10, 0.75, 0.15, 0.55
# Facts of two entities in one memory, with one object, one object that names its entity, one predicate; and the channel's share of the best score.
TOGETHER, SAME_OBJECT, NAMED, SAME_PREDICATE, BRIDGE = 0.95, 0.88, 0.85, 0.72, 0.9


def _day(at: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << LEVELS) - 2), F.datediff(at.cast("date"), F.lit("0001-01-01").cast("date"))))


def _pieces(lo: str, hi: str) -> Column:
    """The fewest aligned ranges of 1, 2, 4, ... days that make up the days from ``lo`` to before ``hi``: two of each size at most."""
    return F.expr(
        f"""flatten(transform(sequence(0, least({LEVELS}, length(bin(greatest({hi} - {lo}, 1))) - 1)), l -> filter(array(
        if(shiftright({lo} + shiftleft(1, l) - 1, l) < shiftright({hi}, l) AND shiftright({lo} + shiftleft(1, l) - 1, l) % 2 = 1, struct(l AS level, shiftright({lo} + shiftleft(1, l) - 1, l) AS at), null),
        if(shiftright({lo} + shiftleft(1, l) - 1, l) < shiftright({hi}, l) AND shiftright({hi}, l) % 2 = 1, struct(l AS level, shiftright({hi}, l) - 1 AS at), null)), x -> x IS NOT NULL)))"""
    )


def _stabbed(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``p, s`` of points (``p, day``) in spans (``s, lo, hi``, the end left out): a point lies in one piece of a span at most, so each pair is met once."""
    around = points.select("p", F.explode(F.expr(f"transform(sequence(0, {LEVELS}), l -> struct(l AS level, shiftright(day, l) AS at))")).alias("n")).select("p", "n.level", "n.at")
    pieces = spans.where("lo < hi").select("s", F.explode(_pieces("lo", "hi")).alias("n")).select("s", "n.level", "n.at")
    kept = join_small(around, pieces.select("level", "at").distinct(), ["level", "at"], "left_semi")
    return kept.join(pieces, ["level", "at"]).select("p", "s")


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_id, right_id`` of date ranges (``id, start, end``, both ends in) that share a day. A missing end is the start; ranges without a start, or that end before they start,
    meet none.

    One of two ranges that overlap begins within the other. A range is cut into aligned pieces of days, decades and days alike into few, and a beginning looks for the pieces that
    hold it, one of each size; so nothing meets but what overlaps.
    """
    span = lambda df: df.where("start IS NOT NULL").select("id", _day(F.col("start")).alias("lo"), (_day(F.coalesce("end", "start")) + 1).alias("hi")).where("lo < hi")
    a, b = (materialize(span(x), "spans") for x in (left, right))
    first = _stabbed(b.select(F.col("id").alias("p"), F.col("lo").alias("day")), a.select(F.col("id").alias("s"), "lo", "hi"))
    later = _stabbed(a.select(F.col("id").alias("p"), F.col("lo").alias("day")), b.select(F.col("id").alias("s"), (F.col("lo") + 1).alias("lo"), "hi"))
    return first.select(F.col("s").alias("left_id"), F.col("p").alias("right_id")).unionByName(later.select(F.col("p").alias("left_id"), F.col("s").alias("right_id")))


def _likeness(q: Column, asked: Column, held: Column, text: Column, subject: Column, predicate: Column) -> Column:
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, held)) / F.size(asked)).otherwise(F.lit(0.0))
    inside = lambda c, bonus: F.when((q != "") & F.contains(c, q), bonus).otherwise(0.0)
    return share + inside(text, 0.35) + inside(subject, 0.15) + inside(predicate, 0.10)


def text_score(query: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """The share of a query's tokens that a fact holds, and 0.35, 0.15 and 0.10 if its text, subject or predicate holds the query."""
    q, text = F.lower(F.trim(query)), F.lower(F.concat_ws(" ", subject, predicate, obj))
    return _likeness(q, F.array_distinct(T.tokens(q, 1)), T.tokens(text, 1), text, F.lower(subject), F.lower(predicate))


#: One of so many shares of the memories is scored first; its ``k`` best bound what others must reach.
SHARES = 64


def _best_memories(scored: DataFrame, k: int) -> DataFrame:
    """``query_id, memory_id, score, rank`` of ``query_id, memory_id, score``: the ``k`` best memories by their best score, equal ones by id.

    A share of the memories, by a hash, is scored first; whatever comes after its ``k``-th best can't be among the ``k`` best of all, so it isn't shuffled.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    best = lambda df: df.groupBy("query_id", "memory_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
    first = materialize(best(scored.where(F.pmod(F.xxhash64("memory_id"), F.lit(SHARES)) == 0)), "temporal-first")
    least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("_least"), F.col("memory_id").alias("_last"))
    reach = F.col("_least").isNull() | (F.col("score") > F.col("_least")) | ((F.col("score") == F.col("_least")) & (F.col("memory_id") <= F.col("_last")))
    return best(join_small(scored, least, "query_id").where(reach).select("query_id", "memory_id", "score"))


def temporal_channel(facts: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, memory_id, score, fact_id, rank``: for each query (``query_id, query, start, end``) with a time in mind the ``k`` best memories by their best fact (``id, memory_id,
    subject, predicate, object, confidence, start, end, anchor``).

    A fact's score adds its text's likeness, that it names a time, that this meets the query's, that its memory has a day, that this meets the query's, and its confidence; where the
    query's time is known, scores under 0.55 don't count. Facts are compared with the queries that they share a time, a day or a word with, or whose words they hold within theirs; what the
    others score doesn't depend on the query, so of these only the ``k`` best of all are.

    A fact meets queries by keys, where it lies: its words, the pieces of days as in ``overlapping``, and one key for all queries that text may hold without sharing a word. A pair that meets by
    several keys is scored as often, to the same score. Only the best memories' facts are looked at again, for which of them it was.
    """
    with scratch(facts.sparkSession):
        dealt = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fact is small for the work that it makes: as many tasks as there may be
        facts = materialize(facts.select("id", "memory_id", "subject", "predicate", "object", "confidence", "start", "end", "anchor").repartition(dealt, "id"), "temporal-facts")
        q, start, end = F.lower(F.trim("query")), F.col("start").cast("date"), F.coalesce("end", "start").cast("date")
        known = queries.select("query_id", F.coalesce(q, F.lit("")).alias("q"), start.isNotNull().alias("resolved"), F.when(start <= end, start).alias("from"), F.when(start <= end, end).alias("to"))
        asked = F.array_distinct(T.tokens(F.col("q"), 1))
        # Words between two others of a query, or beside its other signs, are whole words wherever a text holds the query.
        loose = (F.col("q") != "") & ~F.col("q").rlike("[^a-z0-9][a-z0-9]+[^a-z0-9]|^[^a-z0-9]+[a-z0-9]+[^a-z0-9]|[^a-z0-9][a-z0-9]+[^a-z0-9]+$")
        known = materialize(known.withColumn("asked", asked).withColumn("loose", loose), "temporal-queries")
        spans = known.where("from IS NOT NULL").select("query_id", _day(F.col("from")).alias("lo"), (_day(F.col("to")) + 1).alias("hi"))
        pieces = materialize(spans.select("query_id", F.explode(_pieces("lo", "hi")).alias("x")).select("query_id", "x.level", "x.at"), "temporal-pieces")
        levels = sorted(r.level for r in pieces.select("level").distinct().collect())  # no more than LEVELS and one
        word = lambda c: F.transform(c, lambda t: F.xxhash64(t))
        time = lambda kind, level, at: (((F.lit(kind * 32) + level).cast("long") * (1 << 32)) + at.cast("long"))
        keys = known.select("query_id", F.explode(word("asked")).alias("key"))
        keys = keys.unionByName(known.where("loose").select("query_id", F.lit(0).cast("long").alias("key")))
        keys = keys.unionByName(pieces.select("query_id", time(1, F.col("level"), F.col("at")).alias("key")))
        within = F.explode(F.expr(f"transform(sequence(0, {LEVELS}), l -> struct(l AS level, shiftright(lo, l) AS at))"))
        keys = keys.unionByName(spans.select("query_id", within.alias("x")).select("query_id", time(2, F.col("x.level"), F.col("x.at")).alias("key")))
        keys = materialize(keys.distinct().join(known, "query_id"), "temporal-keys")

        base = F.when(F.col("start").isNotNull(), TIMED).otherwise(0.0) + F.when(F.col("anchor").isNotNull(), DATED).otherwise(0.0) + SURE * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
        text = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
        told = facts.select(
            "id", "memory_id", base.alias("base"), text.alias("text"), F.lower("subject").alias("subject"), F.lower("predicate").alias("predicate"), F.when(start <= end, start).alias("f_from"), F.when(start <= end, end).alias("f_to"), F.col("anchor").cast("date").alias("anchor")
        ).withColumn("held", F.array_distinct(T.tokens(F.col("text"), 1)))
        met = F.when((F.col("f_from") <= F.col("to")) & (F.col("f_to") >= F.col("from")), MET).otherwise(0.0)
        date_met = F.when(F.col("anchor").between(F.col("from"), F.col("to")), DATE_MET).otherwise(0.0)
        likeness = _likeness(F.col("q"), F.col("asked"), F.col("held"), F.col("text"), F.col("subject"), F.col("predicate"))
        score = F.round(TEXT * likeness + F.col("base") + met + date_met, 6)
        counts = (~F.col("resolved") | (F.col("score") >= LEAST)) & (F.col("score") > 0)

        days = told.withColumn("lo", _day(F.col("f_from")) + 1).withColumn("hi", _day(F.col("f_to")) + 1).withColumn("day", _day(F.col("f_from"))).withColumn("held_day", _day(F.col("anchor")))
        points = [F.when(F.col(c).isNotNull(), time(1, F.lit(level), F.shiftright(F.col(c), level))) for c in ("day", "held_day") for level in levels]
        parts = F.when(F.col("lo") < F.col("hi"), F.transform(_pieces("lo", "hi"), lambda x: time(2, x["level"], x["at"])))
        met_by = F.concat(word("held"), F.array(F.lit(0).cast("long"), *points), F.coalesce(parts, F.array().cast("array<long>")))
        by_key = days.select(*told.columns, F.explode(met_by).alias("key")).where("key IS NOT NULL")
        pairs = join_small(by_key, keys, "key", "inner").where((F.col("key") != 0) | F.contains("text", F.col("q")))
        # Exploded, so that a score is made once: filters on it would be pushed below a plain column and make it again each time they name it.
        pairs = pairs.select("query_id", "memory_id", "resolved", F.explode(F.array(score)).alias("score")).where(counts).select("query_id", "memory_id", "score")
        plain = _best_memories(facts.select(F.lit(0).alias("query_id"), "memory_id", F.round(base, 6).alias("score")), k)
        plain = materialize(plain.select("memory_id", "score"), "temporal-plain")
        others = plain.crossJoin(F.broadcast(known.select("query_id", "resolved"))).where(counts).select("query_id", "memory_id", "score")
        both = materialize(_best_memories(pairs, k).drop("rank").unionByName(others), "temporal-both")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
        best = both.groupBy("query_id", "memory_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
        best = materialize(best.join(known, "query_id"), "temporal-best")
        again = join_small(told, best.withColumnRenamed("score", "most"), "memory_id", "inner").where(score == F.col("most"))
        out = again.groupBy("query_id", "memory_id", F.col("most").alias("score"), "rank").agg(F.min("id").alias("fact_id"))
        return materialize(out.select("query_id", "memory_id", "score", "fact_id", "rank"), "temporal-found", keep=True)


def temporal_boost(results: DataFrame, times: DataFrame, queries: DataFrame) -> DataFrame:
    """Results (``query_id, id, score``) times 1.08 if their memory names a time, 1.05 if it has a day, 1.20 if a time that it names meets the query's.

    ``times`` are ``memory_id, start, end, anchor``, a row for each time; queries without a time in mind aren't in ``queries`` (``query_id, start, end``).
    """
    has = times.groupBy("memory_id").agg(F.bool_or(F.col("start").isNotNull()).alias("named"), F.bool_or(F.col("anchor").isNotNull()).alias("dated"))
    here = results.join(queries.select("query_id"), "query_id", "left_semi").select(F.col("id").alias("memory_id")).distinct()
    mine = times.join(here, "memory_id", "left_semi").select(F.col("memory_id").alias("id"), "start", "end")
    met = overlapping(queries.select(F.col("query_id").alias("id"), "start", "end"), mine).distinct().toDF("query_id", "id").withColumn("_met", F.lit(True))
    joined = results.join(has, results.id == has.memory_id, "left").join(met, ["query_id", "id"], "left").join(queries.select("query_id", F.lit(True).alias("_asks")), "query_id", "left")
    factor = F.when(F.col("named"), 1.08).otherwise(1.0) * F.when(F.col("dated"), 1.05).otherwise(1.0) * F.when(F.col("_met"), 1.20).otherwise(1.0)
    return joined.withColumn("score", F.round(F.col("score") * F.when(F.col("_asks"), factor).otherwise(1.0), 6)).select(*results.columns)


def bridge_facts(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, id, memory_id, score``: facts (``id, memory_id, entity_id, predicate, object``) that tie two of a query's entities (``query_id, entity_id, name``) together.

    Facts of two entities score by the first that holds: one memory, one object, one predicate, an object that is its entity's name; a fact has the best of its scores with
    others. That a fact of another entity exists is told by counts over a query's memories, objects and predicates, so facts never meet in pairs.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rows = join_small(facts, asked.select("query_id", "entity_id", "name").distinct(), "entity_id", "inner")
    rows = materialize(rows.select("query_id", "id", "memory_id", "entity_id", low("predicate").alias("p"), low("object").alias("o"), (F.lower(F.coalesce("object", F.lit(""))) == F.lower("name")).alias("self")), "bridge-facts")

    def several(column: str) -> DataFrame:
        return rows.groupBy("query_id", column).agg(F.count_distinct("entity_id").alias("_n")).where("_n >= 2").select("query_id", column, F.lit(True).alias(f"{column}_two"))

    out = rows
    for c in ("memory_id", "o", "p"):
        out = out.join(several(c), ["query_id", c], "left")
    # A fact of another entity, of another predicate or none: of all kinds of facts less those of its own entity, less those of others with its predicate.
    kinds = {"any": rows.select("query_id", "entity_id", "p").distinct(), "self": rows.where("self").select("query_id", "entity_id", "p").distinct()}
    for name, kind in kinds.items():
        every = kind.groupBy("query_id").agg(F.count("*").alias(f"{name}_all"))
        own = kind.groupBy("query_id", "entity_id").agg(F.count("*").alias(f"{name}_own"))
        alike = kind.where("p <> ''").groupBy("query_id", "p").agg(F.count("*").alias(f"{name}_alike"))
        both = kind.where("p <> ''").select("query_id", "entity_id", "p", F.lit(1).alias(f"{name}_both"))
        out = out.join(every, "query_id", "left").join(own, ["query_id", "entity_id"], "left").join(alike, ["query_id", "p"], "left").join(both, ["query_id", "entity_id", "p"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    other = lambda n: zero(f"{n}_all") - zero(f"{n}_own") - (zero(f"{n}_alike") - zero(f"{n}_both")) > 0
    score = (
        F.when(F.col("memory_id_two"), TOGETHER).when(F.col("o_two") & (F.col("o") != ""), SAME_OBJECT)
        .when(other("self") | (F.col("self") & other("any")), NAMED).when(F.col("p_two") & (F.col("p") != ""), SAME_PREDICATE).otherwise(0.0)
    )
    return out.withColumn("score", score).where("score > 0").select("query_id", "id", "memory_id", "score")


def results_of_facts(activation: DataFrame, facts: DataFrame, floor: float = 0.0) -> DataFrame:
    """``query_id, memory_id, score, fact_id, facts``: memories by their best activated fact (``query_id, id, activation``), and how many of their facts reach ``floor``."""
    met = activation.where(F.col("activation") >= floor).join(facts.select("id", "memory_id"), "id")
    best = met.groupBy("query_id", "memory_id").agg(F.max_by(F.struct("activation", "id"), F.struct("activation", -F.col("id"))).alias("b"), F.count_distinct("id").alias("facts"))
    return best.select("query_id", "memory_id", F.col("b.activation").alias("score"), F.col("b.id").alias("fact_id"), "facts")


def bridge_results(facts: DataFrame, asked: DataFrame, fused: DataFrame) -> DataFrame:
    """Memories of bridge facts, as ``results_of_facts``: scores are shares of 0.9 times the best that a query's fused results (``query_id, score``) have; a query without any gets none."""
    top = fused.groupBy("query_id").agg(F.max("score").alias("top"))
    active = bridge_facts(facts, asked).join(top, "query_id").select("query_id", "id", F.round(F.col("top") * BRIDGE * F.col("score"), 9).alias("activation"))
    return results_of_facts(active, facts)


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """``pair_id, node, step, distance``: for each pair (``pair_id, source, target``) all nodes on its shortest paths over undirected edges (``source_fact_id, target_fact_id``), ``step`` from
    the source; no row for a pair that is more than ``most`` steps apart.

    Both ends are searched in turns, one step each, for all pairs together; a pair that has met is searched no further. Where the two searches meet, the least sum of their depths is the
    distance, and from there the paths are followed back to both ends. Frontiers are written, so that the join with a hub's edges is split.
    """
    spark = edges.sparkSession
    with scratch(spark):
        both = materialize(undirected(edges).distinct(), "path-edges")
        open_ = materialize(pairs.select("pair_id", "source", "target").distinct(), "path-pairs")
        seen = {x: materialize(open_.select("pair_id", F.col(end).alias("node"), F.lit(0).alias("depth")), f"path-{x}") for x, end in (("a", "source"), ("b", "target"))}
        frontier, met = dict(seen), None
        for turn in range(most + 1):
            if turn:
                x = "ab"[(turn + 1) % 2]
                reached = frontier[x].join(open_, "pair_id", "left_semi").join(both, F.col("node") == F.col("a")).select("pair_id", F.col("b").alias("node")).distinct()
                frontier[x] = materialize(reached.join(seen[x], ["pair_id", "node"], "left_anti").withColumn("depth", F.lit((turn + 1) // 2)), f"path-{x}")
                seen[x] = seen[x].unionByName(frontier[x])
            other = seen["b"].toDF("pair_id", "node", "other")
            sums = seen["a"].join(open_.select("pair_id"), "pair_id", "left_semi").join(other, ["pair_id", "node"]).withColumn("distance", F.col("depth") + F.col("other"))
            least = F.min("distance").over(Window.partitionBy("pair_id"))
            new = materialize(sums.withColumn("least", least).where("distance = least").select("pair_id", "node", "depth", "other", "distance"), "path-met")
            met = new if met is None else met.unionByName(new)
            open_ = materialize(open_.join(new.select("pair_id").distinct(), "pair_id", "left_anti"), "path-pairs")
            if open_.isEmpty():
                break
        found = met.select("pair_id", "node", F.col("depth").alias("step"), "distance")
        for x in "ab":  # back from where they met
            here = met.select("pair_id", "node", F.col("depth" if x == "a" else "other").alias("depth"), "distance")
            for _ in range((most + 1) // 2):
                back = here.where("depth > 0").join(both, F.col("node") == F.col("a")).select("pair_id", F.col("b").alias("node"), (F.col("depth") - 1).alias("depth"), "distance").distinct()
                here = materialize(back.join(seen[x], ["pair_id", "node", "depth"], "left_semi"), f"path-back-{x}")
                found = found.unionByName(here.select("pair_id", "node", (F.col("depth") if x == "a" else F.col("distance") - F.col("depth")).alias("step"), "distance"))
        return materialize(found.distinct(), "paths", keep=True)


def neighbour_edges(index: Index, vectors: DataFrame, k: int = 6, least: float = 0.5) -> DataFrame:
    """``source_fact_id, target_fact_id, confidence``: an edge from each of ``vectors`` (``id, vector``) to the ``k`` closest that the index has, with their cosine, if that is ``least``."""
    return nearest(index, vectors, k, least=least).select(F.col("query_id").alias("source_fact_id"), F.col("id").alias("target_fact_id"), F.col("cosine").alias("confidence"))
