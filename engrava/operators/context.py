"""What a search found, made ready for a reader with a budget: chunks of texts, recall items and their order, grouped context, and neighbourhoods of a graph.

Every function works for many queries at once; what is folded in order is a query's own list of results, which its limit bounds, or one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.plans.storage import join_small, materialize, scratch

# Types of facts that last, classes that may be quoted, sources that don't last.
DURABLE = ["preference", "identity", "decision", "config", "location"]
QUOTED = ["rule", "decision", "preference", "identity"]
TRANSIENT = ["capture", "transient"]
#: Words of a query that say nothing of its subject.
STOPWORDS = "what which who when where why how do does did i me my mine have for in on to of the a an be specific please tell about is are there".split()


def overlapping_chunks(rows: DataFrame, window: int, overlap: int = 200) -> DataFrame:
    """``id, position, start, text``: each text (``id, content``) in pieces of up to three quarters of ``window`` tokens (four characters each), the next beginning ``overlap`` characters
    before the last one's end.

    A piece ends at the last blank line in its last third, if there is one. A text that fits is one piece; null and empty texts have none; blank pieces are left out. ``start``
    counts characters from 0. A fold over the cuts of one text, inside its row.
    """
    most = window * 3 // 4 * 4
    if most * 2 // 3 <= overlap:
        raise ValueError(f"a window of {window} tokens leaves no room for an overlap of {overlap} characters")
    least = most * 2 // 3 - overlap  # a step's least advance
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length("content") / least).cast("int")))
    tail = f"substring(content, s.pos + 1 + {most * 2 // 3}, {most - most * 2 // 3})"
    back = f"locate('\n\n', reverse({tail}))"
    cut = f"CASE WHEN s.pos + {most} < length(content) AND {back} > 0 THEN s.pos + {most} - {back} - 1 ELSE least(s.pos + {most}, length(content)) END"
    zero = "named_struct('pos', 0, 'cuts', cast(array() AS array<struct<start:int,stop:int>>))"
    step = f"named_struct('pos', CASE WHEN ({cut}) >= length(content) THEN null ELSE ({cut}) - {overlap} END, 'cuts', concat(s.cuts, array(named_struct('start', s.pos, 'stop', cast({cut} AS int)))))"
    texts = rows.where("content IS NOT NULL AND content <> ''").select("id", "content", steps.alias("steps"))
    cuts = F.expr(f"CASE WHEN octet_length(content) div 4 <= {window * 3 // 4} THEN array(named_struct('start', 0, 'stop', length(content))) ELSE aggregate(steps, {zero}, (s, k) -> CASE WHEN s.pos IS NULL THEN s ELSE {step} END, s -> s.cuts) END")
    pieces = texts.select("id", "content", F.posexplode(cuts).alias("position", "c"))
    return pieces.select("id", "position", F.col("c.start").alias("start"), F.expr("substring(content, c.start + 1, c.stop - c.start)").alias("text")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def recall_items(results: DataFrame, facts: DataFrame) -> DataFrame:
    """Results (``query_id, id, score, source_tier, memory_class``) with ``fact_ids`` of their active facts, ``fact_types``, ``confidence`` and ``durable``, the best of all and of lasting facts, and
    ``visibility``: ``prompt_safe``, ``retired``, ``journal_only`` or ``evidence_only``, with the ``reasons`` why not to quote.

    ``facts`` are ``id, memory_id, fact_type, confidence, active``. A memory is safe by lasting facts of 0.60, or of 0.45 if it scores 0.60; by its class, from a source that lasts, if it scores
    0.45; by any fact of 0.85 from such a source. One whose facts are all inactive is retired.
    """
    mine = join_small(facts, results.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi")
    live, kind = F.col("active"), F.lower(F.trim("fact_type"))
    known = mine.groupBy(F.col("memory_id").alias("id")).agg(
        F.count("*").alias("_all"), F.count_if(live).alias("_live"), F.array_sort(F.collect_set(F.when(live, F.col("id")))).alias("fact_ids"), F.array_sort(F.collect_set(F.when(live, kind))).alias("fact_types"),
        F.coalesce(F.max(F.when(live, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.coalesce(F.max(F.when(live & kind.isin(DURABLE), F.col("confidence"))), F.lit(0.0)).alias("durable"),
    )
    out = results.join(known, "id", "left").na.fill(0, ["_all", "_live"]).na.fill(0.0, ["confidence", "durable"])
    lasting = ~F.coalesce(F.col("source_tier"), F.lit("")).isin(TRANSIENT)
    name = F.lower(F.trim(F.coalesce("memory_class", F.lit(""))))
    score, durable, live_ = F.col("score"), F.col("durable"), F.col("_live")
    visibility = (
        F.when((durable >= 0.60) | ((durable >= 0.45) & (score >= 0.60)) | (name.isin(QUOTED) & lasting & (score >= 0.45)) | ((live_ > 0) & lasting & (F.col("confidence") >= 0.85)), "prompt_safe")
        .when((live_ == 0) & (F.col("_all") > 0), "retired").when((live_ == 0) & (F.col("source_tier") == "journal"), "journal_only").otherwise("evidence_only")
    )
    evidence = F.array_compact(F.array(F.lit("evidence_only"), F.when(live_ == 0, "no_active_facts"), F.when(~lasting, "transient_source"), F.when(name == "scratch", "scratch_class"), F.when((live_ > 0) & (F.col("confidence") < 0.60), "low_confidence")))
    out = out.withColumn("visibility", visibility)
    reasons = F.when(F.col("visibility") == "prompt_safe", F.array().cast("array<string>")).when(F.col("visibility") == "evidence_only", evidence).otherwise(F.array("visibility"))
    empty = lambda c, t: F.coalesce(c, F.array().cast(t))
    return out.withColumn("reasons", reasons).withColumn("fact_ids", empty(F.col("fact_ids"), "array<bigint>")).withColumn("fact_types", empty(F.col("fact_types"), "array<string>")).drop("_all", "_live")


def recall_rank(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Items (as ``recall_items`` gives, with ``content``) with ``rank_score`` and ``rank``, for queries ``query_id, query``: equal ones by score, then by id.

    What the query wants (a preference, decision, identity, setting or rule) favours items that have it, by how many of the query's telling words they hold; a question that asks for an
    answer favours facts, and short texts.
    """
    q = F.lower(F.trim("query"))
    says = lambda *words: _any(F.contains(q, F.lit(w)) for w in words)
    bare = F.transform(F.split(q, r"\s+"), lambda t: F.regexp_replace(t, r"^[.,!?;:\"'`()\[\]{}<>]+|[.,!?;:\"'`()\[\]{}<>]+$", ""))
    focus = F.array_distinct(F.filter(bare, lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOPWORDS)))
    asked = queries.select(
        "query_id", focus.alias("_focus"), says("preference", "prefer").alias("_preference"), says("decision", "decide", "chosen").alias("_decision"), says("identity", "who am i", "about me").alias("_identity"),
        says("config", "setting", "configured").alias("_config"), says("rule", "policy", "guideline").alias("_rule"), says("what ", "which ", "be specific", "?").alias("_direct"),
    )
    rows = items.join(asked, "query_id")
    text = F.lower("content")
    overlap = F.when(F.size("_focus") > 0, F.size(F.filter("_focus", lambda t: F.contains(text, t))) / F.size("_focus")).otherwise(F.lit(0.0))
    has = lambda t: F.array_contains("fact_types", t)
    name = F.lower(F.trim(F.coalesce("memory_class", F.lit(""))))
    bonus, less, target = F.lit(0.0), F.lit(0.0), F.lit(False)
    for kind, rule in (("preference", 0.45), ("decision", 0.35), ("identity", 0.0)):
        wants = F.col(f"_{kind}")
        bonus = bonus + F.when(wants, F.when(has(kind), 0.95).when(name == kind, 0.65).otherwise(0.0)).otherwise(0.0)
        less = less + F.when(wants & (name == "rule") & ~has(kind), rule).otherwise(0.0)
        target = target | (wants & has(kind))
    target = target | (F.col("_config") & has("config"))
    bonus = bonus + F.when(F.col("_config") & has("config"), 0.85).otherwise(0.0) + F.when(F.col("_rule") & (name == "rule"), 0.70).otherwise(0.0)
    backed, direct = F.size("fact_ids") > 0, F.col("_direct")
    tokens = F.floor((F.octet_length("content") + 3) / 4)
    score = (
        F.col("score") + F.when(F.col("visibility") == "prompt_safe", 0.10).otherwise(0.0) + F.when(direct, F.when(backed, 0.18).otherwise(-0.18)).otherwise(0.0) + bonus * F.greatest(F.lit(0.35), overlap) - less
        - F.when(~F.col("_rule") & (name == "rule") & ~target, 0.20).otherwise(0.0) - F.when(direct & F.coalesce(F.col("source_tier"), F.lit("")).isin(TRANSIENT), 0.10).otherwise(0.0)
        + F.when(direct, 0.25 * overlap - F.greatest(F.lit(0), tokens - 70) / 500.0).otherwise(0.0)
    )
    ranked = rows.withColumn("rank_score", F.round(score, 9)).drop("_focus", "_preference", "_decision", "_identity", "_config", "_rule", "_direct")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_score"), F.desc("score"), "id")))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def grouped_context(items: DataFrame, most: int = 6000, per_item: int = 1200) -> DataFrame:
    """``query_id, context``: results (``query_id, rank, scene, source, score, content``) as blocks of text under a heading for each scene, within a budget of ``most`` bytes a query.

    Scenes come in the order of their first result, results by rank, each clipped to ``per_item`` characters. A scene takes blocks until one doesn't fit what is left of the budget; a scene of
    which none fits is passed over. A query of which nothing fits has an empty context.
    """
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] source:"), F.col("source"), F.lit(" score:"), F.format_string("%.2f", F.col("score")), F.lit("\n"), F.substring("content", 1, per_item))
    scenes = items.select("query_id", "scene", "rank", block.alias("block")).groupBy("query_id", "scene").agg(F.min("rank").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]).alias("blocks"))
    lists = scenes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", "scene", "blocks"))).alias("scenes"))
    heads = F.transform("scenes", lambda x, i: F.struct(F.concat(F.lit("Source group "), (i + 1).cast("string"), F.lit(" — "), x["scene"]).alias("head"), x["blocks"].alias("blocks")))

    def scene_text(left: Column, scene: Column) -> Column:
        """The heading with the blocks that fit, and whether one didn't."""
        start = F.struct(scene["head"].alias("text"), F.lit(False).alias("full"))
        return F.aggregate(scene["blocks"], start, lambda s, b: F.when(s["full"] | (F.octet_length(s["text"]) + 2 + F.octet_length(b) + 1 > left), F.struct(s["text"].alias("text"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(s["text"], F.lit("\n\n"), b).alias("text"), F.lit(False).alias("full"))))["text"]

    def add(state: Column, scene: Column) -> Column:
        text = scene_text(state["left"], scene)
        size = F.octet_length(text)
        none, over = text == scene["head"], size + 2 > state["left"]
        same = F.struct(state["left"].alias("left"), state["texts"].alias("texts"), (state["done"] | (~none & over)).alias("done"))
        more = F.struct((state["left"] - size - 2).alias("left"), F.concat(state["texts"], F.array(text)).alias("texts"), F.lit(False).alias("done"))
        return F.when(state["done"] | none | over, same).otherwise(more)

    start = F.struct(F.lit(most).alias("left"), F.array().cast("array<string>").alias("texts"), F.lit(False).alias("done"))
    return lists.select("query_id", F.array_join(F.aggregate(heads, start, add)["texts"], "\n\n").alias("context"))


def explore(edges: DataFrame, facts: DataFrame, roots: DataFrame, depth: int = 2, fan_out: int = 25, nodes: int = 100, least_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Neighbourhoods of many roots at once (``root, node``; a root may have several nodes): ``root, node, hop, confidence, place``, the ``nodes`` nearest facts of each, at one distance the most
    confident first, and ``root, source_fact_id, target_fact_id, edge_type, confidence``, the edges among them.

    From a node only its ``fan_out`` most confident edges are followed, in either direction (equal ones to the smaller node), so that a hub is no larger than any other: which these are is told once
    for all nodes, by ranks that are cut before they are shuffled. Only facts that there are (``id, confidence``) are reached.
    """
    spark = edges.sparkSession
    with scratch(spark):
        strong = edges.where(F.col("confidence") >= least_confidence).select("source_fact_id", "target_fact_id", "edge_type", "confidence")
        both = strong.select(F.col("source_fact_id").alias("a"), F.col("target_fact_id").alias("b"), "confidence").unionByName(strong.select(F.col("target_fact_id").alias("a"), F.col("source_fact_id").alias("b"), "confidence"))
        one = both.where("a <> b").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("confidence"), "b"))
        followed = materialize(one.withColumn("r", rank).where(F.col("r") <= fan_out).select("a", "b"), "followed")
        known = facts.select(F.col("id").alias("node"), F.col("confidence"))
        frontier = materialize(roots.select("root", "node").distinct().join(known.select("node"), "node", "left_semi").select("root", "node", F.lit(0).alias("hop")), "explore")
        seen = frontier
        for hop in range(1, depth + 1):
            reached = frontier.join(followed, frontier.node == followed.a).select("root", F.col("b").alias("node")).distinct().join(known.select("node"), "node", "left_semi")
            frontier = materialize(reached.join(seen, ["root", "node"], "left_anti").select("root", "node", F.lit(hop).alias("hop")), "explore")
            seen = seen.unionByName(frontier)
        place = F.row_number().over(Window.partitionBy("root").orderBy("hop", F.desc("confidence"), "node"))
        kept = materialize(seen.join(known, "node").withColumn("place", place).where(F.col("place") <= nodes).select("root", "node", "hop", "confidence", "place"), "explored", keep=True)
        ends = kept.select("root", "node")
        inside = strong.join(ends.select("root", F.col("node").alias("source_fact_id")), "source_fact_id").join(ends.select("root", F.col("node").alias("target_fact_id")), ["root", "target_fact_id"])
        between = inside.groupBy("root", "source_fact_id", "target_fact_id", "edge_type").agg(F.max("confidence").alias("confidence"))
        return kept, materialize(between, "explored-edges", keep=True)


def connected_subjects(explored: DataFrame, facts: DataFrame) -> DataFrame:
    """``root, subject``: subjects of what was explored, but for those of the root's own nodes, whatever the case of letters."""
    named = explored.join(facts.select(F.col("id").alias("node"), "subject"), "node").select("root", "hop", "subject", F.lower(F.trim("subject")).alias("key")).where("key <> ''")
    return named.join(named.where("hop = 0").select("root", "key"), ["root", "key"], "left_anti").select("root", "subject").distinct()
