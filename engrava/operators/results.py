"""Stages of a search on its results: source tiers and priors, noise, scopes, boosts, suppression, pinning and reranking.

Results are rows with ``id, source_file, content, score`` and whatever metadata a stage names; each stage returns them with the score changed or with
fewer rows, so stages can be chained in any order. Nothing is sorted but where a stage says so.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MANUAL, CONNECTOR, TEMPORARY, CAPTURED = 1.05, 0.97, 0.70, 0.60
TIER_FACTOR = {"core": 1.05 * 1.50, "journal": 1.05 * 1.30, "context": 1.05 * 1.20, "capture": 1.05 * 0.70 * 0.60, "transient": 1.05 * 0.70}
CONNECTORS = ["github:", "gmail:", "calendar:", "drive:", "slack:", "discord:", "telegram:", "notion:", "obsidian:"]
WRAPPERS = ["conversation info (untrusted metadata)", "sender (untrusted metadata)", "<relevant-memories>", "[queued messages while agent was busy]"]
LOW_SIGNAL = ["fire the test", "run test", "run the test", "heartbeat ok", "heartbeat_ok"]
AGENT_BOOST, CHANNEL_BOOST, SESSION_BOOST = 1.08, 1.05, 1.15
CURATED_PRIOR, CAPTURE_PRIOR, WRAPPER_PRIOR, LOW_SIGNAL_PRIOR = 1.06, 0.92, 0.35, 0.55
WRAPPER_PENALTY, LOW_SIGNAL_PENALTY = 0.15, 0.05
#: Weight of the effective confidence in a score.
CONFIDENCE_WEIGHT = 0.2
#: Weights of the keyword, vector, entity and temporal channels by a query's strategy.
CHANNEL_WEIGHTS = {"temporal": (0.7, 0.8, 0.3, 1.4), "entity": (0.7, 0.8, 1.4, 0.3), "comparison": (0.8, 1.0, 1.2, 0.4), "bridge": (0.9, 1.1, 1.0, 0.7)}
DEFAULT_WEIGHTS = (1.0, 1.0, 0.6, 0.4)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _low(path: Column) -> Column:
    return F.lower(F.trim(path))


def source_tier(path: Column) -> Column:
    """``core``, ``journal``, ``context``, ``capture``, ``transient``, or empty."""
    p = _low(path)
    under = lambda folder: p.startswith(folder) | p.contains("/" + folder)
    return (
        F.when((p == "memory.md") | p.endswith("/memory.md"), "core")
        .when(p.endswith(".md") & under("memory/"), "journal")
        .when(under("shared-context/"), "context")
        .when(p.contains("auto-capture"), "capture")
        .when(p.startswith("/var/folders/") | p.startswith("/tmp/"), "transient")
        .otherwise("")
    )


def is_connector(path: Column) -> Column:
    return _any([F.startswith(F.lower(path), F.lit(c)) for c in CONNECTORS])


def is_memory_source(path: Column) -> Column:
    p = _low(path)
    return p.endswith("memory.md") | p.contains("memory/")


def source_weight(path: Column) -> Column:
    """What a result's score is multiplied by for where it comes from."""
    out = F.when(_low(path) == "", F.lit(1.0))
    for tier, weight in TIER_FACTOR.items():
        out = out.when(source_tier(path) == tier, F.lit(weight))
    return out.when(is_connector(path), F.lit(CONNECTOR)).otherwise(F.lit(MANUAL))


def of_intent(rows: DataFrame, intent: str) -> DataFrame:
    """Results from ``memory`` files, from a ``connector``, or from any other ``import``; all for another intent."""
    path = F.col("source_file")
    held = {"memory": is_memory_source(path), "connector": is_connector(path), "import": ~is_connector(path) & ~is_memory_source(path)}
    return rows.where(held[intent]) if intent in held else rows


def is_captured(path: Column) -> Column:
    return _low(path).contains("auto-capture")


def is_wrapper(content: Column) -> Column:
    """Holds the frame that a transport puts around messages."""
    return _any([F.contains(F.lower(content), F.lit(w)) for w in WRAPPERS])


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", " "))


def is_low_signal(content: Column) -> Column:
    """Holds a phrase that only tests or keeps alive, whatever stands between its words."""
    phrases = sorted({" ".join("".join(c if c.isalnum() else " " for c in p).split()) for p in LOW_SIGNAL})
    return _any([F.contains(_words(content), F.lit(p)) for p in phrases])


def capture_penalty(rows: DataFrame) -> DataFrame:
    """Captured wrappers and low signals count little."""
    factor = F.when(is_captured(F.col("source_file")) & is_wrapper(F.col("content")), WRAPPER_PENALTY).when(is_captured(F.col("source_file")) & is_low_signal(F.col("content")), LOW_SIGNAL_PENALTY).otherwise(1.0)
    return rows.withColumn("score", F.col("score") * factor)


def hybrid_prior(path: Column, content: Column) -> Column:
    """More for curated files, less for captures and again for noise in them; between 0.05 and 1.25."""
    p = _low(path)
    curated = F.when(p.endswith("/memory.md") | p.endswith("/user.md"), CURATED_PRIOR).otherwise(1.0)
    noise = F.when(is_wrapper(content), WRAPPER_PRIOR).when(is_low_signal(content), LOW_SIGNAL_PRIOR).otherwise(1.0)
    return F.least(F.lit(1.25), F.greatest(F.lit(0.05), curated * F.when(is_captured(path), CAPTURE_PRIOR * noise).otherwise(1.0)))


def _suppress(rows: DataFrame, noise: Column) -> DataFrame:
    """Without noise, unless nothing else is left: one row tells whether there is."""
    marked = rows.withColumn("_noise", noise)
    left = marked.agg(F.coalesce(F.bool_or(~F.col("_noise")), F.lit(False)).alias("_left"))
    return marked.crossJoin(F.broadcast(left)).where("NOT (_noise AND _left)").drop("_noise", "_left")


def suppress_low_signal(rows: DataFrame, query: str) -> DataFrame:
    """Queries of low signal lose captured wrappers and phrases; all others lose phrases of low signal wherever they come from."""
    captured, low = is_captured(F.col("source_file")), is_low_signal(F.col("content"))
    asked = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()) in {" ".join(p.replace("_", " ").split()) for p in LOW_SIGNAL}
    return _suppress(rows, captured & (low | is_wrapper(F.col("content"))) if asked else low)


def suppress_wrappers(rows: DataFrame) -> DataFrame:
    return _suppress(rows, is_captured(F.col("source_file")) & is_wrapper(F.col("content")))


def of_metadata(rows: DataFrame, agent: str = "", channel: str = "", session: str = "", after: str = "", before: str = "") -> DataFrame:
    """Results by agent (id or name), channel (or its name), session, and days of import, both included; empty asks for nothing. Case doesn't matter."""
    same = lambda c, v: F.lower(c) == v.lower()
    out = rows
    if agent:
        out = out.where(same("agent_id", agent) | same("agent_name", agent))
    if channel:
        out = out.where(same("channel", channel) | same("channel_name", channel))
    if session:
        out = out.where(same("session_key", session))
    day = F.date_format("imported_at", "yyyy-MM-dd")
    return out.where((day >= (after or "0000")) & (day <= (before or "9999")))


def metadata_boosts(rows: DataFrame, agent: str = "", channel: str = "", session: str = "") -> DataFrame:
    """More for the asker's own agent, channel and session."""
    factor = F.lit(1.0)
    for column, value, boost in (("agent_id", agent, AGENT_BOOST), ("channel", channel, CHANNEL_BOOST), ("session_key", session, SESSION_BOOST)):
        if value:
            factor = factor * F.when(F.lower(column) == value.lower(), boost).otherwise(1.0)
    return rows.withColumn("score", F.col("score") * factor)


def confidence_decay(rows: DataFrame, confidence: DataFrame) -> DataFrame:
    """Scores moved by a fifth towards the mean effective confidence (``memory_id, effective``) of a result's facts; 1 without facts."""
    joined = rows.join(confidence.select(F.col("memory_id").alias("_m"), F.col("effective").alias("_e")), F.col("id") == F.col("_m"), "left")
    return joined.withColumn("score", F.col("score") * (1 - CONFIDENCE_WEIGHT + CONFIDENCE_WEIGHT * F.coalesce("_e", F.lit(1.0)))).drop("_m", "_e")


def metadata_prefix(row: dict[str, Column] | None = None) -> Column:
    """``agent:… channel:… date:…`` and a line end, of what is known; empty if nothing is."""
    c = row or {n: F.col(n) for n in ("agent_id", "agent_name", "channel", "channel_name", "surface", "model", "timestamp_start")}
    part = lambda label, v, when=F.lit(True): F.when((v != "") & when, F.concat(F.lit(label), v))
    parts = [
        part("agent:", c["agent_id"]), part("agent:", c["agent_name"], c["agent_name"] != c["agent_id"]), part("channel:", c["channel"]), part("channel:", c["channel_name"]),
        part("surface:", c["surface"], c["surface"] != c["channel"]), part("model:", c["model"]), part("date:", F.substring(c["timestamp_start"], 1, 10), F.length(c["timestamp_start"]) >= 10),
    ]
    joined = F.concat_ws(" ", *parts)
    return F.when(joined == "", "").otherwise(F.concat(joined, F.lit("\n")))


def in_scope(facts: DataFrame, memories: DataFrame, agents: list[str] | None = None, sessions: list[str] | None = None, projects: list[str] | None = None) -> DataFrame:
    """``id`` of memories of which some fact is in scope; where a fact says nothing its memory speaks for it, as for memories without facts.

    ``facts`` has ``memory_id, agent_id, session_id, project_id``; ``memories`` has ``id, agent_id, session_key, project``. Case doesn't matter; what is empty is in no scope.
    """
    f = facts.select(F.col("memory_id").alias("id"), *[F.nullif(F.trim(c), F.lit("")).alias(f"f_{c}") for c in ("agent_id", "session_id", "project_id")])
    both = memories.select("id", *[F.nullif(F.trim(c), F.lit("")).alias(f"m_{c}") for c in ("agent_id", "session_key", "project")]).join(f, "id", "left")
    held = F.lit(True)
    for mine, its, values in (("f_agent_id", "m_agent_id", agents), ("f_session_id", "m_session_key", sessions), ("f_project_id", "m_project", projects)):
        if values:
            held = held & F.coalesce(F.lower(F.coalesce(mine, its)).isin([v.strip().lower() for v in values]), F.lit(False))
    return both.where(held).select("id").distinct()


def pin_directives(rows: DataFrame, directives: DataFrame) -> DataFrame:
    """``kind, id, score``: active directives (``id``) before all results, by a score one over the highest."""
    top = rows.agg((F.coalesce(F.greatest(F.max("score"), F.lit(0.0)), F.lit(0.0)) + 1).alias("score"))
    pinned = directives.select(F.lit("directive").alias("kind"), "id").crossJoin(F.broadcast(top))
    return pinned.unionByName(rows.select(F.lit("memory").alias("kind"), "id", "score"))


def rerank(rows: DataFrame, scores: DataFrame, most: int, limit: int) -> DataFrame:
    """``query_id, id, place``: each query's first ``most`` candidates (``query_id, id, base, at``) in the order of a scorer's ``score``, then of ``base`` and ``at``; the rest follow as they
    were; the first ``limit`` of all. A candidate without a score keeps its base as such."""
    joined = rows.join(scores.select("query_id", "id", "score"), ["query_id", "id"], "left").withColumn("score", F.coalesce("score", "base"))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("at") < most, 0).otherwise(1), F.when(F.col("at") < most, F.col("score")).desc_nulls_last(), F.when(F.col("at") < most, F.col("base")).desc_nulls_last(), "at")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "id", "place")


def scene_affinity(proximity: Column, lexical: Column, entity: Column, temporal: Column, same_session: Column, same_section: Column, least: float = 0.45) -> Column:
    """How well a neighbour of a result fits its scene, up to 0.95; 0 below ``least``, and where nothing but the place in the file speaks for it."""
    session, section = (F.when(c, v).otherwise(0.0) for c, v in ((same_session, 0.15), (same_section, 0.10)))
    sum_ = 0.20 + 0.25 * proximity + 0.25 * lexical + 0.20 * entity + 0.10 * temporal + session + section
    nothing = (lexical < 0.01) & (entity == 0) & (temporal == 0) & ~same_session & ~same_section
    return F.when(nothing | (sum_ < least), 0.0).otherwise(F.least(sum_, F.lit(0.95)))


def channel_weights(strategy: Column, asks_time: Column) -> Column:
    """The four channels' weights for a strategy as an array; queries that ask for a time weigh the temporal channel by 1 at least."""
    pick = lambda k: reduce(lambda out, s: F.when(strategy == s, CHANNEL_WEIGHTS[s][k]).otherwise(out), CHANNEL_WEIGHTS, F.lit(DEFAULT_WEIGHTS[k]))
    return F.array(*[pick(k) for k in range(3)], F.when(asks_time, F.greatest(pick(3), F.lit(1.0))).otherwise(pick(3)))


def profile_results(facts: DataFrame, query: str, entities: list[int], text_score: Column) -> DataFrame:
    """``memory_id, score, fact_id``: of each memory with facts of the query's entities the best of 1.05 and the fact's text score and 0.15 of its confidence; of equals the first fact."""
    scored = facts.where(F.col("entity_id").isin(entities) & F.col("superseded_by").isNull())
    score = 1.05 + text_score + 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    best = scored.select("memory_id", "id", F.round(score, 9).alias("score")).groupBy("memory_id").agg(F.max_by(F.struct("score", "id"), F.struct("score", -F.col("id"))).alias("b"))
    return best.select("memory_id", "b.score", F.col("b.id").alias("fact_id"))



def search_facts(facts: DataFrame, memories: DataFrame, text_score: Column, least: float, limit: int) -> DataFrame:
    """``id, score``: the ``limit`` best facts by their text's score, what their memory's source weighs, and a quarter of their confidence; of equals the later. Scores below ``least`` go before these."""
    joined = facts.withColumn("_text", text_score).where(F.col("_text") >= least).join(memories.select(F.col("id").alias("memory_id"), "source_file"), "memory_id")
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    score = F.col("_text") * source_weight(F.col("source_file")) * (0.75 + 0.25 * unit)
    return joined.select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), F.desc("id")).limit(limit)


def ranked(found: DataFrame, notes: DataFrame, query: str, confidence: DataFrame | None = None, agent: str = "", channel: str = "", session: str = "", limit: int = 10) -> DataFrame:
    """``id, score, rank``: a keyword search's results (``id, score``) through all stages, the ``limit`` best; of equals the first by id.

    In order: what isn't wrapped or of low signal (unless nothing else is left), the noise penalty, the source's weight, boosts for the asker's own metadata, and the effective confidence.
    """
    rows = notes.drop("score").join(found.select("id", "score"), "id")
    rows = capture_penalty(suppress_low_signal(suppress_wrappers(rows), query))
    rows = metadata_boosts(rows.withColumn("score", F.col("score") * source_weight(F.col("source_file"))), agent, channel, session)
    if confidence is not None:
        rows = confidence_decay(rows, confidence)
    top = rows.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # a list of ``limit``
