"""Recall over time and scope: neighbours, histories, standing rules, activation and context building."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions import text as T
from engrava.plans.ranks import numbered
from engrava.plans.storage import materialize, scratch

#: Words that tell what kind of question a query is, in order.
STRATEGIES = [("comparison", r"\b(compare|versus|vs|difference)\b"), ("bridge", r"\b(both|between|connect)\b"), ("temporal", r"\b(when|before|after|since|until|yesterday|last)\b"), ("entity", r"\b(who|whose|where)\b")]
#: Lines that look like instructions to a reader of the retrieved text.
INJECTION = ["ignore previous", "ignore all previous", "system prompt", "developer message", "you are chatgpt", "assistant:", "system:", "tool:", "### instruction"]


def temporal_neighbors(rows: DataFrame, days: int = 7) -> DataFrame:
    """``id, neighbor``: facts of one entity at most ``days`` apart. A range join binned by day spans, so that only neighbouring bins meet."""
    span = F.floor(F.unix_timestamp("created_at") / (86400 * days))
    a = rows.select("id", "entity_id", F.unix_timestamp("created_at").alias("t"), span.alias("bin"))
    b = rows.select(F.col("id").alias("neighbor"), "entity_id", F.unix_timestamp("created_at").alias("u"), F.explode(F.array(span - 1, span, span + 1)).alias("bin"))
    return a.join(b, ["entity_id", "bin"]).where((F.col("id") != F.col("neighbor")) & (F.abs(F.col("t") - F.col("u")) <= 86400 * days)).select("id", "neighbor")


def overlapping_windows(windows: DataFrame, known: DataFrame) -> DataFrame:
    """Windows (``key, start, end``) that overlap none of the known ones with their key."""
    k = known.select("key", F.col("start").alias("s"), F.col("end").alias("e"))
    return windows.join(k, (windows.key == k.key) & (windows.start <= k.e) & (windows.end >= k.s), "left_anti")


def active_directives(directives: DataFrame, scope: str) -> DataFrame:
    """Active rules of all scopes and of one, the global ones first, then by id."""
    return directives.where((F.col("status") == "active") & F.col("scope").isin("global", scope)).orderBy(F.desc(F.col("scope") == "global"), "id")


def fact_history(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``root, id, step``: what each fact was superseded by, and what that was, to the chain's end (or ``most`` steps); without a limit a chain that returns to itself ends there.

    Every step joins only what the one before has found, and is written, so the plan doesn't grow with the length of a chain.
    """
    links = rows.where("superseded_by IS NOT NULL").select("id", "superseded_by")
    step = links.select(F.col("id").alias("root"), F.col("superseded_by").alias("id"), F.lit(1).alias("step"))
    step = materialize(step.join(rows.select("id"), "id", "left_semi"), "history")
    out, k = step, 1
    while most is None or k < most:
        k += 1
        on = step.join(links, "id").join(rows.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi")
        on = on.select("root", F.col("superseded_by").alias("id"), F.lit(k).alias("step"))
        if most is None:
            on = on.join(out.select("root", "id"), ["root", "id"], "left_anti").where("root <> id")
        step = materialize(on, "history")
        if step.isEmpty():
            break
        out = out.union(step)
    return out


def fact_card(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Facts with a summary of their accesses: ``n``, ``agents`` and ``last``; 0 and null for those never used."""
    used = log.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("agent_id").alias("agents"), F.max("created_at").alias("last"))
    return rows.join(used, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("agents", F.coalesce("agents", F.lit(0)))


def sanitize(content: Column) -> Column:
    """A text without the lines that look like instructions."""
    return F.array_join(F.filter(F.split(content, "\n"), lambda x: ~reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(w)) for w in INJECTION])), "\n")


def query_strategy(query: Column) -> Column:
    out = F.lit("default")
    for name, pattern in reversed(STRATEGIES):
        out = F.when(F.lower(query).rlike(pattern), name).otherwise(out)
    return out


def recall_class(facts: DataFrame) -> DataFrame:
    """``memory_id, class``: ``retired`` if all its facts are, ``prompt_safe`` if its active facts are confident, else ``evidence``."""
    live = F.col("superseded_by").isNull() & ~F.col("state").isin("retired", "superseded")
    each = facts.groupBy("memory_id").agg(F.count(F.when(live, 1)).alias("live"), F.avg(F.when(live, F.col("confidence"))).alias("c"))
    return each.select("memory_id", F.when(F.col("live") == 0, "retired").when(F.col("c") >= 0.6, "prompt_safe").otherwise("evidence").alias("class"))


def spread_activation(edges: DataFrame, seeds: DataFrame, hops: int = 2, decay: float = 0.7, floor: float = 0.1) -> DataFrame:
    """``node, activation``: the largest activation that reaches a node, less by ``decay`` and by the edge's confidence at each hop, not below ``floor``."""
    both = materialize(edges.select(F.col("source_fact_id").alias("a"), F.col("target_fact_id").alias("b"), "confidence"), "activation-edges")  # each hop reads them twice
    both = both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    best = materialize(seeds.select("node", F.col("activation").cast("double").alias("activation")), "activation")
    for _ in range(hops):
        reached = best.join(both, best.node == both.a).select(F.col("b").alias("node"), (F.col("activation") * decay * F.col("confidence")).alias("activation")).where(F.col("activation") >= floor)
        best = materialize(best.union(reached).groupBy("node").agg(F.max("activation").alias("activation")), "activation")
    return best.select("node", F.round("activation", 9).alias("activation"))


def scene(turns: DataFrame, seeds: DataFrame, reach: int = 1) -> DataFrame:
    """Turns at most ``reach`` from a seed (``conv_id, turn``) in the same conversation."""
    s = seeds.select("conv_id", F.explode(F.sequence(F.col("turn") - reach, F.col("turn") + reach)).alias("turn")).distinct()
    return turns.join(s, ["conv_id", "turn"], "left_semi")


def skip_packing(items: DataFrame, most_items: int = 6, most_tokens: int = 450, by: str = "query_id") -> DataFrame:
    """Greedy by rank within each query's result list (top-k, so bounded): an item that no longer fits is skipped, later ones may still."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        used, kept = 0, []
        for r in group.sort_values("rank").itertuples():
            if len(kept) < most_items and used + r.tokens <= most_tokens:
                kept.append(r.Index)
                used += r.tokens
        return group.loc[kept]

    return items.groupBy(by).applyInPandas(pack, items.schema)


def drop_overlapping(items: DataFrame, threshold: float = 0.6, by: str = "query_id") -> DataFrame:
    """Greedy by rank within a query's result list: an item goes if its 5-token shingles overlap those of a kept one of the same source by more than the threshold."""

    def prints(text: str) -> set:
        words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or set(words)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        kept: dict[str, list[set]] = {}
        out = []
        for r in group.sort_values("rank").itertuples():
            mine = prints(r.content)
            if all(not mine or not k or len(mine & k) / min(len(mine), len(k)) <= threshold for k in kept.get(r.source_file, [])):
                kept.setdefault(r.source_file, []).append(mine)
                out.append(r.Index)
        return group.loc[out]

    return items.groupBy(by).applyInPandas(pick, items.schema)


def near_duplicates_in_time(rows: DataFrame, seconds: int = 300, newest: int = 100, threshold: float = 0.95, block: int = 512) -> DataFrame:
    """``id, other, cosine``: memories and earlier ones at most ``seconds`` before, the ``newest`` of these, whose term frequencies are as close as the threshold.

    In order of time and id these are a memory's ``newest`` predecessors, as far as they are near enough. Rows are numbered and dealt out in runs of ``block``, each with the ``newest`` before
    it, so candidates meet only within a task. There sums over classes of words bound each dot product from above (Cauchy-Schwarz), and what the bound leaves is counted exactly.
    """
    with scratch(rows.sparkSession):
        timed = rows.where("id IS NOT NULL AND imported_at IS NOT NULL").select(F.col("id").cast("long"), F.unix_timestamp("imported_at").alias("t"), "content")
        placed = numbered(timed, "n", [F.col("t"), F.col("id")])
        own = F.floor(F.col("n") / block)
        dealt = placed.withColumn("block", F.explode(F.sequence(own, F.floor((F.col("n") + newest) / block))))
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() // (8 * block)))
        runs = dealt.repartition(parts, "block").sortWithinPartitions("block", "n").select("block", "n", "id", "t", T.tokens(F.col("content")).alias("words"))
        met = runs.mapInArrow(lambda batches: _near(batches, seconds, newest, threshold, block), "id long, other long, dot long, norm long, other_norm long")
        met = materialize(met, "near-in-time", keep=True)
    cosine = F.col("dot") / (F.sqrt("norm") * F.sqrt("other_norm"))
    return met.select("id", "other", F.round(cosine, 9).alias("cosine")).where(F.col("cosine") >= threshold)


def _near(batches: Iterator[pa.RecordBatch], seconds: int, newest: int, threshold: float, block: int, classes: int = 256) -> Iterator[pa.RecordBatch]:
    """Pairs of rows sorted by ``block, n`` that the bound leaves, each with its dot product and squared norms."""
    held: list[tuple[int, int, int, int, Counter]] = []

    def found() -> pa.RecordBatch:
        sums, squares = np.zeros((len(held), classes)), [sum(c * c for c in w.values()) for *_, w in held]
        for k, (*_, words) in enumerate(held):
            np.add.at(sums[k], np.fromiter((hash(w) % classes for w in words), np.int64, len(words)), np.fromiter((c * c for c in words.values()), np.float64, len(words)))
        norm, at, place = np.sqrt(sums), np.array([r[2] for r in held]), np.array([r[1] for r in held])
        length = np.sqrt(np.array(squares, np.float64))
        fits = (norm @ norm.T >= (threshold - 1e-6) * length[:, None] * length) & (length[:, None] > 0) & (length > 0)
        back = place[:, None] - place
        fits &= (place[:, None] // block == held[0][0]) & (back > 0) & (back <= newest) & (at[:, None] - at <= seconds)
        out = []
        for i, j in zip(*np.nonzero(fits)):
            a, b = sorted((held[i][4], held[j][4]), key=len)
            dot = sum(c * b[w] for w, c in a.items())
            if dot and held[i][3] != held[j][3]:
                out.append((held[i][3], held[j][3], dot, squares[i], squares[j]))
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "other", "dot", "norm", "other_norm"])

    for batch in batches:
        for b, n, key, t, words in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "id", "t", "words"))):
            if held and held[0][0] != b:
                yield found()
                held = []
            held.append((b, n, t, key, Counter(words or ())))
    if held:
        yield found()


def normalize_chunks(rows: DataFrame, least: int = 50, most: int = 1500) -> DataFrame:
    """``path, position, text``: chunks of over ``most`` bytes split at paragraphs, lines, or spaces; those under ``least`` joined to the one before, else the next.

    An ordered fold over one document's text, in Arrow batches.
    """

    def split(text: str) -> list[str]:
        if len(text.encode()) <= most:
            return [text]
        mark = next((m for m in ("\n\n", "\n") if m in text.strip()), None)
        if mark is None:
            return _cut(text, most)
        out, held = [], ""
        for part in text.strip().split(mark):
            joined = f"{held}{mark}{part}" if held else part
            if held and len(joined.encode()) > most:
                out.append(held)
                held = part
            else:
                held = joined
        return [y for x in (*out, held) for y in split(x)]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, content in zip(batch["path"], batch["content"]):
                parts = [x.strip() for x in split(content or "") if x.strip()]
                joined: list[str] = []
                for x in parts:
                    if joined and (len(x.encode()) < least or len(joined[-1].encode()) < least):
                        joined[-1] += "\n\n" + x
                    else:
                        joined.append(x)
                found += [(path, k, x) for k, x in enumerate(joined)]
            yield pd.DataFrame(found, columns=["path", "position", "text"])

    return rows.select("path", "content").mapInPandas(fold, "path string, position int, text string")


def _cut(text: str, most: int) -> list[str]:
    out = []
    while len(text.encode()) > most:
        head = text.encode()[:most].decode(errors="ignore")
        at = head.rfind(" ")
        head = head[:at] if at > 0 else head
        out.append(head)
        text = text[len(head) :].lstrip()
    return [*out, text]

