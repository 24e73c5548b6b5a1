"""Keyword search for a table of queries at once, with block-max pruning, and its evaluation against what queries expect to find.

All queries share one pass over the postings of the terms that any of them asks for. Texts are dealt into blocks; the greatest score that a term gives in a block bounds what
the block's texts can score, so a query's best blocks are scored first, its ``k``-th best score there is a threshold, and only blocks whose bound reaches it are scored
at all. Nothing that could be among the ``k`` best is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.operators.keyword import B, K1, SCALE, Index
from engrava.plans.storage import join_small, materialize, scratch

#: Texts a block holds, about; blocks that a query scores before it prunes.
BLOCK, FIRST = 512, 4
_WORDS = "filter(split(lower({}), '[^a-z0-9]+'), w -> w <> '')"


def parsed(queries: DataFrame) -> DataFrame:
    """``query_id, kind, term`` of ``query_id, query``: kinds ``must``, ``prefix``, ``without`` and ``phrase``, as ``keyword.parse`` has them; repeated terms once."""
    rest = F.filter(F.split(F.regexp_replace("query", '"[^"]*"', " "), r"\s+"), lambda t: ~t.isin("", "AND", "OR"))
    low = F.regexp_extract_all(F.lower("query"), F.lit('"([^"]*)"'), F.lit(1))
    words = lambda kind: f"transform({_WORDS.format('x')}, w -> struct({kind} AS kind, w AS term))"
    last = f"transform({_WORDS.format('x')}, (w, j) -> struct(if(j = size({_WORDS.format('x')}) - 1, 'prefix', 'must') AS kind, w AS term))"
    single = f"transform(rest, (x, i) -> CASE WHEN x = 'NOT' THEN array() WHEN startswith(x, '-') OR (i > 0 AND get(rest, i - 1) = 'NOT') THEN {words(repr('without'))} WHEN endswith(x, '*') THEN {last} ELSE {words(repr('must'))} END)"
    phrases = f"filter(transform(low, x -> struct('phrase' AS kind, array_join({_WORDS.format('x')}, ' ') AS term)), p -> p.term <> '')"
    inside = f"flatten(transform(low, x -> {words(repr('must'))}))"
    out = queries.select("query_id", rest.alias("rest"), low.alias("low")).select("query_id", F.explode(F.expr(f"concat(flatten({single}), {phrases}, {inside})")).alias("t"))
    return out.select("query_id", "t.kind", "t.term").where("kind <> 'must' OR length(term) > 1").distinct()


def _slots(found: Index, asked: DataFrame) -> DataFrame:
    """``query_id, slot, term``: a term is a slot of its own; a prefix is one of all indexed terms that begin with it, or of none."""
    must = asked.where("kind = 'must'").select("query_id", F.col("term").alias("slot"), "term")
    prefixes = asked.where("kind = 'prefix'")
    lengths = [r.n for r in prefixes.select(F.length("term").alias("n")).distinct().collect()]  # no more than the longest word has letters
    if not lengths:
        return must
    begins = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("term", 1, n).alias("head")) for n in lengths]))
    heads = found.postings.select("term").distinct().select("term", begins.alias("h")).where("length(h.head) = h.n").select("term", F.col("h.head").alias("head"))
    met = prefixes.select("query_id", F.col("term").alias("head")).join(heads, "head", "left")
    return must.unionByName(met.select("query_id", F.concat("head", F.lit("*")).alias("slot"), "term"))


def _impact(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _scored(hits: DataFrame, weights: DataFrame, blocks: DataFrame, average: float) -> DataFrame:
    """``query_id, id, score, held`` of the texts of some blocks (``query_id, block``): what meets is shuffled once, by query and text, for both sums."""
    asked = materialize(weights.join(blocks, "query_id"), "asked-blocks")
    met = join_small(hits, asked, ["no", "block"], "inner").select("query_id", "id", "slot", "idf", "tf", "length").repartition("query_id", "id")
    slot = met.groupBy("query_id", "id", "slot").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"), F.first("idf").alias("idf"))
    one = F.col("idf") * _impact(F.col("tf"), F.col("length"), F.lit(average))
    return slot.groupBy("query_id", "id").agg(F.round(F.tanh(F.sum(one) / SCALE), 9).alias("score"), F.count("*").alias("held"))


def search_all(found: Index, rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, id, score, how, rank``: for each row of ``query_id, query`` the ``k`` best of what ``keyword.search`` finds, equal scores by id; scores have nine digits.

    Words and phrases must all be held (``and``); a query for which no text does gets those that hold any of its words (``or``), and if still none those with the query as
    a substring (``like``). ``rows`` (``id, content``) is read for phrases and substrings only. The tables made on the way go at the end.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    with scratch(rows.sparkSession):
        asked = materialize(parsed(queries), "asked")
        slots = materialize(_slots(found, asked), "slots")
        terms = slots.select("term").union(asked.where("kind = 'without'").select("term")).where("term IS NOT NULL").distinct()
        terms = materialize(terms.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(found.buckets)).cast("int")).withColumn("no", F.monotonically_increasing_id()), "asked-terms")
        total = found.totals.first()
        blocks = 1 + (total.docs or 0) // BLOCK
        hits = join_small(found.postings, terms, ["bucket", "term"], "inner").select("no", "id", "tf", "length", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
        hits = materialize(hits, "hits")
        slots = materialize(slots.join(terms.select("term", "no"), "term", "left").select("query_id", "slot", "no"), "numbered-slots")
        plain = hits.groupBy("no").agg(F.count("*").alias("df")).join(terms, "no").select(F.col("term").alias("slot"), "df")
        wide = slots.where("endswith(slot, '*')").select("slot", "no").distinct().join(hits, "no").groupBy("slot").agg(F.count_distinct("id").alias("df"))
        idf = F.log(1 + (F.lit(total.docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        wanted = materialize(slots.groupBy("query_id").agg(F.count_distinct("slot").alias("slots")), "wanted")
        place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("slot"))
        weights = materialize(slots.withColumn("place", place).join(plain.unionByName(wide), "slot").select("query_id", F.col("place").alias("slot"), "no", idf.alias("idf")), "weights")
        bounds = hits.groupBy("no", "block").agg(F.max(_impact(F.col("tf"), F.col("length"), F.lit(total.average))).alias("most"))
        of_slot = weights.join(bounds, "no").groupBy("query_id", "block", "slot").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        bounds = of_slot.groupBy("query_id", "block").agg(F.tanh(F.sum("bound") / SCALE).alias("bound"), F.count("*").alias("held"))
        bounds = materialize(bounds.join(wanted, "query_id"), "bounds")
        without = materialize(asked.where("kind = 'without'").join(terms, "term").select("query_id", "no"), "without")
        gone = None if without.isEmpty() else materialize(join_small(hits, without, "no", "inner").select("query_id", "id").distinct(), "gone")
        phrases = asked.where("kind = 'phrase'").select("query_id", "term")
        phrases = None if phrases.isEmpty() else materialize(phrases, "phrases")

        def of_blocks(which: DataFrame, every: bool) -> DataFrame:
            out = _scored(hits, weights, which.select("query_id", "block"), total.average)
            if every:
                out = join_small(out, wanted, "query_id", "inner").where("held = slots")
                if phrases is not None:
                    out = out.join(_without_phrase(out, rows, phrases), ["query_id", "id"], "left_anti")
            out = out if gone is None else out.join(gone, ["query_id", "id"], "left_anti")
            return out.select("query_id", "id", "score")

        def top(open_: DataFrame, every: bool) -> DataFrame:
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
            first = materialize(open_.withColumn("place", place).where(F.col("place") <= FIRST), "first-blocks")
            some = materialize(of_blocks(first, every).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "first-scores")
            least = some.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            rest = open_.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left").where("least IS NULL OR bound >= least - 1e-9")
            both = some.drop("rank").unionByName(of_blocks(rest, every))
            return materialize(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "best")

        strict = top(bounds.where("held = slots"), True)
        loose = top(bounds.join(strict, "query_id", "left_anti"), False)
        unmet = queries.join(strict, "query_id", "left_anti").join(loose, "query_id", "left_anti").select("query_id", F.trim("query").alias("_q"))
        out = strict.withColumn("how", F.lit("and")).unionByName(loose.withColumn("how", F.lit("or")))
        unmet = materialize(unmet, "unmet")
        if not unmet.isEmpty():
            like = join_small(rows.select("id", "content"), unmet, F.contains("content", "_q"), "inner").select("query_id", "id", F.lit(0.05).alias("score"))
            out = out.unionByName(like.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumn("how", F.lit("like")))
        return materialize(out.select("query_id", "id", "score", "how", "rank"), "found", keep=True)


def _without_phrase(candidates: DataFrame, rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """``query_id, id`` of candidates that lack one of their query's phrases."""
    plain = F.concat(F.lit(" "), F.concat_ws(" ", F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda t: t != "")), F.lit(" "))
    met = candidates.select("query_id", "id").join(phrases, "query_id").join(rows.select("id", plain.alias("plain")), "id")
    return met.where(~F.contains("plain", F.concat(F.lit(" "), F.col("term"), F.lit(" ")))).select("query_id", "id").distinct()


def evaluate(results: DataFrame, rows: DataFrame, cases: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """How well results (``query_id, id, rank``) meet ``cases`` (``query_id, expected`` array, ``k``, ``min_hits``, ``min_precision``, ``max_noisy``); one row a case, found or not.

    A text is relevant if it holds any expected string, and noisy if it holds any of ``noise``, whatever the case of letters. ``query_id, hits, relevant, precision, reciprocal_rank,
    noisy_top3, passed``: precision is over ``k`` even if fewer are found; the reciprocal rank is that of the first relevant result, 0 if there is none.
    """
    low = F.lower("content")
    noisy = F.lit(False)
    for word in noise or []:
        noisy = noisy | F.contains(low, F.lit(word.lower()))
    met = results.select("query_id", "id", "rank").join(rows.select("id", "content"), "id").join(cases.select("query_id", "expected"), "query_id")
    judged = met.select("query_id", "rank", F.exists("expected", lambda x: (x != "") & F.contains(low, F.lower(x))).alias("good"), noisy.alias("noisy"))
    seen = judged.join(cases.select("query_id", "k"), "query_id").groupBy("query_id").agg(
        F.count("*").alias("hits"), F.count_if(F.col("good") & (F.col("rank") <= F.col("k"))).alias("relevant"), F.min(F.when(F.col("good"), F.col("rank"))).alias("at"), F.count_if(F.col("noisy") & (F.col("rank") <= 3)).alias("noisy_top3")
    )
    out = cases.join(seen, "query_id", "left").na.fill(0, ["hits", "relevant", "noisy_top3"])
    precision = F.col("relevant") / F.greatest(F.lit(1), F.col("k"))
    passed = (F.col("hits") >= F.col("min_hits")) & (F.col("noisy_top3") <= F.col("max_noisy")) & (precision >= F.col("min_precision"))
    return out.select("query_id", "hits", "relevant", F.round(precision, 6).alias("precision"), F.round(F.coalesce(1 / F.col("at"), F.lit(0.0)), 6).alias("reciprocal_rank"), "noisy_top3", passed.alias("passed"))


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: ``queries, passed, pass_rate, average_precision, mean_reciprocal_rank, noisy_top3``."""
    n = F.count("*")
    return evaluated.agg(n.alias("queries"), F.count_if("passed").alias("passed"), F.round(F.count_if("passed") / n, 6).alias("pass_rate"), F.round(F.avg("precision"), 6).alias("average_precision"), F.round(F.avg("reciprocal_rank"), 6).alias("mean_reciprocal_rank"), F.sum("noisy_top3").alias("noisy_top3"))
