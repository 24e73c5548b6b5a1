"""Keyword, vector and fused retrieval, and the multipliers of the ranking pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.plans import ranks
from engrava.plans.storage import join_small, materialize

#: What each memory class multiplies a score by, and each tier of source.
CLASS_BOOST = {"rule": 1.30, "decision": 1.25, "preference": 1.20, "identity": 1.15, "status": 1.0, "scratch": 0.90}
K1, B = 1.2, 0.75


def bm25(rows: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """``id, score`` of memories that hold a query term: Okapi BM25 over lower-case tokens, scaled by tanh to 0..1.

    Without an index (``keyword.index`` has one): texts are read once, their tokens counted by pattern where they lie, and only these counts are kept for the statistics, one row, and the scores.
    """
    terms = sorted({t for t in query.lower().split() if len(t) > 1})
    low = F.lower("content")
    length = F.regexp_count(low, F.lit("[a-z0-9]{2,}")).alias("len")
    counted = rows.select("id", length, *[F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")).alias(f"tf{k}") for k, t in enumerate(terms)])
    counted = materialize(counted, "bm25")
    stats = counted.agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"), *[F.count(F.when(F.col(f"tf{k}") > 0, 1)).alias(f"df{k}") for k in range(len(terms))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = joined.select("id", score.alias("raw")).where("raw > 0").select("id", F.round(F.tanh(F.col("raw") / 10), 6).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def cosine_top(vectors: DataFrame, query_id: int, k: int = 10, least: float = 0.0) -> DataFrame:
    """The ``k`` vectors closest to one of the table's own, by exact cosine; equal scores by id."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    query = vectors.where(F.col("memory_id") == query_id).select(F.col("vector").alias("q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(query)).select("memory_id", (dot(F.col("vector"), F.col("q")) / F.sqrt(dot(F.col("vector"), F.col("vector")) * dot(F.col("q"), F.col("q")))).alias("cosine"))
    return scored.where(F.col("cosine") >= least).withColumn("cosine", F.round("cosine", 6)).orderBy(F.desc("cosine"), "memory_id").limit(k)


def rank_fusion(channels: list[tuple[DataFrame, float]], k: int = 60, most: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ``(id, score)`` rankings: the sum of weight over k + rank; who is missing from a channel ranks after its last.

    A channel is a list of results, of its ``most`` best if that is given. Each is made once, and what is fused are these lists.
    """
    parts, fused = [], None
    for rows, _ in channels:
        rows = rows.select("id", "score")
        top = ranks.numbered(rows.orderBy(F.desc("score"), "id").limit(most) if most else rows, "rank", [F.desc("score"), F.col("id")])
        parts.append(top.select("id", (F.col("rank") + 1).alias("rank")))
        fused = parts[-1].select("id") if fused is None else fused.union(parts[-1].select("id"))
    fused, total = fused.distinct(), F.lit(0.0)
    for n, p in enumerate(parts):
        size = p.agg((F.count("*") + 1).alias(f"last{n}"))
        fused = fused.join(p.select("id", F.col("rank").alias(f"rank{n}")), "id", "left").crossJoin(F.broadcast(size))
        total = total + F.lit(channels[n][1]) / (k + F.coalesce(f"rank{n}", f"last{n}"))
    return fused.select("id", F.round(total, 8).alias("score"))


def min_max(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores scaled to 0..1 within the result; all equal gives 1."""
    span = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(1.0))
    return rows.crossJoin(F.broadcast(span)).withColumn(score, F.round(scaled, 6)).drop("lo", "hi")


def weighted_fusion(keyword: DataFrame, semantic: DataFrame, keyword_weight: float = 0.3) -> DataFrame:
    """0.3 of the scaled keyword score and 0.7 of the scaled semantic one; missing counts 0."""
    a, b = min_max(keyword).withColumnRenamed("score", "a"), min_max(semantic).withColumnRenamed("score", "b")
    total = keyword_weight * F.coalesce("a", F.lit(0.0)) + (1 - keyword_weight) * F.coalesce("b", F.lit(0.0))
    return a.join(b, "id", "full").select("id", F.round(total, 8).alias("score"))


def class_boost(memory_class: Column) -> Column:
    out = F.lit(1.0)
    for name, boost in CLASS_BOOST.items():
        out = F.when(memory_class == name, boost).otherwise(out)
    return out


def recency_boost(at: Column, as_of: Column) -> Column:
    """1.10 for the day of ``as_of`` and later, 1.05 after the same hour of midnight a week before, 1.02 after that of the same day of the month before (which runs on into the next
    month where it has no such day), else 1; 1 for a null time."""
    today = F.date_trunc("day", as_of)
    month = F.date_add(F.trunc(F.add_months(today, -1), "month"), F.dayofmonth(today) - 1)
    return F.when(at >= today, 1.10).when(at > F.date_sub(today, 7).cast("timestamp_ntz"), 1.05).when(at > month.cast("timestamp_ntz"), 1.02).otherwise(1.0)


def memory_confidence(facts: DataFrame) -> DataFrame:
    """For each memory the mean confidence and mean effective confidence of its active facts (with ``effective``)."""
    return facts.groupBy("memory_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("effective"), 6).alias("effective"))


def budget_prefix(ranked: DataFrame, budget: int, by: str = "query_id") -> DataFrame:
    """The longest prefix of each query's ranked list whose tokens stay within the budget; one list if there is no such column."""
    lists = Window.partitionBy(by) if by in ranked.columns else Window.partitionBy(F.lit(1))
    used = F.sum("tokens").over(lists.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", used).where(F.col("used") <= budget)


def watch_score(content: Column, query: Column) -> Column:
    """0 to 1: the share of a query's terms that a text holds as substrings, up to 1.5 times that for repeats, and 0.2 if it holds the whole query."""
    text, phrase = F.lower(content), F.lower(query)
    terms = F.filter(F.split(phrase, r"\s+"), lambda t: t != "")
    hits = F.transform(terms, lambda t: F.floor((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)))
    held, extra = F.size(F.filter(hits, lambda n: n > 0)), F.aggregate(hits, F.lit(0).cast("long"), lambda a, n: a + n) - F.size(terms)
    share = held / F.size(terms) * F.least(F.lit(1.5), 1 + 0.1 * F.greatest(extra, F.lit(0)))
    return F.when(held > 0, F.least(F.lit(1.0), share + F.when(F.contains(text, phrase), 0.2).otherwise(0.0))).otherwise(0.0)


def _grams(letters: str, n: int) -> Column:
    """All runs of ``n`` letters of a text whose letters are a column: an expression there would be worked out anew for every run."""
    at = F.sequence(F.lit(0), F.size(letters) - n)
    return F.when(F.size(letters) >= n, F.transform(at, lambda k: F.concat(*[F.get(letters, k + i) for i in range(n)]))).otherwise(F.array().cast("array<string>"))


def watch_index(watches: DataFrame, threshold: float, texts: DataFrame | None = None) -> DataFrame:
    """``watch_id, query, gram``: runs of up to three letters of which a text must hold one to meet a watch (``watch_id, query``) by ``threshold``.

    A text that meets it holds so many of its terms that it holds one of any few of them; of these, the rarest, each is told by its rarest run. How rare runs are is told by the
    watches, and by ``texts`` (``content``) if they are given, one in 64; whatever they say, nothing is missed.
    """
    if threshold <= 0:
        raise ValueError("every text meets every watch")
    terms = F.filter(F.split(F.lower("query"), r"\s+"), lambda t: t != "")
    each = watches.select("watch_id", "query", terms.alias("terms")).where(F.size("terms") > 0)
    least = F.greatest(F.lit(1), F.ceil((threshold - 0.2 - 1e-6) / 1.5 * F.size("terms")))
    each = each.select("watch_id", "query", (F.size("terms") - least + 1).alias("keep"), F.posexplode("terms").alias("at", "term"))
    letters = F.filter(F.split("term", ""), lambda c: c != "")
    size = F.least(F.lit(3), F.size("letters"))
    grams = each.withColumn("letters", letters).withColumn("grams", F.when(size == 3, _grams("letters", 3)).when(size == 2, _grams("letters", 2)).otherwise(F.col("letters")))
    grams = materialize(grams.select("watch_id", "query", "keep", "at", F.explode(F.array_distinct("grams")).alias("gram")), "watch-grams")
    seen = grams.groupBy("gram").agg(F.count("*").alias("n"))
    if texts is not None:
        some = _text_grams(texts.where(F.pmod(F.xxhash64("content"), F.lit(64)) == 0).select(F.lit(0).alias("id"), "content"), [1, 2, 3]).select("gram")
        seen = seen.select("gram", F.lit(0).alias("n")).unionByName(join_small(some, grams.select("gram").distinct(), "gram", "left_semi").withColumn("n", F.lit(1))).groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = grams.join(seen, "gram").groupBy("watch_id", "query", "keep", "at").agg(F.min(F.struct("n", F.negative(F.length("gram")).alias("short"), "gram")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("watch_id").orderBy("best", "at"))
    return rarest.withColumn("rank", rank).where(F.col("rank") <= F.col("keep")).select("watch_id", "query", F.col("best.gram").alias("gram")).distinct()


def _text_grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``id, gram``: the distinct runs of letters of each text (``id, content``), of some sizes."""
    letters = rows.select("id", F.filter(F.split(F.lower("content"), ""), lambda c: c != "").alias("letters"))
    return letters.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[_grams("letters", n) for n in sizes])))).alias("gram"))


#: Runs of letters that a text is searched for one by one.
FEW_RUNS = 256


def watch_matches(rows: DataFrame, watches: DataFrame | list[tuple[int, str]], threshold: float) -> DataFrame:
    """``watch_id, id, score``: which standing queries (``watch_id, query``) each new memory (``id, content``) meets.

    A memory is held against those watches only of which it has a rare run of letters (``watch_index``). Up to ``FEW_RUNS`` of these are looked for in the text one by one; beyond it
    the text's own runs are joined with them, broadcast if they are small.
    """
    spark = rows.sparkSession
    table = watches if isinstance(watches, DataFrame) else spark.createDataFrame(watches, "watch_id long, query string")
    index = materialize(watch_index(table, threshold, rows), "watch-index")
    few = [r.gram for r in index.select("gram").distinct().limit(FEW_RUNS + 1).collect()]
    if not few:
        return spark.createDataFrame([], "watch_id long, id long, score double")
    if len(few) <= FEW_RUNS:
        low = rows.select("id", F.lower("content").alias("low"))
        held = low.select("id", F.explode(F.filter(F.array(*map(F.lit, sorted(few))), lambda g: F.contains(F.col("low"), g))).alias("gram"))
    else:
        sizes = sorted(r.n for r in index.select(F.length("gram").alias("n")).distinct().collect())  # 1, 2, 3
        held = _text_grams(rows.select("id", "content"), sizes)
    met = join_small(held, index.select("gram", "watch_id"), "gram", "inner").select("id", "watch_id").distinct()
    scored = met.join(rows.select("id", "content"), "id").join(table.select("watch_id", "query"), "watch_id")
    return scored.select("watch_id", "id", F.round(watch_score(F.col("content"), F.col("query")), 6).alias("score")).where(F.col("score") >= threshold)
