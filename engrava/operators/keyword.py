"""Keyword search over postings: AND, OR, NOT, phrases and prefixes, with BM25 scores.

``index`` writes one row for each term of each text, bucketed by a hash of the term, with the text's length; a query reads its terms' buckets only, and the texts
themselves only for phrases and for the substring search that follows when no term is found.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from engrava.functions import text as T
from engrava.plans.storage import fresh_path, materialize

#: Fixed values of BM25, and what scales its sum to 0..1.
K1, B, SCALE = 1.2, 0.75, 10.0


class Index(NamedTuple):
    """``postings`` (``bucket, term, id, tf, length``), ``totals``: one row ``docs, average``, and the number of buckets."""

    postings: DataFrame
    totals: DataFrame
    buckets: int


class Query(NamedTuple):
    must: list[str]
    phrases: list[str]
    without: list[str]
    prefixes: list[str]


def parse(query: str) -> Query:
    """Words, ``"phrases"``, ``NOT word`` or ``-word``, and ``prefix*``; all else that is neither letter nor digit separates."""
    phrases = [" ".join(re.findall("[a-z0-9]+", p)) for p in re.findall('"([^"]*)"', query.lower())]
    rest = re.sub('"[^"]*"', " ", query)
    without, prefixes, must, negate = [], [], [], False
    for raw in rest.split():
        if raw == "NOT":
            negate = True
            continue
        if raw in ("AND", "OR"):
            continue
        words = re.findall("[a-z0-9]+", raw.lower())
        if negate or raw.startswith("-"):
            without += words
        elif raw.endswith("*") and words:
            must, prefixes = must + words[:-1], [*prefixes, words[-1]]
        else:
            must += words
        negate = False
    return Query(list(dict.fromkeys(w for w in must if len(w) > 1)), [p for p in phrases if p], list(dict.fromkeys(without)), list(dict.fromkeys(prefixes)))


#: Texts for each bucket of terms, and the most buckets.
TEXTS, BUCKETS = 20_000, 1024


def buckets_for(texts: int) -> int:
    """A power of two that grows with the corpus, 16 at least."""
    return min(BUCKETS, max(16, 1 << math.ceil(math.log2(max(1, texts / TEXTS)))))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def postings_of(words: DataFrame, buckets: int, files: int) -> DataFrame:
    """``id, term, length, tf, bucket`` of ``id, w`` (tokens), each bucket in ``files`` parts.

    There is one shuffle, of a row for each text and bucket: the tokens that fall there as one string. They are counted where they arrive.
    """
    sorted_ = F.sort_array(F.transform("w", lambda t: F.struct(bucket_of(t, buckets).alias("b"), t.alias("t"))))
    texts = words.where("size(w) > 0").select("id", F.size("w").alias("length"), sorted_.alias("s"))
    texts = texts.withColumn("starts", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 OR get(s, i).b <> get(s, i - 1).b)"))
    piece = F.expr("transform(starts, (a, k) -> struct(get(s, a).b AS bucket, array_join(transform(slice(s, a + 1, coalesce(get(starts, k + 1), size(s)) - a), x -> x.t), ' ') AS terms))")
    pieces = texts.select("id", "length", F.explode(piece).alias("x")).select("id", "length", "x.bucket", F.pmod(F.xxhash64("id"), F.lit(files)).alias("part"), "x.terms")
    one = pieces.repartition("bucket", "part").select("bucket", "part", "id", "length", F.explode(F.split("terms", " ")).alias("term"))
    counted = one.groupBy("bucket", "part", "id", "length", "term").agg(F.count("*").alias("tf"))  # dealt so already
    return counted.select("id", "term", "length", "tf", "bucket")


def index(rows: DataFrame, buckets: int | None = None, files: int | None = None) -> Index:
    """Postings of ``id, content``. A text's tokens are made once; its postings are written in folders by bucket, each in as many
    files, so that a term of a third of all texts is no task's alone. Both numbers grow with the corpus unless they are given."""
    spark = rows.sparkSession
    buckets = buckets or buckets_for(rows.count())
    files = files or buckets
    counted = postings_of(rows.select("id", T.tokens(F.col("content")).alias("w")), buckets, files)
    path = fresh_path(spark, "postings")
    counted.write.partitionBy("bucket").parquet(path)
    schema = counted.select("id", "term", "length", "tf").schema.add("bucket", IntegerType())
    postings = spark.read.schema(schema).parquet(path)
    sizes = fresh_path(spark, "postings-totals")
    docs = rows.agg(F.count("*").alias("docs"))  # texts aren't split again: their lengths are the sums of their terms
    postings.agg(F.sum("tf").alias("words")).crossJoin(F.broadcast(docs)).select("docs", F.when(F.col("docs") > 0, F.coalesce("words", F.lit(0)) / F.col("docs")).alias("average")).write.parquet(sizes)
    return Index(postings, spark.read.schema("docs long, average double").parquet(sizes), buckets)


def _scores(found: Index, terms: list[str], prefixes: list[str]) -> DataFrame:
    """``id, score, terms``: the sum of BM25 over query terms, and how many of them a text holds; a prefix is one term, held as often as all that begin with it."""
    p = found.postings
    rows = _holding(found, terms).select("id", "length", "term", "tf") if terms else None
    for x in prefixes:
        of = p.where(F.startswith("term", F.lit(x))).groupBy("id", "length").agg(F.sum("tf").alias("tf")).select("id", "length", F.lit(f"{x}*").alias("term"), "tf")
        rows = of if rows is None else rows.unionByName(of)
    rows = materialize(rows, "keyword-hits")
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    n = F.broadcast(df.crossJoin(F.broadcast(found.totals)))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    one = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return rows.join(n, "term").groupBy("id").agg(F.tanh(F.sum(one) / SCALE).alias("score"), F.count("*").alias("terms"))


def _holding(found: Index, terms: list[str]) -> DataFrame:
    """Postings of some terms: only their buckets are read."""
    of = sorted({zlib.crc32(t.encode()) % found.buckets for t in terms})
    return found.postings.where(F.col("bucket").isin(of) & F.col("term").isin(terms))


def search(found: Index, rows: DataFrame, query: str, least: float = 0.0) -> DataFrame:
    """``id, score, how``: texts that hold every term, phrase and prefix of a query and none that it excludes (``and``); if there is none, those that hold any of its words
    (``or``); if still none, those with the query as a substring (``like``, at 0.05). Scores below ``least`` go.

    One row tells which of the three applies, so the choice is part of the plan. ``rows`` (``id, content``) is read for phrases and substrings only.
    """
    q = parse(query)
    words = list(dict.fromkeys([*q.must, *(w for p in q.phrases for w in p.split() if len(w) > 1)]))
    like = rows.where(F.contains(F.col("content"), F.lit(query.strip()))).select("id", F.lit(0.05).alias("score"), F.lit("like").alias("how"))
    if not words and not q.prefixes:
        return like.where(F.col("score") >= least)
    scored = _scores(found, words, q.prefixes)
    held = F.col("terms") == len(words) + len(q.prefixes)
    if q.phrases:
        plain = F.concat(F.lit(" "), F.concat_ws(" ", F.filter(F.split(F.lower("content"), "[^a-z0-9]+"), lambda t: t != "")), F.lit(" "))
        whole = F.lit(True)
        for p in q.phrases:
            whole = whole & F.contains(plain, F.lit(f" {p} "))
        scored = scored.join(rows.where(whole).select("id", F.lit(True).alias("_whole")).distinct(), "id", "left")
        held = held & F.col("_whole").isNotNull()
    if q.without:
        gone = _holding(found, q.without).select("id").distinct()
        scored = scored.join(gone, "id", "left_anti")
    both = materialize(scored.select("id", "score", F.when(held, "and").otherwise("or").alias("how")), "keyword-found")
    best = both.agg(F.min("how").alias("_best"))  # 'and' comes before 'or'; null if nothing is found
    out = both.crossJoin(F.broadcast(best)).where("how = _best").select("id", "score", "how")
    return out.unionByName(like.crossJoin(F.broadcast(best.where("_best IS NULL"))).select("id", "score", "how")).where(F.col("score") >= least)
