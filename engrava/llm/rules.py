"""Quality rules, by document and by host.

Each document is held against fixed rules on its whole text: base rules, which it must pass, and soft ones. Failures of either are added up
by host, and hosts' failure rates are shrunk towards all hosts' with a beta prior fitted to them. A host's verdict rests on its posterior: its shrunk rate, and the
probability ``worse`` that its rate is over the pooled one (the posterior's tail, in the logistic form of the normal one).

- A host is condemned if its rate is over ``HOST_RATE`` and it is worse with a probability of ``SURE``: all its documents go.
- Else its documents must pass the soft rules as strictly as the host calls for: their limits are multiplied by ``LEEWAY`` to the power 1 - 2 ``worse``, so that documents of the
  worst hosts must keep to 4/5 of the limits, those of the best to 5/4, and those of hosts like all others to the limits themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.llm.workers import tidied
from engrava.plans.storage import join_small, materialize

HOST_RATE, SURE, LEEWAY = 0.5, 0.95, 1.25
#: Hosts are never taken to be more alike than this part of the variance of a rate; 1.702 makes the logistic curve that of the normal distribution.
ALIKE, LOGISTIC = 1e-3, 1.702
_words = re.compile("[^\x20\x09-\x0d]+").findall
_word = re.compile("[^\x20\x09-\x0d]").search
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more, the first time included."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    order = np.argsort(windows := pairs[:-1] * len(number) + ids[2:], kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(order), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one text; of null all 0."""
    if not text:
        return 0, 0, 0, 0, 0
    words, lines = _words(text), text.split("\n")
    dup = 0
    if len(lines) > 1 and len(distinct := set(lines)) < len(lines):
        wordy = {x for x in distinct if _word(x)}
        dup = sum(x in wordy for x in lines) - len(wordy)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, repeat_words(words)


def text_counts(text: Column) -> Column:
    """``COUNTS`` of a text column as a struct of longs."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in tidied(batches):
            yield pd.DataFrame(np.array([measure(t) for t in texts], np.int64).reshape(-1, len(COUNTS)), columns=list(COUNTS))

    return count(text)


#: The base rules, and the soft ones.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
SOFT_FAILED = "10 * n_symbols > {0} * n_words OR 2 * n_dup_lines > {0} * n_words OR word_chars > 12 * {0} * n_words OR word_chars * {0} < 2 * n_words"


def host_rates(counted: DataFrame, host: str = "host") -> DataFrame:
    """``host, n_docs, n_failed, rate, worse, factor, condemned`` of rows with a boolean ``failed``; ``rate`` is the posterior mean under a beta prior with the hosts'
    pooled mean and, from the moments of the beta-binomial, their spread; ``factor`` is what the limits of the soft rules are multiplied by. A null host is one host."""
    hosts = materialize(counted.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.count("*").alias("h"), (F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("sq"), F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("sk"))
    spread = F.expr("(sk - n * m * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (n - sq / n - (h - 1)))")
    rho = F.least(F.greatest(F.coalesce(F.when(F.expr("m > 0 and m < 1 and n - sq / n > h - 1"), spread), F.lit(ALIKE)), F.lit(ALIKE)), F.lit(0.999))
    prior = total.select("m", (1 / rho - 1).alias("weight"))  # one row
    rated = hosts.crossJoin(F.broadcast(prior)).select(host, "n_docs", "n_failed", "m", "weight", F.expr("(n_failed + weight * m) / (n_docs + weight)").alias("rate"))
    worse = F.expr(f"CASE WHEN rate > 0 AND rate < 1 THEN 1 / (1 + exp(-{LOGISTIC}D * (rate - m) / sqrt(rate * (1 - rate) / (n_docs + weight + 1)))) ELSE 0.5D END")
    rated = rated.withColumn("worse", F.round(worse, 9))
    return rated.select(host, "n_docs", "n_failed", "rate", "worse", F.expr(f"pow({LEEWAY}D, 1 - 2 * worse)").alias("factor"), F.expr(f"rate > {HOST_RATE}D AND worse >= {SURE}D").alias("condemned"))


def judge_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, soft_failed, host, host_rate, host_worse, host_condemned, kept``, one row per row.

    Texts are read once, where they lie; only counts are shuffled, added up by host before. Null and empty texts have no words and fail;
    texts of any length are read whole; an empty table gives no rows; extra columns are ignored. ``soft_failed`` is by the limits that the host calls for.
    """
    c = docs.select("doc_id", F.col(host).alias("host"), text_counts(F.col("text")).alias("c")).select("doc_id", "host", *(f"c.{x}" for x in COUNTS))
    counted = materialize(c.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("soft_failed", F.expr(SOFT_FAILED.format("1"))).withColumn("failed", F.expr("base_failed OR soft_failed")), "counted")
    rates = materialize(host_rates(counted).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), F.col("worse").alias("host_worse"), "factor", F.col("condemned").alias("host_condemned")), "rates")
    judged = join_small(counted, rates, F.col("host").eqNullSafe(F.col("_host")))
    judged = judged.withColumn("soft_failed", F.expr(SOFT_FAILED.format("factor")))
    kept = F.expr("NOT base_failed AND NOT host_condemned AND NOT soft_failed")
    return judged.select("doc_id", *COUNTS, "base_failed", "soft_failed", "host", "host_rate", "host_worse", "host_condemned", kept.alias("kept"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    judged = judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


OP9_SQL = r"""
WITH words AS (SELECT doc_id, source, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, unnest(range(1, greatest(len(w) - 1, 1))) AS t(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
counted AS (SELECT words.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
soft AS (SELECT *, 10 * n_symbols > n_words OR 2 * n_dup_lines > n_words OR word_chars > 12 * n_words OR word_chars < 2 * n_words AS soft_failed FROM judged),
failing AS (SELECT *, base_failed OR soft_failed AS failed FROM soft),
hosts AS (SELECT source, count(*) AS n, sum(CAST(failed AS INT)) AS k FROM failing GROUP BY source),
total AS (SELECT sum(n) AS n, count(*) AS h, sum(k) / sum(n) AS m, sum(n::DOUBLE * n) AS sq, sum(k::DOUBLE * k / n) AS sk FROM hosts),
prior AS (SELECT m, 1 / least(greatest(coalesce(CASE WHEN m > 0 AND m < 1 AND n - sq / n > h - 1 THEN (sk - n * m * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (n - sq / n - (h - 1))) END, 1e-3), 1e-3), 0.999) - 1 AS weight FROM total),
rated AS (SELECT source, n, m, weight, (k + weight * m) / (n + weight) AS rate FROM hosts CROSS JOIN prior),
tails AS (SELECT source, rate, round(CASE WHEN rate > 0 AND rate < 1 THEN 1 / (1 + exp(-1.702 * (rate - m) / sqrt(rate * (1 - rate) / (n + weight + 1)))) ELSE 0.5 END, 9) AS worse FROM rated),
limits AS (SELECT source, rate, worse, pow(1.25::DOUBLE, 1 - 2 * worse) AS f FROM tails)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (rate > 0.5 AND worse >= 0.95) AND NOT (10 * n_symbols > f * n_words OR 2 * n_dup_lines > f * n_words OR word_chars > 12 * f * n_words OR word_chars * f < 2 * n_words) AS kept
FROM failing JOIN limits ON failing.source IS NOT DISTINCT FROM limits.source
"""
