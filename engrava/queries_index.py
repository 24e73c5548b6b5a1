"""Queries of batch search, its evaluation and stored indexes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.functions import text as T
from engrava.operators import batch_search, keyword, stored
from engrava.plans import views as V
from engrava.plans.storage import fresh_path
from engrava.registry import query

_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: length(t) >= 2)"


def _batch(memories: str, asked: str, k: int) -> str:
    """Views up to ``best``: of each query in ``asked`` (``query_id, term``, distinct) the ``k`` best of ``memories``, by BM25; all terms if any text has them, else any."""
    return f"""asked AS MATERIALIZED ({asked}),
words AS MATERIALIZED (SELECT id, {_WORDS.format('content')} AS w FROM {memories}),
stats AS (SELECT count(*) AS docs, avg(len(w)) AS average FROM words),
tf AS (SELECT id, any_value(len(w)) AS length, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT query_id, id, round(tanh(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) / 10), 9) AS score, count(*) = any_value(terms) AS whole
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN (SELECT query_id, count(*) AS terms FROM asked GROUP BY 1) USING (query_id) CROSS JOIN stats GROUP BY 1, 2),
moded AS (SELECT *, bool_or(whole) OVER (PARTITION BY query_id) AS strict FROM scored),
best AS (SELECT query_id, id, score, CASE WHEN strict THEN 'and' ELSE 'or' END AS how, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM moded WHERE whole OR NOT strict QUALIFY rank <= {k})"""


def _asked(words: int) -> str:
    return f"SELECT DISTINCT item_id AS query_id, unnest(list_slice({_WORDS.format('text')}, 1, {words})) AS term FROM benchmark"


def _queries(s, d, words: int):
    """Each benchmark item's first words, as a query."""
    return s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.slice(T.tokens(F.col("text")), 1, words)).alias("query"), "text")


@query("search_batch", "SELECT query_id, id, score, how, CAST(rank AS INTEGER) AS rank FROM best", _batch("memories", _asked(5), 10))
def _(s, d):
    rows = V.memories(s, d)
    return batch_search.search_all(keyword.index(rows, 16, 4), rows, _queries(s, d, 5), 10)


_JUDGED = """judged AS (SELECT query_id, rank, contains(lower(content), lower(text)) AS good, contains(content, '%%%') AS noisy FROM best JOIN memories USING (id) JOIN benchmark ON item_id = query_id),
evaluated AS (SELECT item_id AS query_id, count(rank) AS hits, count(*) FILTER (good AND rank <= 5) AS relevant, round(count(*) FILTER (good AND rank <= 5) / 5.0::DOUBLE, 6) AS precision,
  round(coalesce(1 / min(rank) FILTER (good), 0)::DOUBLE, 6) AS reciprocal_rank, count(*) FILTER (noisy AND rank <= 3) AS noisy_top3 FROM benchmark LEFT JOIN judged ON query_id = item_id GROUP BY 1)"""
_PASSED = "hits >= 1 AND noisy_top3 <= 1 AND precision >= 0.2"


def _evaluated(s, d):
    rows = V.memories(s, d)
    asked = _queries(s, d, 8)
    cases = asked.select("query_id", F.array("text").alias("expected"), F.lit(5).alias("k"), F.lit(1).alias("min_hits"), F.lit(0.2).alias("min_precision"), F.lit(1).alias("max_noisy"))
    found = batch_search.search_all(keyword.index(rows, 16, 4), rows, asked, 8)
    return batch_search.evaluate(found, rows, cases, ["%%%"])


@query("eval_search", f"SELECT *, {_PASSED} AS passed FROM evaluated", f"{_batch('memories', _asked(8), 8)}, {_JUDGED}")
def _(s, d):
    """Does a passage's beginning find the documents that hold the passage?"""
    return _evaluated(s, d)


@query("eval_summary", f"SELECT count(*) AS queries, count(*) FILTER ({_PASSED}) AS passed, round(count(*) FILTER ({_PASSED}) / count(*), 6) AS pass_rate, round(avg(precision), 6) AS average_precision, round(avg(reciprocal_rank), 6) AS mean_reciprocal_rank, CAST(sum(noisy_top3) AS BIGINT) AS noisy_top3 FROM evaluated", f"{_batch('memories', _asked(8), 8)}, {_JUDGED}")
def _(s, d):
    return batch_search.summary(_evaluated(s, d))


_KEPT = "kept AS (SELECT id, CASE WHEN id % 5 = 0 THEN content || ' appended words of a later version' ELSE content END AS content FROM memories WHERE id % 3 <> 0)"


@query("stored_search", "SELECT query_id, id, score, how, CAST(rank AS INTEGER) AS rank FROM best", f"{_KEPT}, {_batch('kept', _asked(4), 10)}")
def _(s, d):
    """An index that is appended to, updated and deleted from, and opened again."""
    rows = V.memories(s, d).select("id", "content")
    later = rows.where("id % 5 = 0").select("id", F.concat("content", F.lit(" appended words of a later version")).alias("content"))
    path = fresh_path(s, "stored-index")
    version = stored.append_keyword(stored.create_keyword(s, path), rows.where("id % 2 = 0"))
    version = stored.append_keyword(version, rows.where("id % 2 = 1"))
    stored.delete(stored.append_keyword(version, later), rows.where("id % 3 = 0").select("id"))
    return batch_search.search_all(stored.open_keyword(s, path), rows.where("id % 3 <> 0"), _queries(s, d, 4), 10)
