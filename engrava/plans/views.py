"""The model's tables over the star schema, and the same views for DuckDB.

Each view is one projection, so filters and column choices on it still reach the Parquet scan.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant at which ages are taken.
AS_OF = "2002-06-01 00:00:00"

_FACTS = """o_orderkey AS id, o_orderkey % 1000 AS memory_id, o_custkey AS entity_id, c_name AS subject, o_orderpriority AS predicate, o_orderstatus AS object,
 CASE o_orderkey % 5 WHEN 0 THEN 'kv' WHEN 1 THEN 'decision' WHEN 2 THEN 'preference' WHEN 3 THEN 'state' ELSE 'relationship' END AS fact_type,
 least(1.0, o_totalprice / 400000.0) AS confidence, CASE o_orderstatus WHEN 'F' THEN 0.001 WHEN 'O' THEN 0.01 ELSE 0.0005 END AS decay_rate,
 o_orderdate AS created_at, CASE WHEN o_orderkey % 11 = 0 THEN 'retired' WHEN o_orderkey % 7 = 0 THEN 'core' ELSE 'active' END AS state,
 CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1 END AS superseded_by, CASE o_orderkey % 4 WHEN 0 THEN '' ELSE concat('agent', CAST(o_orderkey % 4 AS {s})) END AS agent_id, c_mktsegment AS project_id"""
_MEMORIES = """doc_id AS id, text AS content, concat('notes/', source, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.JSON' WHEN 2 THEN '.csv' ELSE '' END) AS source_file, lang AS project,
 CASE doc_id % 6 WHEN 0 THEN 'rule' WHEN 1 THEN 'decision' WHEN 2 THEN 'preference' WHEN 3 THEN 'identity' WHEN 4 THEN 'status' ELSE 'scratch' END AS memory_class"""
_ACCESSES = """event_id AS id, event_id % 1500 AS fact_id, concat('agent', CAST(user_id % 5 AS {s})) AS agent_id,
 CASE event_type WHEN 'click' THEN 'reinforce' WHEN 'view' THEN 'search' WHEN 'purchase' THEN 'import' ELSE 'reference' END AS access_type, ts AS created_at, event_type AS fix_pattern, props"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, content, source_file, project, memory_class, imported_at``."""
    rows = _table(spark, sf_dir, "documents")
    return rows.select(*_split(_MEMORIES), F.expr("timestampadd(HOUR, cast(doc_id % 720 as int), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("imported_at"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject, predicate and object with confidence, decay, state and scope."""
    orders, customer = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(*_split(_FACTS.format(s="STRING")))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log of who used which fact."""
    return _table(spark, sf_dir, "events").select(*_split(_ACCESSES.format(s="STRING")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"), "label")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations")


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fact_id_a < fact_id_b, count``: parts on one order, for pairs met twice or more."""
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("fact_id")).transform(pair_counts).where("count >= 2")


#: Rows that one task joins or counts: the partitions grow with the rows, so a task's memory doesn't.
TASK_ROWS = 1_000_000


def pair_counts(batches: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Unordered pairs of ids that share a batch, counted; an id that a batch repeats counts once. A batch is a bounded list of ids (at most 50 by contract), so its pairs are, too.

    Rows and pairs are counted first, and dealt over so many partitions that none has many more than ``task_rows``.
    """
    n = F.col("n").cast("double")
    rows, pairs = batches.groupBy("batch").agg(F.count("*").alias("n")).agg(F.sum(n), F.sum(n * (n - 1) / 2)).first()
    least = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda k: max(least, math.ceil((k or 0) / task_rows))
    dealt = batches.select("batch", "fact_id").repartition(parts(rows), "batch").distinct()
    a, b = dealt.toDF("batch", "fact_id_a"), dealt.toDF("batch", "fact_id_b")
    met = a.join(b, "batch").where("fact_id_a < fact_id_b").select("fact_id_a", "fact_id_b")
    return met.repartition(parts(pairs), "fact_id_a", "fact_id_b").groupBy("fact_id_a", "fact_id_b").agg(F.count("*").alias("count"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_fact_id, target_fact_id, edge_type, confidence`` from pairs of the co-occurrence table."""
    c = cooccurrence(spark, sf_dir)
    return c.select(F.col("fact_id_a").alias("source_fact_id"), F.col("fact_id_b").alias("target_fact_id"), F.expr("CASE (fact_id_a + fact_id_b) % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'relates_to' ELSE 'contradicts' END").alias("edge_type"), F.least(F.lit(0.9), 0.3 + 0.1 * (F.col("fact_id_a") % 6)).alias("confidence"))


def _split(text: str) -> list:
    """Column expressions of a select list; commas inside parentheses stay."""
    parts, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(text[at:k])
            at = k + 1
    return [F.expr(p.strip()) for p in [*parts, text[at:]]]


#: The views as common table expressions for DuckDB, to be put before a query.
SQL_VIEWS = f"""
memories AS (SELECT {_MEMORIES}, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 720) AS imported_at FROM documents),
facts AS (SELECT {_FACTS.format(s="VARCHAR")} FROM orders JOIN customer ON o_custkey = c_custkey),
accesses AS (SELECT {_ACCESSES.format(s="VARCHAR")} FROM events),
vectors AS (SELECT vec_id AS memory_id, embedding AS vector, label FROM embeddings),
batches AS MATERIALIZED (SELECT DISTINCT l_orderkey AS batch, l_partkey AS fact_id FROM lineitem),
cooccurrence AS MATERIALIZED (SELECT a.fact_id AS fact_id_a, b.fact_id AS fact_id_b, count(*) AS count FROM batches a JOIN batches b ON a.batch = b.batch AND a.fact_id < b.fact_id GROUP BY 1, 2 HAVING count(*) >= 2),
edges AS MATERIALIZED (SELECT fact_id_a AS source_fact_id, fact_id_b AS target_fact_id, CASE (fact_id_a + fact_id_b) % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'relates_to' ELSE 'contradicts' END AS edge_type, least(0.9, 0.3 + 0.1 * (fact_id_a % 6)) AS confidence FROM cooccurrence)
"""


def sql(query: str, extra: str = "") -> str:
    """A DuckDB query over the views; ``extra`` has further expressions. One with a list of columns may refer to itself."""
    recursive = "RECURSIVE " if re.search(r"\w+\([\w, ]+\) AS \(", extra) else ""
    return f"WITH {recursive}{SQL_VIEWS.strip()}{', ' + extra.strip() if extra else ''}\n{query.strip()}"
