"""Import: front matter, nested values as flat pairs, and the learned gate that keeps or drops what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text's path, length, lines and words add to it as words of their own.
PATTERNS = {
    "meta_low_signal_ack": r"(?i)\b(?:got it|sounds good|thank you|thanks!|okay|ok|cool|awesome|roger|copy that|noted)\b",
    "meta_ops_keyword": r"(?i)\b(?:gateway|restart|status|import|search|test|build|push|pull|deploy|alert|maintenance|db_size_high)\b",
    "meta_endpoint_or_config": r"(?i)(?:/[a-z0-9._~!$&'()*+,;=:@%/-]+|[A-Z_]{3,}=)",
}
POSITIVE_PATH = r"(?i)(readme|memory|decision|rule|prd|docs/|design|spec|architecture|roadmap)"
NEGATIVE_PATH = r"(?i)(/logs?/|/tmp/|/cache/|/node_modules/|/target/|\.log$|\.tmp$|\.out$)"


def front_matter(content: Column) -> Column:
    """``struct<metadata: map, body: string>``: the ``key: value`` lines between a first line ``---`` and the next, of equal keys the last, and what follows; without them the whole text."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    head = F.regexp_extract(text, r"(?s)^---(.*?)\n---", 1)
    has = text.rlike(r"(?s)^---.*?\n---")
    lines = F.filter(F.transform(F.split(head, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[^:]*[^:\s][^:]*:.*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    made = F.map_from_entries(last)
    body = F.regexp_replace(text, r"(?s)^---.*?\n---", "")
    return F.struct(F.when(has, made).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"), F.when(has, body).otherwise(content).alias("body"))


def flatten(rows: DataFrame, value: str = "value", deepest: int = 32) -> DataFrame:
    """``id, path, value`` of every leaf of JSON texts (``id`` and ``value``): keys joined by dots, places in arrays as ``[0]``; null is ``null``. What isn't JSON gives no rows.

    Each round opens one level of objects and arrays with the engine's own variant functions; rounds stop when none is left, or at ``deepest`` levels, below which a value stays as text.
    """
    open_ = rows.select("id", F.lit("").alias("path"), F.try_parse_json(F.col(value)).alias("v")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    out = None
    for level in range(deepest):
        marked = open_.withColumn("kind", kind)
        leaf = marked.where("NOT (kind LIKE 'OBJECT<%' OR kind LIKE 'ARRAY<%')").select("id", "path", F.when(F.col("kind") == "VOID", "null").otherwise(F.col("v").cast("string")).alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        deeper = marked.where("kind LIKE 'OBJECT<%' OR kind LIKE 'ARRAY<%'").select("id", "path", "v")
        if deeper.isEmpty():
            return out
        name = "CASE WHEN e.key IS NULL THEN concat(path, '[', e.pos, ']') WHEN path = '' THEN e.key ELSE concat(path, '.', e.key) END"
        open_ = rows.sparkSession.sql(f"SELECT id, {name} AS path, e.value AS v FROM {{deeper}}, LATERAL variant_explode(v) AS e", deeper=deeper)
    return out.unionByName(open_.select("id", "path", F.to_json("v").alias("value")))


def augmented(content: Column, path: Column, section: Column, memory_class: Column) -> Column:
    """A text with what is known about it as words before it; empty texts stay empty."""
    text, p = F.trim(content), F.lower(F.trim(path))
    size, lines = F.octet_length(text), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    word = lambda name, when: F.when(when, name)
    kind = F.regexp_replace(F.lower(F.trim(memory_class)), "[^a-z0-9_]+", "_")
    words = [
        word("meta_has_source_section", F.trim(section) != ""), word("meta_path_positive", p.rlike(POSITIVE_PATH)), word("meta_path_negative", p.rlike(NEGATIVE_PATH)),
        F.when(kind != "", F.concat(F.lit("meta_memory_class_"), kind)), F.when(size < 20, "meta_len_tiny").when(size < 120, "meta_len_short").when(size <= 4000, "meta_len_medium").otherwise("meta_len_long"),
        word("meta_multiline", lines >= 3), word("meta_low_signal_ack", (size < 140) & text.rlike(PATTERNS["meta_low_signal_ack"])), word("meta_ops_keyword", text.rlike(PATTERNS["meta_ops_keyword"])),
        word("meta_endpoint_or_config", text.rlike(PATTERNS["meta_endpoint_or_config"])),
    ]
    return F.when(text == "", text).otherwise(F.concat(F.concat_ws(" ", *words), F.lit("\n"), text))


def keep_scores(rows: DataFrame, model: DataFrame, intercept: float, token: str = r"[a-z0-9_]+") -> DataFrame:
    """``id, score`` of ``id, text``: logistic regression on the TF-IDF of words and pairs of words, normalised to length one; 0 for texts without any feature.

    ``model`` has ``feature, idf, coef``: a vocabulary, broadcast by AQE if it is small. Features are counted with partial sums, so long texts meet in no single row.
    """
    words = F.regexp_extract_all(F.lower(F.trim("text")), F.lit(f"({token})"), 1)
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.concat_ws(" ", F.element_at("w", k), F.element_at("w", k + 1)))).otherwise(F.array().cast("array<string>"))
    grams = rows.select("id", words.alias("w")).select("id", F.explode(F.concat("w", pairs)).alias("feature"))
    known = grams.join(model, "feature").groupBy("id", "feature").agg((F.count("*") * F.max("idf")).alias("x"), F.max("coef").alias("coef"))
    sums = known.groupBy("id").agg(F.sum(F.col("x") * F.col("coef")).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    logit = F.col("dot") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0)) + intercept
    return rows.select("id").join(sums, "id", "left").select("id", F.when(F.col("norm").isNull(), 0.0).otherwise(1 / (1 + F.exp(-logit))).alias("score"))
