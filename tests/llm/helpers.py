"""Small tables and brute force for the tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """Rows are (doc_id, text) or (doc_id, text, lang, source)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows], DOCS)


def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"word{k % 997}" for k in range(60_000))
    return docs_of(spark, [(1, None, None, None), (None, "no id here", "en", "a"), (2, "", "en", None), (3, " \n\t ", "en", "a"), (4, "x", "de", "b"), (5, long, "en", "a"), (6, long, "en", "a"), (6, long, "en", "a"), (7, "ünï çødé — 中文 😀 'twas\x1f\n\n\n  end  ", "fr", "b"), (None, None, None, None), (8, "x", "de", "b")])


def clashing(spark, df):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    for c in ("node", "row", "_row", "_fp", "rep", "size", "copies", "taken", "cut", "rank", "key", "v", "c0", "score", "component_id", "part", "length", "hosts", "host", "_at"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def components(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
