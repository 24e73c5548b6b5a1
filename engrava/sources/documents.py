"""Readers: files of several formats to chunks with their place, all through Spark's own file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engrava.functions import text as T

#: Larger files are skipped.
MOST_BYTES = 10 << 20


def read_files(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """``path, content, format`` of text files below ``path``. Included extensions win over excluded ones; binary files (a zero byte, or no UTF-8) and large ones go."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(path).where(F.col("length") <= MOST_BYTES)
    ext = T.extension(F.col("path"))
    if include:
        rows = rows.where(ext.isin([e.lower() for e in include]))
    elif exclude:
        rows = rows.where(~ext.isin([e.lower() for e in exclude]))
    head = F.substring(F.col("content"), 1, 512)
    # A character that the first 512 bytes cut in two may stand at their end.
    valid = F.is_valid_utf8(head.cast("string"))
    for k in (1, 2, 3):
        valid = valid | ((F.octet_length(head) == 512) & F.is_valid_utf8(F.substring(head, 1, 512 - k).cast("string")))
    rows = rows.where(~F.hex(head).rlike("^(?:..)*00") & valid)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return rows.select("path", text.alias("content"), sniff_format(text, ext).alias("format"))


def sniff_format(text, ext=None):
    """By extension, else by content: JSON, Markdown, YAML, else text."""
    by_content = F.when(text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), "json").when(text.rlike("^#{1,2} "), "markdown").when(text.startswith("---\n"), "yaml").otherwise("text")
    if ext is None:
        return by_content
    known = F.when(ext.isin(".md", ".markdown"), "markdown").when(ext == ".json", "json").when(ext.isin(".yaml", ".yml"), "yaml").when(ext.isin(".csv", ".tsv"), "table").when(ext == ".txt", "text")
    return F.coalesce(known, by_content)


def markdown_sections(rows: DataFrame) -> DataFrame:
    """``path, section, first_line, text``: parts between headers of level 2 to 6, outside code fences; ``section`` joins the headers above with ``>``.

    The lines of one file are ordered in a window of that file; a file is bounded by ``MOST_BYTES``.
    """
    lines = rows.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike("^\\s*```")
    lines = lines.withColumn("inside", F.sum(fence.cast("int")).over(w) % 2 == 1)
    level = F.when(~F.col("inside") & F.col("line").rlike("^#{1,6} "), F.length(F.regexp_extract("line", "^(#{1,6}) ", 1))).otherwise(0)
    lines = lines.withColumn("level", level).withColumn("part", F.sum((F.col("level") >= 2).cast("int")).over(w))
    for k in range(2, 7):  # the last header of each level, void once a higher one follows
        at = F.max(F.when(F.col("level") == k, F.col("at"))).over(w)
        above = F.max(F.when((F.col("level") >= 2) & (F.col("level") < k), F.col("at"))).over(w)
        name = F.last(F.when(F.col("level") == k, F.regexp_extract("line", "^#+ +(.*?)\\s*$", 1)), ignorenulls=True).over(w)
        lines = lines.withColumn(f"h{k}", F.when(at.isNotNull() & (above.isNull() | (at > above)), name))
    body = F.when(F.col("level") == 0, F.col("line"))
    section = F.max(F.concat_ws(" > ", *[f"h{k}" for k in range(2, 7)]))
    parts = lines.groupBy("path", "part").agg(section.alias("section"), (F.min("at") + 1).alias("first_line"), F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct("at", "line")))).alias("held"))
    text = F.regexp_replace(F.array_join(F.transform("held", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return parts.select("path", "section", "first_line", text.alias("text")).where("text <> ''")


def json_rows(rows: DataFrame) -> DataFrame:
    """``path, key, value``: an array's elements, an object's members, or the one scalar, each as JSON text."""
    parsed = rows.select("path", F.try_parse_json("content").alias("v")).where("v IS NOT NULL")
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    nested = each.select("path", F.coalesce("key", F.col("pos").cast("string")).alias("key"), F.to_json("value").alias("value"))
    scalars = parsed.where("schema_of_variant(v) NOT LIKE 'ARRAY%' AND schema_of_variant(v) NOT LIKE 'OBJECT%'").select("path", F.lit("").alias("key"), F.to_json("v").alias("value"))
    return nested.union(scalars)


def table_rows(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """``value``: each row of CSV files with a header as a JSON object; empty cells are left out."""
    rows = spark.read.option("header", True).option("sep", separator).option("ignoreLeadingWhiteSpace", True).csv(path)
    return rows.select(F.to_json(F.struct("*")).alias("value")).where("value <> '{}'")


def tags(content, front=None):
    """Front-matter tags, then inline ``#tags``, in lower case, repeats kept."""
    inline = F.transform(F.regexp_extract_all(content, F.lit(r"(?:^|\s)#([A-Za-z][A-Za-z0-9_/-]*)"), 1), F.lower)
    return F.concat(F.transform(front, F.lower), inline) if front is not None else inline
