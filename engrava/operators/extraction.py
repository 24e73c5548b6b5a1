"""Rule-based extraction of facts from text, and fact queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
# Fixed values.
#: Patterns of facts that are found wherever they stand.
PATTERNS = {
    "iso_date": r"\b(\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{3})?(?:Z|[+-]\d{2}:\d{2})?)?)\b",
    "natural_date": rf"\b((?:{_MONTH})(?:\s+\d{{1,2}})?(?:,?\s+\d{{4}})?)\b",
    "email": r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b",
    "phone": r"\b(\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})\b",
    "international_phone": r"(\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,4}[-.\s]?\d{0,9})\b",
}
#: Shapes of lines that state a key and a value, in order.
KEY_VALUE = [
    r"^[-*•]\s+\*\*([^*:]+):\*\*\s*(.+)$", r"^\*\*([^*:]+):\*\*\s*(.+)$", r"^[-*•]\s+([^:]+):\s*(.+)$", r"^([^:]+):\s*(.+)$", r"^([^→]+)\s*→\s*(.+)$", r"^([^=]+)\s*=\s*(.+)$", r"^([^—]+)\s*—\s*(.+)$",
]
_WHO = r"(?i)^\s*([a-z][a-z0-9'._ -]{0,80})\s+"
#: Sentences that state something: pattern, the type of fact, its confidence.
SENTENCES = {
    "preference": (_WHO + r"(prefers?|likes?|dislikes?|wants?)\s+(.+)$", "preference", 0.86),
    "decision": (r"(?i)^\s*(?:we\s+)?(decided|decide|chose|choose|selected|select|approved)\s+(?:to\s+)?(.+)$", "decision", 0.84),
    "engaged": (_WHO + r"is\s+engaged\s+to\s+([a-z][a-z0-9'._ -]{0,80})\s*[.!]?\s*$", "relationship", 0.9),
    "related": (_WHO + r"is\s+([a-z][a-z0-9'._ -]{0,80})'?s\s+(fianc[eé]e|manager|partner|spouse|wife|husband)\s*$", "relationship", 0.88),
    "state": (_WHO + r"is\s+(running|active|inactive|idle|blocked|online|offline|down|up)(?:\s+on\s+port\s+(\d+))?(?:[.!])?\s*$", "state", 0.87),
    "location": (_WHO + r"(?:is at|is in|located in|based in)\s+(.+?)(?:[.!])?\s*$", "location", 0.86),
}


def _ascii(pattern: str) -> str:
    """A pattern whose word boundaries and blanks are ASCII's, whatever Java version matches it: Java's own boundary also stands between some marks and letters, and its blanks hold the vertical tab."""
    word, blank = "[0-9A-Za-z_]", r"\t\n\f\r "
    edge = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return pattern.replace(r"\b", edge).replace(r"[-.\s]", f"[-.{blank}]").replace(r"\s", f"[{blank}]")


def regex_facts(rows: DataFrame) -> DataFrame:
    """``id, kind, value, n``: every match of each pattern, without blanks at its ends, counted. Words end where ASCII letters, digits and ``_`` do, so a date next to an accented letter is found."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("content", F.lit(_ascii(p)), 1).alias("values")) for k, p in PATTERNS.items()])
    each = rows.select("id", F.explode(found).alias("f")).select("id", "f.kind", F.explode("f.values").alias("value")).withColumn("value", F.trim("value"))
    return each.groupBy("id", "kind", "value").agg(F.count("*").alias("n"))


def key_values(rows: DataFrame) -> DataFrame:
    """``id, line, key, value`` of lines of a key and a value, by the first of ``KEY_VALUE`` that fits, both trimmed and without bold marks, neither empty; lines count from 1."""
    lines = rows.select("id", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    pair = F.lit(None)
    for p in reversed(KEY_VALUE):
        both = F.struct(*[F.regexp_replace(F.regexp_extract("text", p, k), r"^[\s*]+|[\s*]+$", "").alias(n) for k, n in ((1, "key"), (2, "value"))])
        pair = F.when(F.col("text").rlike(p), both).otherwise(pair)
    return lines.select("id", (F.col("at") + 1).alias("line"), pair.alias("p")).select("id", "line", "p.key", "p.value").where("key <> '' AND value <> ''")


def sentences(rows: DataFrame, subject: str = "decision") -> DataFrame:
    """``id, line, subject, predicate, object, fact_type, confidence`` of lines that state a preference, decision, relationship, state or place, by the first pattern that fits.

    Lines with ``:``, ``=``, an arrow or a dash are left to ``key_values``. A decision's subject is ``subject``.
    """
    lines = rows.select("id", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    got = lambda name, k: F.trim(F.regexp_extract("text", SENTENCES[name][0], k))
    plain = lambda c: F.regexp_replace(c, r"[.; ]+$", "")
    port = got("state", 3)
    parts = {
        "preference": (got("preference", 1), F.lower(got("preference", 2)), plain(got("preference", 3))),
        "decision": (F.lit(subject), F.lower(got("decision", 1)), plain(got("decision", 2))),
        "engaged": (got("engaged", 1), F.lit("engaged_to"), got("engaged", 2)),
        "related": (got("related", 1), F.lower(got("related", 3)), got("related", 2)),
        "state": (got("state", 1), F.lit("status"), F.when(port == "", F.lower(got("state", 2))).otherwise(F.concat(F.lower(got("state", 2)), F.lit(" on port "), port))),
        "location": (got("location", 1), F.lit("location"), plain(got("location", 2))),
    }
    found = F.lit(None)
    for name in reversed(SENTENCES):
        pattern, kind, confidence = SENTENCES[name]
        fact = F.struct(*[c.alias(n) for c, n in zip(parts[name], ("subject", "predicate", "object"))], F.lit(kind).alias("fact_type"), F.lit(confidence).alias("confidence"))
        found = F.when(F.col("text").rlike(pattern), fact).otherwise(found)
    free = lines.where("text <> ''").where(~F.col("text").rlike("[:=→—]"))
    return free.select("id", (F.col("at") + 1).alias("line"), found.alias("f")).where("f IS NOT NULL").select("id", "line", "f.*")


def paragraphs(rows: DataFrame) -> DataFrame:
    """``id, position, text, first_line``: parts between blank lines; CRLF counts as LF."""
    text = F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n"))
    parts = rows.select("id", F.split(text, "\n\n").alias("p"))
    starts = F.transform("p", lambda x, k: F.aggregate(F.slice("p", 1, k), F.lit(1), lambda s, y: s + 2 + F.length(y) - F.length(F.replace(y, F.lit("\n"), F.lit("")))))
    each = parts.select("id", F.posexplode(F.arrays_zip(F.col("p").alias("text"), starts.alias("line"))).alias("position", "z"))
    return each.select("id", "position", F.trim("z.text").alias("text"), F.col("z.line").alias("first_line")).where("text <> ''")


def where(rows: DataFrame, clauses: list[str]) -> DataFrame:
    """Rows that meet all clauses of the small predicate language: ``= != > < >= <=``, ``~`` (contains), ``exists(field)``.

    Numbers compare as numbers, all else as trimmed lower-case text; a clause on an unknown field holds for no row,
    nor does one that compares numbers with what is none.
    """
    for clause in clauses:
        rows = rows.where(_clause(rows, clause))
    return rows


def _clause(rows: DataFrame, clause: str) -> Column:
    text = clause.strip()
    if text.startswith("exists(") and text.endswith(")"):
        name = text[7:-1].strip()
        return F.coalesce(F.trim(F.col(name).cast("string")) != "", F.lit(False)) if name in rows.columns else F.lit(False)
    for op in (">=", "<=", "!=", "~", ">", "<", "="):
        if op in text:
            name, value = (x.strip() for x in text.split(op, 1))
            break
    else:
        raise ValueError(f"not a clause: {clause!r}")
    if name not in rows.columns:
        return F.lit(False)
    kind = dict(rows.dtypes)[name]
    if op == "~":
        return F.contains(F.lower(F.col(name).cast("string")), F.lit(value.lower()))
    if kind in ("bigint", "int", "double", "float"):
        try:
            left, right = F.col(name).cast("double"), F.lit(float(value))
        except ValueError:
            return F.lit(False)
    else:
        left, right = F.lower(F.trim(F.col(name).cast("string"))), F.lit(value.lower())
    return {"=": left == right, "!=": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right}[op]
