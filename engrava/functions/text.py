"""Text functions: hashes, tokens, overlap and normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_with_path(content: Column, path: Column) -> Column:
    """SHA-256 of path, a zero byte, and content."""
    return F.sha2(F.concat(path, F.expr("char(0)"), content), 256)


def hash_content(content: Column) -> Column:
    return F.sha2(content, 256)


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case runs of ASCII letters and digits of at least ``least`` characters, repeats included."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def word_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller token set; 0 if either is empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def normal_object(value: Column) -> Column:
    """Lower case, letters and digits only, separators as single spaces."""
    kept = F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}\s\-_/]", "")
    return F.trim(F.regexp_replace(kept, r"[\s\-_/]+", " "))


def object_similarity(a: Column, b: Column) -> Column:
    """The larger of token Jaccard and normalised Levenshtein of the normal forms; 1 if these are equal, 0 if either is empty."""
    return normal_similarity(normal_object(a), normal_object(b))


def normal_similarity(x: Column, y: Column) -> Column:
    """``object_similarity`` of normal forms."""
    p, q = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    jaccard = F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), F.lit(0.0)).when(x == y, F.lit(1.0)).otherwise(F.greatest(jaccard, edit))


def token_estimate(subject: Column, predicate: Column, obj: Column) -> Column:
    """(bytes + 3) div 4 of a fact's texts, 1 at least."""
    n = sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in (subject, predicate, obj)), F.lit(0))
    return F.greatest(F.lit(1), F.floor((n + 3) / 4)).cast("long")


def extension(path: Column) -> Column:
    """The file name's extension in lower case with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def is_garbage(chunk: Column) -> Column:
    """Under 20 bytes when trimmed, all digits, or a single word."""
    x = F.trim(chunk)
    return (F.octet_length(x) < 20) | x.rlike(r"^[0-9]+$") | ~x.rlike(r"[ \t\n]")


def resolve_wikilinks(text: Column) -> Column:
    """``[[A|B]]`` becomes B, ``[[A]]`` becomes A."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]|]*)\]\]", "$1")


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"\s+", " "))


def effective_confidence(confidence: Column, decay_rate: Column, since: Column, as_of: Column) -> Column:
    """Confidence after exponential decay over the days, with fractions, since it was last reinforced."""
    return confidence * F.exp(-decay_rate * days_between(since, as_of))


def days_between(since: Column, until: Column) -> Column:
    return F.timestamp_diff("SECOND", since, until) / 86400.0
