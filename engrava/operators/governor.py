"""Which proposed facts are worth keeping: noise rules, quality, caps, and votes on what a text is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engrava.functions import text as T

# Fixed values.
GENERIC_SUBJECTS = [
    "conversation summary", "conversation capture", "conversation", "summary", "untitled", "unknown", "(unknown)", "none", "n/a", "assistant",
    "user", "system", "completed today", "in progress", "blocked", "stats", "system health", "notes", "active projects", "major technical outcomes",
]
NOISE_PREDICATES = [
    "amount", "url", "urls", "date", "value", "http", "https", "link", "links", "session id", "session key", "message id", "sender_id",
    "current time", "group subject", "group channel", "assistant", "user", "system",
]
CAPTURE_PREDICATES = ["is", "is on", "is at", "has", "was", "are", "phone"]
CAPTURE_SUBJECT_STARTS = ["current", "timestamp", "message "]
CAPTURE_OBJECTS = ["true", "false", "yes", "no", "none", "n/a", "active", "enabled"]
INSTRUCTION_SIGNALS = ["must", "should", "never", "always", "do not", "read-only", "append only", "flush", "overwrite"]
MARKDOWN_TOKENS = ["**", "***", "---", "___", "```", "~~~", "|", "|-", "-|", "--|--", "|---|", "#", "##", "###", "####"]
TYPE_BONUS = {"identity": 0.15, "decision": 0.12, "relationship": 0.12, "preference": 0.10, "location": 0.08, "state": 0.05, "temporal": 0.02}
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: Words that vote for a class of memory, and the weight of each vote.
CLASS_SIGNALS = {
    "rule": (2, ["must", "must not", "never", "always", "do not", "don't", "non-negotiable", "rule:", "guardrail", "mandatory", "capital instruction", "no exceptions"]),
    "decision": (2, ["decided", "decision", "we chose", "chosen", "going with", "selected", "final decision", "ship this", "approved approach"]),
    "preference": (2, ["prefer", "preferred", "likes", "dislikes", "wants", "style", "tone", "format", "preference"]),
    "identity": (2, ["name:", "role:", "username", "email", "i am", "he is", "she is", "they are", "works at", "reports to", "title:"]),
    "status": (1, ["status", "currently", "in progress", "working on", "blocked", "todo", "next up", "started", "completed", "idle"]),
    "scratch": (1, ["brainstorm", "scratch", "rough idea", "draft", "maybe", "might", "could", "experiment", "parking lot"]),
}
#: Words that tell a key-value line's type, in order: in the whole line, and in its key.
KV_TYPES = [
    ("preference", ["prefers", "preference", "likes", "dislikes", "wants"], ["favorite"]),
    ("decision", ["decided", "decision", "chose", "selected", "approved"], []),
    ("relationship", ["engaged to", "married to", "reports to", "fiancée", "fiancee", "spouse", "partner", "manager"], []),
    ("state", ["running", "blocked", "idle", "online", "offline"], ["status", "state"]),
    ("location", ["located in"], ["location", "address", "city", "country", "venue"]),
]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words anywhere."""
    return _any([F.contains(text, F.lit(w)) for w in words])


def markdown_junk(text: Column) -> Column:
    """Empty, or nothing but marks of Markdown."""
    x = F.trim(text)
    return (x == "") | x.isin(MARKDOWN_TOKENS) | x.rlike(r"^[*\-_| :]+$")


def generic_subject(subject: Column) -> Column:
    """A label, a heading with a time, or too long to be a name. An empty one isn't."""
    x = F.trim(subject)
    low = F.lower(x)
    timed = x.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}\s*(?:AM|PM))") | x.rlike(rf"(?i)^({MONTH})(\s+\d{{1,2}},?)?\s+\d{{4}}\b") | x.rlike(r"(?i)^current.*(?:time|date)")
    long_ = (F.octet_length(x) > 40) | (x.rlike("[✅🚩📌🌙]") & (F.octet_length(x) > 30))
    return (x != "") & (low.isin(GENERIC_SUBJECTS) | F.startswith(low, F.lit("conversation ")) | F.startswith(low, F.lit("send this to ")) | timed | long_)


def is_noise(subject: Column, predicate: Column, obj: Column, least_object: int = 3, least_predicate: int = 5, captured: bool = False) -> Column:
    """Whether a proposed fact says nothing that lasts. ``captured`` adds the stricter rules for conversations."""
    s, p, o = F.trim(subject), F.trim(predicate), F.trim(obj)
    low_s, low_p, low_o = F.lower(s), F.lower(p), F.lower(o)
    link = lambda x: x.rlike(r"^(https?:)?//")
    rules = [
        o == "", p == "", F.octet_length(o) < least_object, F.octet_length(p) < least_predicate, markdown_junk(o), markdown_junk(p), generic_subject(s),
        low_o == low_p, p.rlike(r"^[0-9.,\-+$%]+$"), o.rlike(r"^[*_`#~ ]+$"), low_p.isin(NOISE_PREDICATES), link(low_o), link(low_p), p.rlike(r"^[0-9a-f]{6,}\b"),
        s.rlike("^[0-9]"), p.contains("|"), low_s.rlike("^[>-] "), low_p.rlike("^[-*] "), low_s.startswith("[") & low_s.contains("]("), s.startswith("#"), s.contains("**"),
        p.contains("/") & (p.contains(".") | p.startswith("/") | p.startswith("~")), F.octet_length(o) > 200, low_s.startswith("[x]") | low_s.startswith("[ ]"),
    ]
    if captured:
        signals = sum((F.contains(F.concat_ws(" ", low_s, low_p, low_o), F.lit(w)).cast("int") for w in INSTRUCTION_SIGNALS), F.lit(0))
        bare = F.regexp_replace(low_o, r"^[\"'`.,;:!?()\[\]{}]+|[\"'`.,;:!?()\[\]{}]+$", "")
        rules += [low_p.isin(CAPTURE_PREDICATES), _any([F.startswith(low_s, F.lit(x)) for x in CAPTURE_SUBJECT_STARTS]), bare.isin(CAPTURE_OBJECTS), signals >= 2]
    return _any(rules)


def quality(confidence: Column, fact_type: Column, subject: Column, predicate: Column, obj: Column, method: Column) -> Column:
    """Confidence with a bonus for telling types, less for short parts, between 0 and 1."""
    bonus = F.lit(0.0)
    for name, value in TYPE_BONUS.items():
        bonus = F.when(fact_type == name, value).otherwise(bonus)
    size = lambda c: F.octet_length(F.trim(c))
    short = F.when(size(obj) < 5, 0.10).when(size(obj) < 10, 0.05).otherwise(0.0) + F.when(size(subject) == 0, 0.15).when(size(subject) < 3, 0.08).otherwise(0.0) + F.when(size(predicate) < 3, 0.08).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence + bonus - short + F.when(method == "llm", 0.05).otherwise(0.0)))


def governed(rows: DataFrame, most: int = 10, captured: bool = False) -> DataFrame:
    """``id, memory_id, rank``: the facts that stay of ``id, memory_id, subject, predicate, object, fact_type, method, confidence``.

    Noise goes, then all but the most confident of a triple in a memory (of equals the first by id), then all but the ``most`` best of each memory (of equals the
    first by id; 0: no cap). The best of a triple is an aggregate; the ranks stop at ``most``, so a memory of many facts is cut down before its sort.
    """
    limits = {"least_object": 6} if captured else {}
    live = rows.where(~is_noise(F.col("subject"), F.col("predicate"), F.col("object"), captured=captured, **limits))
    key = [F.lower(F.trim(c)).alias(f"_{c}") for c in ("subject", "predicate", "object")]
    score = F.round(quality(*(F.col(c) for c in ("confidence", "fact_type", "subject", "predicate", "object", "method"))), 9)  # sums that differ in their last bits only are equal
    best = live.groupBy("memory_id", *key).agg(F.min_by(F.struct("id", score.alias("q")), F.struct(-F.col("confidence"), F.col("id"))).alias("b"))
    ranked = best.select("b.id", "memory_id", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("b.q"), "b.id")).alias("rank"))
    return ranked.where(F.col("rank") <= most) if most else ranked


def memory_class(content: Column, section: Column) -> Column:
    """The class with most votes, of equals the first in ``CLASS_SIGNALS``; empty if none has any."""
    text = F.lower(F.trim(F.concat(section, F.lit("\n"), content)))
    votes = [F.struct((weight * sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, (weight, words)) in enumerate(CLASS_SIGNALS.items())]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(""))


def key_value_type(key: Column, value: Column, line: Column) -> Column:
    """The type of fact that a key-value line states."""
    joined, low = F.lower(F.trim(F.concat_ws(" ", key, value, line))), F.lower(F.trim(key))
    out = F.lit("kv")
    for name, anywhere, in_key in reversed(KV_TYPES):
        out = F.when(holds_any(joined, anywhere) | holds_any(low, in_key), name).otherwise(out)
    return out


def infer_subject(section: Column, path: Column, most: int = 40) -> Column:
    """The section, or else the file's stem; cut at the last space within ``most`` characters."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    name = F.when(F.trim(section) != "", F.trim(section)).otherwise(stem)
    cut = F.substring(name, 1, most)
    return F.when(F.length(name) <= most, name).otherwise(F.trim(F.when(cut.contains(" "), F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut)))


def temporal_noise(subject: Column) -> Column:
    """Subjects that name the present."""
    low = F.lower(F.trim(F.coalesce(subject, F.lit(""))))
    return low.isin("current time", "current date", "current_time") | low.like("current%timeout%") | low.like("current%date%")


def cleanup(memories: DataFrame, facts: DataFrame, least_chars: int = 20) -> dict[str, DataFrame]:
    """Memories that aren't short or a number, and facts that have a subject, aren't noise of time, and belong to a memory that stays."""
    content = F.trim("content")
    kept = memories.where((F.length(content) >= least_chars) & ~content.rlike(r"^[0-9]+$"))
    said = facts.where((F.trim("subject") != "") & ~temporal_noise(F.col("subject")))
    return {"memories": kept, "facts": said.join(kept.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")}


def contains_phrase(haystack: Column, phrase: Column) -> Column:
    """Whether the normal forms' tokens of a phrase stand in a row in a text's; not if either has none."""
    plain = lambda c: F.concat_ws(" ", F.filter(F.split(T.normalize_answer(F.regexp_replace(c, ",", "")), "[^a-z0-9]+"), lambda t: t != ""))
    h, p = plain(haystack), plain(phrase)
    return (p != "") & F.contains(F.concat(F.lit(" "), h, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))
