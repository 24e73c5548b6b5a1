"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A pattern is literal text in which ``*`` stands for anything and ``^`` for a character that is neither a letter nor a digit, or an end of the
URL. A run of letters and digits between two such characters must be a whole token of every URL that matches; the run that the
fewest URLs hold indexes the pattern. A URL's tokens fetch the patterns to try, and only these run as regular expressions. Everything
is done row by row in DataFrame functions: no shuffle but for the token counts, which are partly added up before. Host rules are found by
the suffixes of a URL's host in the same way. Rules beyond ``CONSTANT_RULES`` are tables, joined by token or suffix, with the same results.
"""

from __future__ import annotations

import json
import re
import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.plans.storage import join_small, materialize


class HostRule(NamedTuple):
    """Fits its host and all subdomains, where the URL's path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Pattern(NamedTuple):
    verdict: str
    text: str

    @property
    def tokens(self) -> list[str]:
        """Literal tokens: runs with a character on both sides that ends a token."""
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", self.text)

    @property
    def regex(self) -> str:
        return "(?s)" + "".join({"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}.get(c) or re.sub(r"([^a-z0-9/_-])", r"\\\1", c) for c in self.text)


HOST_RULES = [HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/")]
#: Lower case. An allowing pattern outweighs all blocking ones.
PATTERNS = [Pattern("block", t) for t in ("^casino-win^", "^free-bets^", "^cheap-pills^", "^ads-track^", "^casino^", "^poker^", "^viagra^", "^porn^", "^xxx^", "^warez^", "^doubleclick^", "^adserver^", "^popunder^", "^bets.*/bonus^", "^track*.gif^")] + [Pattern("allow", "^responsible-gaming^")]
#: Rules of a kind up to which they are constants of the plan; more are joined by their index tokens or hosts.
CONSTANT_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(url, _UPPER, _LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def rarest_tokens(pages: DataFrame, patterns: list[Pattern], url: str = "url") -> dict[str, list[Pattern]]:
    """Patterns by that of their literal tokens which the fewest rows hold; under ``""`` those without one, which every URL must try."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    if not wanted:
        return {"": list(patterns)} if patterns else {}
    if len(wanted) <= CONSTANT_RULES:
        found = F.explode(F.array_intersect(url_tokens(F.col(url)), F.array(*map(F.lit, wanted))))
        held = pages.select(found.alias("t"))
    else:
        held = join_small(pages.select(F.explode(url_tokens(F.col(url))).alias("t")), _table(pages.sparkSession, [(t,) for t in wanted], "t string"), "t", "left_semi")
    counts = {r.t: r["count"] for r in held.groupBy("t").count().collect()}  # at most one row per literal token of a rule
    index: dict[str, list[Pattern]] = {}
    for p in patterns:
        index.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(p)
    return index


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rules as a table: one literal, read where it is used."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return materialize(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(c.replace(' ', ': ') for c in schema.split(', '))}>>"))), "rules")


def _fetched(keys: Column, index: dict[str, list[int]]) -> Column:
    """The numbers that a constant index has under any of ``keys``: a short map for each hash of a key."""
    size = max(1, len(index))
    slots: list[list[Column]] = [[] for _ in range(size)]
    for key, numbers in index.items():
        slots[zlib.crc32(key.encode()) % size] += [F.lit(key), F.array(*map(F.lit, numbers))]
    maps = F.array(*[F.create_map(*x) if x else F.create_map().cast("map<string,array<int>>") for x in slots])
    slot = lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(size)).cast("int") + 1
    found = F.transform(keys, lambda t: F.element_at(F.element_at(maps, slot(t)), t))
    return F.flatten(F.filter(found, lambda x: x.isNotNull()))


def host_suffixes(host_: Column) -> Column:
    """The host and all domains above it."""
    parts = F.split(host_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def _match_hosts(rows: DataFrame, rules: list[HostRule]) -> DataFrame:
    """``rows`` with ``rule`` and ``own``, the name and verdict of the rule that wins, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))  # the first that fits wins
    if len(ordered) <= CONSTANT_RULES:
        if not ordered:
            return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("own", F.lit(None).cast("string"))
        index: dict[str, list[int]] = {}
        for k, r in enumerate(ordered, 1):
            index.setdefault(r.host, []).append(k)
        paths, names, verdicts = (F.array(*map(F.lit, x)) for x in ([r.path for r in ordered], [r.name for r in ordered], [r.verdict for r in ordered]))
        fits = F.filter(_fetched(host_suffixes(F.col("host")), index), lambda k: F.startswith(F.col("path"), F.element_at(paths, k)))
        best = lambda of: F.when(F.size("_fits") > 0, F.element_at(of, F.array_min("_fits")))  # noqa: E731  # the size tells: element_at doesn't heed a null place here
        return rows.withColumn("_fits", fits).withColumn("rule", best(names)).withColumn("own", best(verdicts)).drop("_fits")
    table = _table(rows.sparkSession, [(k, r.host, r.path, r.name, r.verdict) for k, r in enumerate(ordered, 1)], "k int, rhost string, rpath string, rname string, rverdict string")
    keys = rows.select("_row", "path", F.explode(host_suffixes(F.col("host"))).alias("rhost"))
    best = join_small(keys, table, "rhost", "inner").where(F.startswith(F.col("path"), F.col("rpath"))).groupBy("_row").agg(F.min_by(F.struct(F.col("rname").alias("rule"), F.col("rverdict").alias("own")), "k").alias("b"))
    return rows.join(best, "_row", "left").select(*rows.columns, "b.rule", "b.own")


def _match_patterns(rows: DataFrame, index: dict[str, list[Pattern]]) -> DataFrame:
    """``rows`` with ``hits``: the verdicts of the patterns that match ``_url``."""
    keyed = {t: ps for t, ps in index.items() if t}
    flat = [p for ps in keyed.values() for p in ps]
    low, verdicts = F.translate("_url", _UPPER, _LOWER), {"allow", "block"}
    always = [F.when(low.rlike(p.regex), p.verdict) for p in index.get("", [])]
    tried = F.array_compact(F.array(*always)) if always else F.array().cast("array<string>")
    if not flat:
        return rows.withColumn("hits", tried)
    if len(flat) <= CONSTANT_RULES:
        number = {id(p): k for k, p in enumerate(flat, 1)}
        regexes = F.array(*[F.lit(p.regex) for p in flat])
        kinds = {v: _fetched(url_tokens(F.col("_url")), {t: ks for t, ps in keyed.items() if (ks := [number[id(p)] for p in ps if p.verdict == v])}) for v in sorted(verdicts)}
        hit = lambda v: F.when(F.exists(kinds[v], lambda k: F.regexp_like(low, F.element_at(regexes, k))), v)
        return rows.withColumn("hits", F.concat(tried, F.array_compact(F.array(*[hit(v) for v in sorted(kinds)]))))
    table = _table(rows.sparkSession, [(t, p.regex, p.verdict) for t, ps in keyed.items() for p in ps], "token string, regex string, verdict string")
    keys = rows.select("_row", low.alias("low"), F.explode(url_tokens(F.col("_url"))).alias("token"))
    found = join_small(keys, table, "token", "inner").where(F.regexp_like(F.col("low"), F.col("regex"))).groupBy("_row").agg(F.collect_set("verdict").alias("found"))
    return rows.join(found, "_row", "left").select(*rows.columns, F.concat(tried, F.coalesce("found", F.array().cast("array<string>"))).alias("hits"))


def filter_urls(pages: DataFrame, host_rules: list[HostRule] | None = None, patterns: list[Pattern] | None = None, url: str = "url", id_: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row. Of the host rules that fit the longest wins (of equals, the first by text); where
    none fits, ``rule`` is null and the patterns decide: ``block`` if a blocking one matches and no allowing one, else ``allow``. Null urls, and such without
    ``://``, have an empty host and path; null urls match no pattern; an empty table gives no rows; repeated rows stay; extra columns are ignored."""
    host_rules, patterns = HOST_RULES if host_rules is None else host_rules, PATTERNS if patterns is None else patterns
    rows = pages.select(F.col(id_).alias("page_id"), F.col(url).alias("_url"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    if max(len(host_rules), len(patterns)) > CONSTANT_RULES:
        rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "pages")
    rows = _match_patterns(_match_hosts(rows, host_rules), rarest_tokens(pages, patterns, url))
    hit = lambda v: F.coalesce(F.array_contains("hits", v), F.lit(False))
    verdict = F.when(hit("block") & ~hit("allow"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", verdict).alias("verdict"))


def op6_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op6_sql() -> str:
    """The same rules for DuckDB, every pattern tried on every URL."""
    ordered = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(ends_with('.' || host, '.{r.host}') AND starts_with(path, '{r.path}'))"
    matches = lambda v: "(" + " OR ".join(f"coalesce(regexp_matches(low, '{p.regex}'), false)" for p in PATTERNS if p.verdict == v) + ")"
    return f"""
WITH parts AS (SELECT page_id, translate(url, '{_UPPER}', '{_LOWER}') AS low, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ordered)} END AS rule,
  CASE {" ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)} WHEN {matches("allow")} OR NOT {matches("block")} THEN 'allow' ELSE 'block' END AS verdict FROM parts
"""
