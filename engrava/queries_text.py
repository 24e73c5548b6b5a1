"""Queries of the operators on drafts of facts, on notes and on literals that name times, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.operators import governor, temporal
from engrava.plans import drafts as D
from engrava.registry import query


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _holds(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted([w])})" for w in words) + ")" if words else "false"


_JUNK = "(trim({0}) = '' OR trim({0}) IN (" + _quoted(governor.MARKDOWN_TOKENS) + ") OR regexp_matches(trim({0}), '^[*_| :-]+$'))"
_GENERIC = f"""(s <> '' AND (lower(s) IN ({_quoted(governor.GENERIC_SUBJECTS)}) OR starts_with(lower(s), 'conversation ') OR starts_with(lower(s), 'send this to ')
  OR regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_matches(s, '^\\d{{1,2}}:\\d{{2}}\\s*(AM|PM)') OR regexp_matches(s, '^({governor.MONTH})(\\s+\\d{{1,2}},?)?\\s+\\d{{4}}\\b', 'i')
  OR regexp_matches(s, '^current.*(time|date)', 'i') OR strlen(s) > 40))"""
_RULES = f"""o = '' OR p = '' OR strlen(o) < {{least}} OR strlen(p) < 5 OR {_JUNK.format('o')} OR {_JUNK.format('p')} OR {_GENERIC} OR lower(o) = lower(p)
 OR regexp_matches(p, '^[0-9.,+$%-]+$') OR regexp_matches(o, '^[*_`#~ ]+$') OR lower(p) IN ({_quoted(governor.NOISE_PREDICATES)})
 OR regexp_matches(lower(o), '^(https?:)?//') OR regexp_matches(lower(p), '^(https?:)?//') OR regexp_matches(p, '^[0-9a-f]{{6,}}\\b') OR regexp_matches(s, '^[0-9]') OR contains(p, '|')
 OR starts_with(s, '> ') OR starts_with(s, '- ') OR starts_with(p, '- ') OR starts_with(p, '* ') OR (starts_with(s, '[') AND contains(s, '](')) OR starts_with(s, '#') OR contains(s, '**')
 OR (contains(p, '/') AND (contains(p, '.') OR starts_with(p, '/') OR starts_with(p, '~'))) OR strlen(o) > 200 OR starts_with(lower(s), '[x]') OR starts_with(s, '[ ]')"""
_SIGNALS = " + ".join(f"CAST(contains(lower(s || ' ' || p || ' ' || o), '{w}') AS INTEGER)" for w in governor.INSTRUCTION_SIGNALS)
_CAPTURED = f"""lower(p) IN ({_quoted(governor.CAPTURE_PREDICATES)}) OR starts_with(lower(s), 'current') OR starts_with(lower(s), 'timestamp') OR starts_with(lower(s), 'message ')
 OR trim(lower(o), '"''`.,;:!?()[]{{}}') IN ({_quoted(governor.CAPTURE_OBJECTS)}) OR {_SIGNALS} >= 2"""
_TRIMMED = f"{D.SQL['drafts']}, trimmed AS (SELECT *, trim(subject) AS s, trim(predicate) AS p, trim(object) AS o FROM drafts)"
_FLAGGED = f"{_TRIMMED}, flagged AS (SELECT *, ({_RULES.replace('{least}', '3')}) AS noise, ({_RULES.replace('{least}', '6')} OR {_CAPTURED}) AS noise_captured FROM trimmed)"


@query("noise_facts", "SELECT id, noise, noise_captured FROM flagged", _FLAGGED)
def _(s, d):
    parts = [F.col(c) for c in ("subject", "predicate", "object")]
    return D.drafts(s, d).select("id", governor.is_noise(*parts).alias("noise"), governor.is_noise(*parts, least_object=6, captured=True).alias("noise_captured"))


_BONUS = "CASE fact_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in governor.TYPE_BONUS.items()) + " ELSE 0.0 END"
_SCORED = f"""scored AS (SELECT *, least(1.0, greatest(0.0, confidence + CAST({_BONUS} AS DOUBLE) - (CASE WHEN strlen(o) < 5 THEN 0.1 WHEN strlen(o) < 10 THEN 0.05 ELSE 0.0 END::DOUBLE
 + CASE WHEN strlen(s) = 0 THEN 0.15 WHEN strlen(s) < 3 THEN 0.08 ELSE 0.0 END::DOUBLE + CASE WHEN strlen(p) < 3 THEN 0.08 ELSE 0.0 END::DOUBLE) + CASE WHEN method = 'llm' THEN 0.05 ELSE 0.0 END::DOUBLE)) AS q FROM flagged)"""
for _name, _most, _flag in (("governed_facts", 10, "noise"), ("governed_captures", 3, "noise_captured")):

    @query(_name, f"SELECT id, memory_id, CAST(rank AS INTEGER) AS rank FROM (SELECT id, memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY round(q, 9) DESC, id) AS rank FROM (SELECT * FROM scored WHERE NOT {_flag} QUALIFY row_number() OVER (PARTITION BY memory_id, lower(s), lower(p), lower(o) ORDER BY confidence DESC, id) = 1)) WHERE rank <= {_most}", f"{_FLAGGED}, {_SCORED}")
    def _(s, d, most=_most, captured=_most == 3):
        return governor.governed(D.drafts(s, d), most, captured)


@query("fact_quality_of_drafts", "SELECT id, round(q, 9) AS quality FROM scored", f"{_FLAGGED}, {_SCORED}")
def _(s, d):
    return D.drafts(s, d).select("id", F.round(governor.quality(*(F.col(c) for c in ("confidence", "fact_type", "subject", "predicate", "object", "method"))), 9).alias("quality"))


_VOTES = ", ".join(f"{w} * ({' + '.join(f'CAST(contains(t, {_quoted([x])}) AS INTEGER)' for x in words)}) AS {name}_" for name, (w, words) in governor.CLASS_SIGNALS.items())
_BEST = "greatest(" + ", ".join(f"{n}_" for n in governor.CLASS_SIGNALS) + ")"


@query("memory_class_votes", f"SELECT id, CASE WHEN {_BEST} = 0 THEN '' {' '.join(f'''WHEN {n}_ = {_BEST} THEN '{n}' ''' for n in governor.CLASS_SIGNALS)} END AS class FROM (SELECT id, {_VOTES} FROM (SELECT id, lower(trim(section || chr(10) || content)) AS t FROM notes))", D.SQL["notes"])
def _(s, d):
    return D.notes(s, d).select("id", governor.memory_class(F.col("content"), F.col("section")).alias("class"))


_KV = " ".join(f"WHEN {_holds('j', anywhere)} OR {_holds('lower(p)', in_key)} THEN '{name}'" for name, anywhere, in_key in governor.KV_TYPES)


@query("key_value_types", f"SELECT id, CASE {_KV} ELSE 'kv' END AS type FROM (SELECT *, lower(p || ' ' || o || ' ' || p || ': ' || o) AS j FROM trimmed)", _TRIMMED)
def _(s, d):
    line = F.concat_ws(": ", "predicate", "object")
    return D.drafts(s, d).select("id", governor.key_value_type(F.col("predicate"), F.col("object"), line).alias("type"))


@query(
    "inferred_subjects",
    """SELECT id, CASE WHEN length(n) <= 12 THEN n WHEN contains(left(n, 12), ' ') THEN trim(regexp_replace(left(n, 12), ' [^ ]*$', '')) ELSE left(n, 12) END AS subject
    FROM (SELECT id, CASE WHEN trim(section) <> '' THEN trim(section) ELSE regexp_replace(regexp_replace(source_file, '^.*[/\\\\]', ''), '(.)\\.[^.]*$', '\\1') END AS n FROM notes)""",
    D.SQL["notes"],
)
def _(s, d):
    return D.notes(s, d).select("id", governor.infer_subject(F.col("section"), F.col("source_file"), 12).alias("subject"))


@query("temporal_noise", "SELECT id FROM drafts WHERE lower(trim(subject)) IN ('current time', 'current date', 'current_time') OR regexp_matches(lower(trim(subject)), '^current.*(timeout|date)')", D.SQL["drafts"])
def _(s, d):
    return D.drafts(s, d).where(governor.temporal_noise(F.col("subject"))).select("id")


_KEPT = "kept AS (SELECT * FROM notes WHERE length(trim(content)) >= 20 AND NOT regexp_matches(trim(content), '^[0-9]+$'))"


@query("cleanup_memories", "SELECT id FROM kept", f"{D.SQL['notes']}, {_KEPT}")
def _(s, d):
    return governor.cleanup(D.notes(s, d), D.drafts(s, d))["memories"].select("id")


@query("cleanup_facts", "SELECT id FROM drafts WHERE trim(subject) <> '' AND lower(trim(subject)) <> 'current time' AND memory_id IN (SELECT id FROM kept)", f"{D.SQL['notes']}, {D.SQL['drafts']}, {_KEPT}")
def _(s, d):
    return governor.cleanup(D.notes(s, d), D.drafts(s, d))["facts"].select("id")


@query("contains_phrase", "SELECT id, contains(' ' || array_to_string(regexp_extract_all(regexp_replace(lower(replace(content, ',', '')), '\\b(a|an|the)\\b', ' ', 'g'), '[a-z0-9]+'), ' ') || ' ', ' works at bank ') AS hit FROM notes", D.SQL["notes"])
def _(s, d):
    return D.notes(s, d).select("id", governor.contains_phrase(F.col("content"), F.lit("Works, at the bank!")).alias("hit"))


# Literals. The twin spells out the forms of the literals in the view, each by its own arithmetic.
_AT = "try_strptime(nullif(anchor, ''), '%Y-%m-%d')::DATE"
_BASE = f"""dated AS (SELECT id, literal, anchor, {_AT} AS day FROM literals),
forms AS (SELECT id, literal, anchor, CASE literal
 WHEN '2024-02-30 noted' THEN ['date', '2024-02-30', NULL, NULL, 'day', 'absolute'] WHEN '12 March 2021' THEN ['date', '2021-03-12', NULL, NULL, 'day', 'absolute']
 WHEN 'July 4, 2020' THEN ['date', '2020-07-04', NULL, NULL, 'day', 'absolute'] WHEN 'in June 2019' THEN ['date_range', NULL, '2019-06-01', '2019-06-30', 'month', 'absolute']
 WHEN 'back in 1999' THEN ['date_range', NULL, '1999-01-01', '1999-12-31', 'year', 'absolute'] WHEN '31 February 2020' THEN ['date_range', NULL, '2020-02-01', '2020-02-29', 'month', 'absolute']
 WHEN 'the week before 9 June 2023' THEN ['date_range', NULL, '2023-06-02', '2023-06-08', 'day', 'resolved_from_anchor'] WHEN 'week after July 4, 2020' THEN ['date_range', NULL, '2020-07-05', '2020-07-11', 'day', 'resolved_from_anchor']
 WHEN 'some day' THEN ['date_range', NULL, NULL, NULL, 'unknown', 'unresolved'] WHEN 'no time at all' THEN NULL WHEN '30 February' THEN NULL
 ELSE CASE WHEN day IS NULL THEN CASE WHEN literal IN ('5 May', 'May 6', '3 days ago', '2 weeks ago', '14 months ago') THEN NULL ELSE ['date_range', NULL, NULL, NULL, 'unknown', 'unresolved'] END ELSE CASE literal
  WHEN 'last week' THEN ['date_range', NULL, CAST(CAST(day - 7 AS DATE) AS VARCHAR), CAST(CAST(day - 1 AS DATE) AS VARCHAR), 'day', 'resolved_from_anchor']
  WHEN 'next week' THEN ['date_range', NULL, CAST(CAST(day + 1 AS DATE) AS VARCHAR), CAST(CAST(day + 7 AS DATE) AS VARCHAR), 'day', 'resolved_from_anchor']
  WHEN 'last month' THEN ['date_range', NULL, CAST(CAST(date_trunc('month', day) - INTERVAL 1 MONTH AS DATE) AS VARCHAR), CAST(CAST(date_trunc('month', day) - INTERVAL 1 DAY AS DATE) AS VARCHAR), 'month', 'resolved_from_anchor']
  WHEN 'next month' THEN ['date_range', NULL, CAST(CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS VARCHAR), CAST(CAST(date_trunc('month', day) + INTERVAL 2 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR), 'month', 'resolved_from_anchor']
  WHEN 'today' THEN ['date', CAST(day AS VARCHAR), NULL, NULL, 'day', 'resolved_from_anchor'] WHEN 'yesterday' THEN ['date', CAST(CAST(day - 1 AS DATE) AS VARCHAR), NULL, NULL, 'day', 'resolved_from_anchor']
  WHEN 'tomorrow' THEN ['date', CAST(CAST(day + 1 AS DATE) AS VARCHAR), NULL, NULL, 'day', 'resolved_from_anchor'] WHEN '3 days ago' THEN ['date', CAST(CAST(day - 3 AS DATE) AS VARCHAR), NULL, NULL, 'day', 'resolved_from_anchor']
  WHEN '2 weeks ago' THEN ['date_range', NULL, CAST(CAST(day - 14 AS DATE) AS VARCHAR), CAST(CAST(day - 8 AS DATE) AS VARCHAR), 'week', 'resolved_from_anchor']
  WHEN '1 year ago' THEN ['date_range', NULL, (year(day) - 1) || '-01-01', (year(day) - 1) || '-12-31', 'year', 'resolved_from_anchor']
  WHEN '14 months ago' THEN CASE anchor WHEN '2024-03-31' THEN ['date_range', NULL, '2023-01-01', '2023-01-31', 'month', 'resolved_from_anchor'] WHEN '2023-01-15' THEN ['date_range', NULL, '2021-11-01', '2021-11-30', 'month', 'resolved_from_anchor']
   ELSE ['date_range', NULL, '2018-12-01', '2018-12-31', 'month', 'resolved_from_anchor'] END
  WHEN 'the week before yesterday' THEN ['date_range', NULL, CAST(CAST(day - 8 AS DATE) AS VARCHAR), CAST(CAST(day - 2 AS DATE) AS VARCHAR), 'day', 'resolved_from_anchor']
  WHEN '5 May' THEN ['date', year(day) || '-05-05', NULL, NULL, 'day', 'resolved_from_anchor'] WHEN 'May 6' THEN ['date', year(day) || '-05-06', NULL, NULL, 'day', 'resolved_from_anchor'] END END END AS f FROM dated)"""
_LITERALS = f"{D.SQL['literals']}, {_BASE}"


def _normal(s, d):
    return temporal.normalized(D.literals(s, d)).select("id", "literal", "f")


@query("normalized_times", "SELECT id, f[1] AS kind, f[2] AS value, f[3] AS start, f[4] AS stop, f[5] AS precision, f[6] AS resolution FROM forms", _LITERALS)
def _(s, d):
    return _normal(s, d).select("id", "f.kind", "f.value", "f.start", F.col("f.end").alias("stop"), "f.precision", "f.resolution")


@query("time_summaries", "SELECT id, CASE WHEN f[2] IS NOT NULL THEN f[2] WHEN f[3] IS NULL THEN '' WHEN f[3] <> f[4] THEN f[3] || '..' || f[4] ELSE f[3] END AS summary FROM forms", _LITERALS)
def _(s, d):
    return _normal(s, d).select("id", temporal.summary(F.col("f")).alias("summary"))


@query("times_in_june_2023", "SELECT id FROM forms WHERE f[2] IS NULL AND f[3] <= '2023-06-30' AND f[4] >= '2023-06-01'", _LITERALS)
def _(s, d):
    asked = temporal.normalize(F.lit("in June 2023"), F.lit(""))
    return _normal(s, d).where(temporal.matches(asked, F.col("f"))).select("id")


@query("temporal_intent", "SELECT id, literal NOT IN ('no time at all', '5 May', 'May 6', '30 February', '3 days ago', '2 weeks ago', '14 months ago') AS asks FROM literals", D.SQL["literals"])
def _(s, d):
    return D.literals(s, d).select("id", temporal.has_temporal_intent(F.col("literal")).alias("asks"))


@query("section_starts", "SELECT id, CASE section WHEN 'Session 3 - 4:05 pm on 7 May, 2023' THEN '2023-05-07T16:05:00Z' WHEN '2024-03-09' THEN '2024-03-09T00:00:00Z' WHEN 'July 4, 2020' THEN '2020-07-04T00:00:00Z' WHEN '9 June, 2019' THEN '2019-06-09T00:00:00Z' ELSE '' END AS start FROM notes", D.SQL["notes"])
def _(s, d):
    return D.notes(s, d).select("id", temporal.section_start(F.col("section")).alias("start"))
