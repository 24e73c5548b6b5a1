"""Literals that name times: normal forms, relative to an anchor where they need one, and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrava.plans.storage import join_small, materialize

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_NAME = "(" + "|".join(m.capitalize() for m in MONTHS) + ")"
_ASKS = r"(?i)\b(when|date|dated|day|week|month|year|yesterday|today|tomorrow|last week|next week|last month|next month)\b"
#: Fields of a normal form.
FIELDS = ("kind", "value", "start", "end", "precision", "resolution", "confidence")


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date of texts or numbers; null if there is none such."""
    return F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), F.lit("y-M-d")).cast("date")


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name))


def _text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def _form(kind: str, precision: str, resolution: str, confidence: float | None, value: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = [F.lit(kind), value if value is not None else none, start if start is not None else none, end if end is not None else none, F.lit(precision), F.lit(resolution), F.lit(confidence).cast("double")]
    return F.struct(*[c.alias(n) for c, n in zip(parts, FIELDS)])


def _cases(pairs: list[tuple[Column, Column]]) -> Column:
    """The first form whose condition holds; null if none does."""
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, form in pairs[1:]:
        out = out.when(condition, form)
    return out


def _months_around(d: Column, by: int | Column) -> tuple[Column, Column]:
    first = F.add_months(F.trunc(d, "MM"), by)
    return first, F.last_day(first)


def _relative(x: Column, at: Column) -> list[tuple[Column, Column]]:
    low, known, here = F.lower(x), at.isNotNull(), "resolved_from_anchor"
    span = lambda a, b: _form("date_range", "day", here, 0.9, start=_text(F.date_add(at, a)), end=_text(F.date_add(at, b)))
    month = lambda k: _form("date_range", "month", here, 0.85, start=_text(_months_around(at, k)[0]), end=_text(_months_around(at, k)[1]))
    point = lambda k: _form("date", "day", here, 0.9, value=_text(F.date_add(at, k)))
    out = [(known & (low == name), form) for name, form in (("last week", span(-7, -1)), ("next week", span(1, 7)), ("last month", month(-1)), ("next month", month(1)), ("today", point(0)), ("yesterday", point(-1)), ("tomorrow", point(1)))]
    ago = lambda g: F.regexp_extract(low, r"\b(\d+)\s+(day|week|month|year)s?\s+ago\b", g)
    n, unit = F.try_to_number(F.nullif(ago(1), F.lit("")), F.lit("999999")).cast("int"), ago(2)
    # Months are counted from the day: 31 March less one month runs over into March again.
    over = F.add_months(F.trunc(at, "MM"), -n)
    landed = F.date_add(over, F.dayofmonth(at) - 1)
    first, last = F.trunc(landed, "MM"), F.last_day(landed)
    year = F.year(at) - n
    week = F.date_add(at, -7 * n)
    out += [
        (known & (unit == "day"), _form("date", "day", here, 0.8, value=_text(F.date_add(at, -n)))),
        (known & (unit == "week"), _form("date_range", "week", here, 0.8, start=_text(week), end=_text(F.date_add(week, 6)))),
        (known & (unit == "month"), _form("date_range", "month", here, 0.78, start=_text(first), end=_text(last))),
        (known & (unit == "year"), _form("date_range", "year", here, 0.75, start=F.concat(year.cast("string"), F.lit("-01-01")), end=F.concat(year.cast("string"), F.lit("-12-31")))),
    ]
    return out


def _absolute(x: Column, at: Column) -> list[tuple[Column, Column]]:
    got = lambda pattern, g: F.regexp_extract(x, pattern, g)
    iso, dmy, mdy, my, y = r"\b(\d{4}-\d{2}-\d{2})\b", rf"(?i)\b(\d{{1,2}})\s+{_NAME}\s*,?\s+(\d{{4}})\b", rf"(?i)\b{_NAME}\s+(\d{{1,2}}),\s*(\d{{4}})\b", rf"(?i)\b{_NAME}\s+(\d{{4}})\b", r"\b((?:19|20)\d{2})\b"
    dm, md = rf"(?i)\b(\d{{1,2}})\s+{_NAME}\b", rf"(?i)\b{_NAME}\s+(\d{{1,2}})\b"
    day = lambda d, p: _form("date", "day", "absolute" if p else "resolved_from_anchor", 0.95 if p else 0.8, value=_text(d))
    d1, d2, d3 = _date(got(dmy, 3), _month(got(dmy, 2)), got(dmy, 1)), _date(got(mdy, 3), _month(got(mdy, 1)), got(mdy, 2)), _date(got(my, 2), _month(got(my, 1)), F.lit("1"))
    d4, d5 = _date(F.year(at), _month(got(dm, 2)), got(dm, 1)), _date(F.year(at), _month(got(md, 1)), got(md, 2))
    return [
        (got(iso, 1) != "", _form("date", "day", "absolute", 0.95, value=got(iso, 1))),
        (d1.isNotNull(), day(d1, True)),
        (d2.isNotNull(), day(d2, True)),
        (d3.isNotNull(), _form("date_range", "month", "absolute", 0.9, start=_text(d3), end=_text(F.last_day(d3)))),
        ((got(y, 1) != "") & ~F.lower(x).contains("ago"), _form("date_range", "year", "absolute", 0.85, start=F.concat(got(y, 1), F.lit("-01-01")), end=F.concat(got(y, 1), F.lit("-12-31")))),
        (d4.isNotNull(), day(d4, False)),
        (d5.isNotNull(), day(d5, False)),
    ]


def _plain(x: Column, at: Column) -> Column:
    asked = (x.rlike(_ASKS), _form("date_range", "unknown", "unresolved", None))
    return _cases([*_relative(x, at), *_absolute(x, at), asked])


def normalize(literal: Column, anchor: Column) -> Column:
    """The normal form of a literal as a struct of ``FIELDS``, or null; ``anchor`` is the day that relative ones count from, as text, empty if unknown.

    In order: the week before or after another literal, ranges and points relative to the anchor, absolute dates, months and years, days without a
    year; what asks for a time without naming one is unresolved. Everything is one expression in columns.
    """
    x, at = F.trim(literal), F.try_to_timestamp(F.nullif(F.substring(F.trim(anchor), 1, 10), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    rest = [F.trim(F.regexp_extract(x, rf"(?i)\b(?:the\s+)?week\s+{word}\s+(.+)$", 1)) for word in ("before", "after")]
    forms = F.transform(F.array(*rest, x), lambda y: _plain(y, at))  # one lambda: the rules stand in the plan once
    pairs = []
    for k, (lo, hi) in enumerate(((-7, -1), (1, 7))):
        base = F.try_to_timestamp(F.coalesce(forms[k]["value"], forms[k]["start"]), F.lit("yyyy-MM-dd")).cast("date")
        pairs.append((base.isNotNull(), _form("date_range", "day", "resolved_from_anchor", 0.9, start=_text(F.date_add(base, lo)), end=_text(F.date_add(base, hi)))))
    return F.coalesce(_cases(pairs), forms[2])


def normalized(rows: DataFrame, form: str = "f") -> DataFrame:
    """``rows`` (``literal, anchor``) with their normal forms. Each distinct pair of texts is read once, however often it comes; a join brings its form to the rows."""
    keyed = rows.withColumn("_anchor", F.coalesce("anchor", F.lit("")))
    pairs = materialize(keyed.select("literal", "_anchor").distinct().withColumn(form, normalize(F.col("literal"), F.col("_anchor"))), "time-forms")
    return join_small(keyed, pairs, ["literal", "_anchor"], "left").select(*rows.columns, form)


def summary(form: Column) -> Column:
    """The value, or the range; empty if there is neither."""
    whole = F.when(form["end"].isNotNull() & (form["start"] != form["end"]), F.concat(form["start"], F.lit(".."), form["end"])).otherwise(form["start"])
    return F.coalesce(form["value"], whole, F.lit(""))


def matches(query: Column, form: Column) -> Column:
    """Whether two normal forms meet: equal values, else ranges that overlap; not where one has neither."""
    qe, ne = F.coalesce(query["end"], query["start"]), F.coalesce(form["end"], form["start"])
    overlap = ~((qe < form["start"]) | (ne < query["start"]))
    return F.when(query["value"].isNotNull() & form["value"].isNotNull(), query["value"] == form["value"]).otherwise(F.coalesce(overlap, F.lit(False)))


def has_temporal_intent(query: Column) -> Column:
    """Whether a query asks for a time or names one."""
    return (F.trim(query) != "") & (query.rlike(_ASKS) | normalize(query, F.lit("")).isNotNull())


def section_start(section: Column) -> Column:
    """The instant that a section's heading names, as ``yyyy-MM-ddTHH:mm:ssZ``, or empty: a clock time on a date, or a date, as a whole or within it."""
    x = F.trim(section)
    bare = F.trim(F.regexp_replace(x, r"(?i)^\s*session\s+\d+\s*[-—:]\s*", ""))
    name = "(?:" + _NAME[1:]
    inside = [rf"(?i)\b\d{{1,2}}:\d{{2}}\s*(?:am|pm)\s+on\s+\d{{1,2}}\s+{name}\s*,\s*\d{{4}}\b", rf"(?i)\b\d{{1,2}}\s+{name}\s*,?\s+\d{{4}}\b", rf"(?i)\b{name}\s+\d{{1,2}},\s*\d{{4}}\b", r"\b\d{4}-\d{2}-\d{2}\b"]
    candidates = [x, bare, *[F.regexp_extract(bare, p, 0) for p in inside]]
    found = F.filter(F.transform(F.array(*candidates), _stamp), lambda t: t.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def _stamp(c: Column) -> Column:
    """The instant that a text is, as a whole; else null."""
    clock = r"(?i)^(\d{1,2}):(\d{2}) (am|pm) on "
    shapes = [(clock + rf"(\d{{1,2}}) {_NAME}, (\d{{4}})$", (6, 5, 4)), (clock + rf"{_NAME} (\d{{1,2}}), (\d{{4}})$", (6, 4, 5)), (rf"(?i)^(\d{{1,2}}) {_NAME}, (\d{{4}})$", (3, 2, 1)), (rf"(?i)^{_NAME} (\d{{1,2}}), (\d{{4}})$", (3, 1, 2))]
    stamps = []
    for shape, (y, m, d) in shapes:
        got = lambda g, shape=shape: F.regexp_extract(c, shape, g)
        day = _text(_date(got(y), _month(got(m)), got(d)))
        if shape.startswith(clock):
            hour = F.try_to_number(F.nullif(got(1), F.lit("")), F.lit("99")).cast("int") % 12 + F.when(F.lower(got(3)) == "pm", 12).otherwise(0)
            stamps.append(F.when(got(1).rlike("^0?[1-9]$|^1[0-2]$"), F.concat(day, F.lit("T"), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), got(2), F.lit(":00Z"))))
        else:
            stamps.append(F.concat(day, F.lit("T00:00:00Z")))
    iso = F.nullif(F.regexp_extract(c, r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$", 0), F.lit(""))
    whole = F.when(F.length(iso) == 20, iso).otherwise(F.concat(iso, F.lit("T00:00:00Z")))
    return F.coalesce(*stamps, F.when(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull(), whole))
