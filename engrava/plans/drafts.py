"""Views with text of the kinds that extraction and search meet: drafts of facts, notes with metadata, and literals that name times.

Each is made of the orders' keys by lists of examples; the same lists make the views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUBJECTS = ["Spear", "current time", "Feb 18, 2026", "conversation notes", "# Heading", "**Key Dates**", "[x] task", "3) item", "> quote", "2024-01-05 log", "unknown", "Ann Lee", "", "message 12", "a very long subject that goes on beyond forty characters", "[link](x)"]
PREDICATES = ["prefers", "status", "url", "is on", "dir/b.txt", "cell|two", "- bullet", "deadbeef1 merge", "123.45", "https://x.y", "located in", "email", "has", "decided on", "-----", "favorite color"]
OBJECTS = ["Berlin office", "yes", "true", "**", "http://x.com", "status", "ab", "---", "you must always flush", "the blue theme", "none.", "12,5 %", "Ann Lee", "engaged to Bob", "running on host 7", "email"]
PATHS = ["MEMORY.md", "memory/2024-01-05.md", "docs/memory/plan.md", "shared-context/a.txt", "x/auto-capture/1.md", "/tmp/auto-capture.md", "/var/folders/z.md", "github:issues/12", "slack:general", "src/main.py", "notes/todo.txt", ""]
SECTIONS = ["Session 3 - 4:05 pm on 7 May, 2023", "2024-03-09", "12 March 2021 review", "July 4, 2020", "Session 1: intro", "plan > details", "", "9 June, 2019"]
CONTENTS = ["we decided to ship this, final decision", "always use tabs, never spaces", "she prefers the dark style", "name: Ann, role: lead, works at the bank", "status: blocked, working on it", "rough idea, maybe a draft", "plain words", "conversation info (untrusted metadata) hello", "<relevant-memories> old", "HEARTBEAT_OK fine"]
LITERALS = ["2024-02-30 noted", "12 March 2021", "July 4, 2020", "in June 2019", "back in 1999", "last week", "next week", "last month", "next month", "today", "yesterday", "tomorrow", "3 days ago", "2 weeks ago", "14 months ago", "1 year ago", "the week before 9 June 2023", "week after July 4, 2020", "the week before yesterday", "5 May", "May 6", "31 February 2020", "some day", "no time at all", "30 February"]
ANCHORS = ["2024-03-31", "2023-01-15", "", "2020-02-29"]


NAMES = ["Ann Lee", "she", "\"Acme Corp.\"", "River Park", "42", "x", "Q", "they,", "  spaced   out ", "First Bank (the)", "", "ann lee", "topic of the day"]


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pick(values: list[str], at: str, spark: bool) -> str:
    n = len(values)
    return f"element_at(array({_list(values)}), cast({at} % {n} as int) + 1)" if spark else f"([{_list(values)}])[CAST({at} % {n} AS INTEGER) + 1]"


def _columns(spark: bool) -> dict[str, str]:
    div = "div" if spark else "//"
    p = lambda values, step: _pick(values, f"(o_orderkey {div} {step})", spark)
    drafts = f"""SELECT o_orderkey AS id, o_custkey AS memory_id, {p(SUBJECTS, 1)} AS subject, {p(PREDICATES, 3)} AS predicate, {p(OBJECTS, 7)} AS object,
 {p(["identity", "decision", "relationship", "preference", "location", "state", "temporal", "kv"], 2)} AS fact_type, {p(["llm", "rules"], 5)} AS method, (o_orderkey % 41) / 40.0{"D" if spark else "::DOUBLE"} AS confidence FROM orders"""
    notes = f"""SELECT o_orderkey AS id, {p(PATHS, 1)} AS source_file, {p(SECTIONS, 3)} AS section, {p(CONTENTS, 5)} AS content, {p(["agent1", "Agent2", ""], 1)} AS agent_id,
 {p(["agent1", "Ann", ""], 2)} AS agent_name, {p(["irc", "mail", ""], 3)} AS channel, {p(["#irc", ""], 7)} AS channel_name, {p(["irc", "web", ""], 11)} AS surface, {p(["m1", ""], 13)} AS model,
 {p(["s1", "S2", ""], 4)} AS session_key, {p(["2024-01-05T10:00:00Z", ""], 17)} AS timestamp_start, o_orderdate AS imported_at, (o_orderkey % 97) / 97.0{"D" if spark else "::DOUBLE"} AS score FROM orders"""
    literals = f"""SELECT o_orderkey AS id, {p(LITERALS, 1)} AS literal, {p(ANCHORS, 5)} AS anchor FROM orders"""
    alerts = f"""SELECT o_orderkey AS id, {p(["decay", "match", "conflict"], 1)} AS alert_type, {p(["info", "warning", "critical"], 2)} AS severity, {p(["agent1", "agent2", ""], 3)} AS agent_id,
 o_orderkey % 4 = 0 AS acknowledged, o_orderkey % 25 AS watch_id, o_orderdate AS created_at FROM orders"""
    names = f"""SELECT o_orderkey AS id, o_custkey AS memory_id, {p(NAMES, 1)} AS subject, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 11 END AS entity_id, {p(["location", "identity", "kv", "state"], 7)} AS fact_type, {p(PREDICATES, 3)} AS predicate,
 {p(OBJECTS, 7)} AS object, (o_orderkey % 41) / 40.0{"D" if spark else "::DOUBLE"} AS confidence FROM orders"""
    return {"drafts": drafts, "notes": notes, "literals": literals, "alerts": alerts, "names": names}


def _view(name: str):
    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_columns(True)[name].replace(" FROM orders", " FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))

    return view


#: ``id, memory_id, subject, predicate, object, fact_type, method, confidence``: facts as extraction proposes them.
drafts = _view("drafts")
#: ``id, source_file, section, content``, who wrote it where, ``imported_at`` and a ``score``: search results with metadata.
notes = _view("notes")
#: ``id, literal, anchor``.
literals = _view("literals")
#: ``id, alert_type, severity, agent_id, acknowledged, watch_id, created_at``.
alerts = _view("alerts")
#: ``id, memory_id, subject, entity_id, fact_type, predicate, object, confidence``: facts about things that have names, or pronouns.
names = _view("names")
#: The views for DuckDB, to be put among a query's common table expressions.
SQL = {name: f"{name} AS ({text})" for name, text in _columns(False).items()}
