"""Queries of the store, of sources and streams' batch forms, and of series and sets on data that gives rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import calendar, joins, publish, series
from ..operators.components import shared_folder
from ..sources.tables import table
from ..streaming.sentences import spoken
from .events import _RHYTHM
from .registry import query

# --- sentences ----------------------------------------------------------------------------------------------------


@query(
    r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?…]+["'')\]]*[ \t\n\r\f])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM conversations)
    SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS sentence FROM s"""
)
def spoken_sentences(spark, d):
    """What a stream of each turn's pieces gives, sentence by sentence."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(spoken(F.col("text"))).alias("n", "sentence"))


# --- sources and the store ----------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT DISTINCT user_id AS source, (1 + user_id % 5) * 3600.0 AS every FROM events),
    r AS (SELECT user_id AS source, epoch(ts) AS t, event_type <> 'error' AS ok FROM events),
    g AS (SELECT source, max(t) FILTER (WHERE ok) AS good, max(t) AS last FROM r GROUP BY source),
    f AS (SELECT r.source, count(*) AS n FROM r JOIN g ON r.source = g.source WHERE NOT ok AND (good IS NULL OR t > good) GROUP BY r.source), x AS (SELECT max(t) AS now FROM r),
    k AS (SELECT s.source, every, coalesce(n, 0) AS failures, good, last, now FROM s LEFT JOIN g ON s.source = g.source LEFT JOIN f ON s.source = f.source, x)
    SELECT source, every, failures, round(now - good, 3) AS since FROM k
    WHERE CASE WHEN failures > 0 THEN last + least(every, 60.0 * pow(2.0, least(failures - 1, 40))) <= now ELSE good IS NULL OR good + every <= now END"""
)
def due_sources(spark, d):
    """Users as sources that are read every few hours, errors as failed runs: whose turn it is at the last event."""
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    sources = e.select("source").distinct().withColumn("every", ((1 + F.col("source") % 5) * 3600).cast("double"))
    now = e.agg(F.max("at").alias("now"))  # one row
    found = publish.due(sources.crossJoin(F.broadcast(now)), e, F.col("now"))
    return found.withColumn("since", F.round("since", 3))


_TITLE = "trim(split_part(coalesce(text, ''), chr(10), 1))"
_KEY = r"substr(sha1(lower(trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '\s+', ' ', 'g')))), 1, 16)"


@query(
    f"""WITH d AS (SELECT {_KEY} AS group_key, doc_id, {_TITLE} AS q, text, source FROM documents WHERE {_TITLE} <> ''),
    m AS (SELECT max(doc_id) // 2 AS half FROM documents), g AS (SELECT group_key FROM d GROUP BY group_key HAVING max(doc_id) > (SELECT half FROM m)),
    b AS (SELECT group_key, doc_id AS place, '### ' || coalesce(nullif(concat_ws(' · ', nullif(trim(coalesce(source, '')), ''), 'doc' || doc_id), ''), 'source') || chr(10) || chr(10) || trim(coalesce(text, '')) AS block FROM d JOIN g USING (group_key)
      UNION ALL SELECT group_key, -1, '---' || chr(10) || 'hash: ' || group_key || chr(10) || 'sources: ' || count(*) || chr(10) || 'newest: ' || max(doc_id) || chr(10) || '---' || chr(10) || '# Question' || chr(10) || chr(10) || arg_min(q, doc_id) || chr(10) || chr(10) || '## Sources' FROM d JOIN g USING (group_key) GROUP BY group_key)
    SELECT group_key, CAST(place AS BIGINT) AS place, md5(block) AS block FROM b"""
)
def export_changed(spark, d):
    """Documents by their first line: the older half is exported, then all; what the second run wrote."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    store = publish.Store(spark, f"{shared_folder(spark)}/export-{uuid.uuid4().hex}")
    of = ("doc_id", F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.coalesce("source", F.lit("")), F.concat(F.lit("doc"), "doc_id"), F.col("text"))
    half = (docs.agg(F.max("doc_id")).first()[0] or 0) // 2
    publish.export(store, "groups", docs.where(F.col("doc_id") <= half), *of)
    publish.export(store, "groups", docs, *of)
    return publish.exported(store, "groups").where("run = 2").select("group_key", "place", F.md5("block").alias("block"))


# --- series and sets ----------------------------------------------------------------------------------------------

_REGULAR = """WITH regular AS (SELECT user_id, CAST(CASE user_id % 3 WHEN 0 THEN date_trunc('week', ts) + to_days(CAST(user_id % 7 AS INT)) WHEN 1 THEN DATE '2024-01-01' + CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 * 3 AS INT) ELSE ts END AS TIMESTAMP) AS ts FROM events),
"""
_OF_REGULAR = _REGULAR + _RHYTHM.removeprefix("WITH ").replace("FROM events", "FROM regular")


def _regular(spark, d):
    """Events on one day of the week, or every third day, as the user goes."""
    e = table(spark, d, "events")
    start = F.lit("2024-01-01").cast("date")
    week = F.date_add(F.date_trunc("week", "ts").cast("date"), (F.col("user_id") % 7).cast("int"))
    third = F.date_add(start, (F.floor(F.datediff(F.to_date("ts"), start) / 3) * 3).cast("int"))
    ts = F.when(F.col("user_id") % 3 == 0, week.cast("timestamp_ntz")).when(F.col("user_id") % 3 == 1, third.cast("timestamp_ntz")).otherwise(F.col("ts").cast("timestamp_ntz"))
    return e.select("user_id", ts.alias("ts"))


@query(_OF_REGULAR + " SELECT user_id, n, kind, period, round(s, 6) AS share, round(least(1.0, s * least(1.0, n / 8)), 3) AS confidence FROM r")
def rhythm_regular(spark, d):
    return series.detect_rhythm(_regular(spark, d), "user_id", "ts")


@query(
    _OF_REGULAR
    + ", l AS (SELECT user_id, max(day) AS last FROM d GROUP BY user_id), t AS (SELECT CAST(max(ts) AS DATE) + 9 AS today FROM events) SELECT r.user_id, kind, last, CAST(date_diff('day', last, today) AS INT) AS age, date_diff('day', last, today) > period + greatest(1.0, 0.5 * period) AS overdue FROM r JOIN l ON r.user_id = l.user_id, t"
)
def rhythm_regular_due(spark, d):
    """Nine days after the last event: who is overdue by their rhythm."""
    e = _regular(spark, d)
    last = e.groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last"))
    today = table(spark, d, "events").agg(F.date_add(F.max(F.to_date("ts")), 9).alias("today"))  # one row
    due = series.detect_rhythm(e, "user_id", "ts").join(last, "user_id").crossJoin(F.broadcast(today))
    age = F.datediff("today", "last")
    return due.select("user_id", "kind", "last", age.alias("age"), (age > F.col("period") + F.greatest(F.lit(1.0), 0.5 * F.col("period"))).alias("overdue"))


_YEAR = "SELECT o_custkey AS k FROM orders WHERE year(o_orderdate) = {0}"


@query(f"SELECT k, 'left' AS kind FROM ({_YEAR.format(1995)} EXCEPT {_YEAR.format(1996)}) UNION ALL SELECT k, 'both' FROM ({_YEAR.format(1995)} INTERSECT {_YEAR.format(1996)})")
def set_years(spark, d):
    """Customers of one year without, and with, those of the next."""
    of = lambda y: table(spark, d, "orders").where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k"))
    return of(1995).subtract(of(1996)).withColumn("kind", F.lit("left")).union(of(1995).intersect(of(1996)).withColumn("kind", F.lit("both")))


@query(
    """WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(split_part(coalesce(text, ''), chr(10), 1)), '[a-z0-9]{4,}')) AS w FROM documents),
    u AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM a),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s, any_value(x.n) AS nx, any_value(y.n) AS ny FROM u x JOIN u y ON x.t = y.t AND x.doc_id > y.doc_id AND x.doc_id - y.doc_id <= 14 * 24 GROUP BY x.doc_id, y.doc_id)
    SELECT DISTINCT a AS doc_id FROM p WHERE s >= 2 AND s >= ceil(round(0.8 * least(nx, ny), 6))"""
)
def fuzzy_topic_recent(spark, d):
    """Documents, one an hour, whose first line resembles one of the last 14 days."""
    first = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", first.alias("text"), (F.col("doc_id") * 3600.0).alias("at"))
    return joins.recent_topics(docs, "doc_id", "at", tokens(F.col("text"), 4)).select("doc_id")


# --- calendars ----------------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS s, o_orderkey % 3 AS f, CAST(1 + o_orderkey % 4 AS INT) AS n, CAST(5 + o_orderkey % 30 AS INT) AS c FROM orders WHERE day(o_orderdate) <= 28),
    x AS (SELECT k, f, n, c, s, unnest(range(0, c)) AS j FROM o),
    y AS (SELECT k, j, CASE f WHEN 0 THEN CAST(s + to_days(CAST(j * n AS INT)) AS DATE) WHEN 1 THEN CAST(s + to_days(CAST(7 * j * n AS INT)) AS DATE) ELSE CAST(s + to_months(CAST(j * n AS INT)) AS DATE) END AS day, s, n FROM x)
    SELECT k AS o_orderkey, day FROM y WHERE day >= DATE '1998-01-01' AND day < DATE '1998-07-01' AND day <> s + to_days(CAST(28 * n AS INT))"""
)
def calendar_expand(spark, d):
    """Orders as calendar files with a daily, weekly or monthly rule, counted, one date left out; what falls into half a year."""
    o = table(spark, d, "orders").where(F.dayofmonth("o_orderdate") <= 28)
    s, n = F.to_date("o_orderdate"), 1 + F.col("o_orderkey") % 4
    freq = F.when(F.col("o_orderkey") % 3 == 0, "DAILY").when(F.col("o_orderkey") % 3 == 1, "WEEKLY").otherwise("MONTHLY")
    lines = F.concat_ws(
        "\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "o_orderkey"), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(s, "yyyyMMdd")),
        F.concat(F.lit("RRULE:FREQ="), freq, F.lit(";INTERVAL="), n, F.lit(";COUNT="), 5 + F.col("o_orderkey") % 30),
        F.concat(F.lit("EXDATE;VALUE=DATE:"), F.date_format(F.date_add(s, (28 * n).cast("int")), "yyyyMMdd")), F.lit("END:VEVENT"),
    )
    events = calendar.entries(o.select("o_orderkey", lines.alias("ics")), "o_orderkey", "ics")
    seen = calendar.occurrences(events, F.lit("1998-01-01").cast("timestamp"), F.lit("1998-07-01").cast("timestamp"))
    return seen.select("o_orderkey", F.to_date("start").alias("day"))
