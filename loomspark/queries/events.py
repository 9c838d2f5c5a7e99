"""Queries of the aggregate, window, series, clock and fold operators over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.text import norm, tokens
from ..functions.vectors import overlap
from ..operators import aggregates, archive, folds, series, windows, working
from ..sources.tables import table
from ..streaming.events import session_windows as sessions_by_gap
from ..streaming.events import tumbling_counts as tumbling
from .registry import query


def _events(spark, d):
    return table(spark, d, "events")


# --- aggregates ------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS n FROM documents WHERE coalesce(source, '') <> '' GROUP BY source")
def agg_source_counts(spark, d):
    return table(spark, d, "documents").where("coalesce(source, '') <> ''").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 4")
def agg_having(spark, d):
    return _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 4")


@query(
    """SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE value > 50) AS n_big,
    round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS click_rate, round(coalesce(count(*) FILTER (WHERE value > 50) / count(*), 0), 6) AS big_rate FROM events GROUP BY user_id"""
)
def agg_rates(spark, d):
    return aggregates.rates(_events(spark, d), ["user_id"], click=F.col("event_type") == "click", big=F.col("value") > 50)


@query("SELECT event_type, round(count(*) FILTER (WHERE value > 25) / count(*), 6) AS helpful_rate, round(coalesce(avg(value), 0), 4) AS mean_value FROM events GROUP BY event_type")
def agg_effectiveness(spark, d):
    rate = F.try_divide(F.count_if(F.col("value") > 25), F.count("*"))
    return _events(spark, d).groupBy("event_type").agg(F.round(F.coalesce(rate, F.lit(0.0)), 6).alias("helpful_rate"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean_value"))


@query("SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type || ':' || n) AS counts, CAST(sum(n) AS BIGINT) AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL) GROUP BY user_id")
def agg_map_counts(spark, d):
    return aggregates.counts_as_map(_events(spark, d), ["user_id"], "event_type")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def agg_pivot(spark, d):
    found = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return found.select("o_orderpriority", *[F.coalesce(c.upper(), F.lit(0)).cast("long").alias(c) for c in ("f", "o", "p")])


_HOURS = ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h})" for h in range(24))
_DAYS = ", ".join(f"count(*) FILTER (WHERE isodow(ts) = {w + 1})" for w in range(7))


@query(f"SELECT event_type, array_to_string([{_HOURS}], ',') AS hours, array_to_string([{_DAYS}], ',') AS weekdays, count(*) AS n FROM events GROUP BY event_type")
def hist_hour_weekday(spark, d):
    e = _events(spark, d)
    hours = aggregates.histogram(e, ["event_type"], F.hour("ts"), 24)
    days = aggregates.histogram(e, ["event_type"], F.weekday("ts"), 7).select("event_type", F.col("counts").alias("w"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return hours.join(days, "event_type").select("event_type", text("counts").alias("hours"), text("w").alias("weekdays"), "n")


@query(
    """WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS c FROM events GROUP BY ALL), m AS (SELECT user_id, max(c) AS m FROM h GROUP BY user_id)
    SELECT h.user_id, string_agg(lpad(CAST(h AS VARCHAR), 2, '0'), ',' ORDER BY h) AS peak_hours, max(c) AS top FROM h JOIN m ON h.user_id = m.user_id WHERE c >= greatest(2, 0.5 * m) GROUP BY h.user_id"""
)
def rhythm_peaks(spark, d):
    counts = aggregates.histogram(_events(spark, d), ["user_id"], F.hour("ts"), 24)
    top = F.array_max("counts")
    slots = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda i: F.element_at("counts", i + 1) >= F.greatest(F.lit(2), 0.5 * top))
    return counts.select("user_id", F.array_join(F.transform(slots, lambda i: F.lpad(i.cast("string"), 2, "0")), ",").alias("peak_hours"), top.alias("top")).where("peak_hours <> ''")


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value > 0) AS n_ok, max(ts) AS last_ts, round(avg(CASE WHEN value < 90 THEN value END), 3) AS mean_elapsed FROM events GROUP BY event_type")
def agg_ledger(spark, d):
    return aggregates.ledger(_events(spark, d), ["event_type"], F.col("value") > 0, F.when(F.col("value") < 90, F.col("value")), "ts")


@query(
    """SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS allowed, round(coalesce(sum(value) FILTER (WHERE event_type <> 'view'), 0), 2) AS volume, count(*) FILTER (WHERE event_type = 'view') AS denied,
    arg_max(ts, event_id) AS last_ts, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS last_allowed FROM events GROUP BY user_id"""
)
def agg_traffic(spark, d):
    """last_ts is the last in arrival order, not the largest."""
    ok = F.col("event_type") != "view"
    return _events(spark, d).groupBy("user_id").agg(
        F.count_if(ok).alias("allowed"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("value"))), F.lit(0.0)), 2).alias("volume"),
        F.count_if(~ok).alias("denied"),
        F.max_by("ts", "event_id").alias("last_ts"),
        F.max_by("event_type", F.when(ok, F.col("event_id"))).alias("last_allowed"),
    )


@query(
    r"""WITH k AS (SELECT doc_id, coalesce(lang, '') AS lang, sha1(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))) AS content_key, n_chars % 3 AS seen, source FROM documents),
    g AS (SELECT lang, content_key, min(doc_id) AS survivor, CAST(sum(greatest(coalesce(seen, 0), 1)) AS BIGINT) AS observed, max(doc_id) AS newest, string_agg(DISTINCT source, '|' ORDER BY source) AS support FROM k GROUP BY ALL)
    SELECT doc_id, CASE WHEN doc_id = survivor THEN 'active' ELSE 'merged' END AS status, CASE WHEN doc_id = survivor THEN observed END AS observed, CASE WHEN doc_id = survivor THEN newest END AS newest, CASE WHEN doc_id = survivor THEN support END AS support FROM k JOIN g USING (lang, content_key)"""
)
def merge_sweep(spark, d):
    """Documents as cards of a language: equal folded texts become one, which takes their counts and sources."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text", "source", (F.col("n_chars") % 3).alias("seen"))
    return aggregates.merge_sweep(docs, ["lang"], norm(F.col("text")), "doc_id", F.col("seen"), "source").select("doc_id", "status", "observed", "newest", "support")


@query("SELECT count(*) AS n, max(event_id) AS last_id, max(ts) AS last_ts, count(*) FILTER (WHERE value IS NULL) AS n_null, count(*) FILTER (WHERE event_id > 500) AS backlog FROM events")
def agg_scalars(spark, d):
    return _events(spark, d).agg(
        F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.max("ts").alias("last_ts"), F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.col("event_id") > 500).alias("backlog")
    )


@query("SELECT c_custkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS n_open FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def agg_child_counts(spark, d):
    opened = table(spark, d, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(opened, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_open"))


@query("SELECT user_id, event_type, sum(CAST(round(value * 100) AS BIGINT)) / count(*) AS confidence, count(*) AS evidence, arg_min(value, event_id) AS pattern_value FROM events GROUP BY ALL")
def agg_running_mean(spark, d):
    """The mean in hundredths, as whole numbers sum exactly; the pattern's value is the first one seen and never changes."""
    return _events(spark, d).groupBy("user_id", "event_type").agg(F.avg(F.round(F.col("value") * 100).cast("long")).alias("confidence"), F.count("*").alias("evidence"), F.min_by("value", "event_id").alias("pattern_value"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t FROM c GROUP BY user_id) SELECT c.user_id, CAST(any_value(t) AS BIGINT) AS n, round(greatest(0.0, -sum(c.n / t * ln(c.n / t))), 6) AS entropy FROM c JOIN t ON c.user_id = t.user_id GROUP BY c.user_id")
def entropy_by_group(spark, d):
    return aggregates.entropy(_events(spark, d), ["user_id"], "event_type")


_STATE = "CASE WHEN value > 90 THEN 'failed' WHEN value > 60 THEN 'stale' ELSE 'fine' END"


@query(
    f"SELECT user_id, count(*) FILTER (WHERE s = 'failed') AS n_failed, count(*) FILTER (WHERE s = 'stale') AS n_stale, count(*) FILTER (WHERE s = 'fine') AS n_fine, arg_min(s, CASE s WHEN 'failed' THEN 1 WHEN 'stale' THEN 2 ELSE 3 END) AS worst FROM (SELECT user_id, {_STATE} AS s FROM events) GROUP BY user_id"
)
def agg_worst_state(spark, d):
    return aggregates.worst_state(_events(spark, d), ["user_id"], F.expr(_STATE), ["failed", "stale", "fine"])


# --- windows and series ------------------------------------------------------------------------------------------


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50")
def events_tail(spark, d):
    return _events(spark, d).select("event_id", "ts", "user_id", "event_type").orderBy(F.desc("event_id")).limit(50)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def chat_recent_window(spark, d):
    return windows.top_per_group(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 3)


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def keep_last_n(spark, d):
    return archive.keep_last(_events(spark, d).select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)


@query("SELECT user_id, event_type, arg_max(value, struct_pack(t := ts, i := event_id)) AS value FROM events GROUP BY ALL")
def latest_per_key(spark, d):
    return windows.latest_per_key(_events(spark, d), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("SELECT user_id, CAST(ts AS DATE) AS day, arg_min(event_id, struct_pack(t := ts, i := event_id)) AS event_id FROM events GROUP BY ALL")
def first_per_day(spark, d):
    return windows.first_per_day(_events(spark, d).select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id").select("user_id", "day", "event_id")


@query("SELECT * FROM (SELECT event_id, user_id, CAST(date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS INT) AS gap_days FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap_days IS NOT NULL")
def gap_series(spark, d):
    return windows.gaps(_events(spark, d).select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id").select("event_id", "user_id", "gap_days")


@query(
    """WITH s AS (SELECT event_id, user_id, ts, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM events)
    SELECT event_id, user_id, session, CAST(floor(epoch(ts)) - floor(epoch(first_value(ts) OVER (PARTITION BY user_id, session ORDER BY ts, event_id))) AS BIGINT) AS offset_s FROM s"""
)
def sessionize(spark, d):
    out = windows.sessions(_events(spark, d).select("event_id", "user_id", "ts", "event_type"), ["user_id"], "ts", "event_id", F.col("event_type") == "click")
    return out.select("event_id", "user_id", "session", "offset_s")


@query(
    """SELECT conv_id, turn, running FROM (SELECT conv_id, turn, CAST(sum(least(length(text), 400)) OVER w AS BIGINT) AS running, row_number() OVER w AS rn FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE running <= 600 OR rn = 1"""
)
def running_budget(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'")
    return windows.within_budget(turns, ["conv_id"], [F.asc("turn")], F.least(F.length("text"), F.lit(400)), 600).select("conv_id", "turn", "running")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topn_per_group(spark, d):
    return windows.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


_CHANGES = """WITH b AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER w AS before, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT * FROM b WHERE rn = 1 OR o_orderstatus IS DISTINCT FROM before)"""


@query(_CHANGES + " SELECT o_custkey, o_orderkey, o_orderstatus FROM c")
def change_points(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return windows.change_points(orders, ["o_custkey"], "o_orderstatus", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query(_CHANGES + " SELECT o_custkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER v AS valid_to, lead(o_orderkey) OVER v AS superseded_by, lead(o_orderdate) OVER v IS NULL AS active FROM c WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def scd2_history(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return windows.history(orders, ["o_custkey"], "o_orderstatus", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderstatus", "valid_from", "valid_to", "superseded_by", "active")


@query(
    """WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{1,}')) AS w FROM conversations WHERE role = 'assistant'),
    p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)
    SELECT conv_id, turn, round(CASE WHEN least(len(w), len(b)) = 0 THEN 0 ELSE len(list_intersect(w, b)) / least(len(w), len(b)) END, 6) AS share FROM p WHERE b IS NOT NULL"""
)
def repeat_reply(spark, d):
    turns = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    before = turns.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return before.select("conv_id", "turn", F.round(overlap(F.col("w"), F.col("b")), 6).alias("share"))


_RHYTHM = """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
g AS (SELECT user_id, day, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap, isodow(day) - 1 AS wd, day(day) AS dom,
  (isodow(day) - 1) * 10 + CASE WHEN month(day + 7) <> month(day) THEN 9 ELSE CAST(ceil(day(day) / 7.0) AS INT) END AS nth FROM d),
m AS (SELECT user_id, count(*) AS n, date_diff('day', min(day), max(day)) AS span, median(gap) AS med FROM g GROUP BY user_id HAVING count(*) >= 4),
w AS (SELECT user_id, wd, count(*) AS c FROM g GROUP BY user_id, wd QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(day)) = 1),
wg AS (SELECT user_id, date_diff('day', lag(day) OVER (PARTITION BY user_id ORDER BY day), day) AS gap FROM g JOIN w USING (user_id, wd)),
wm AS (SELECT user_id, coalesce(median(gap), 7) AS wd_med FROM wg GROUP BY user_id),
q AS (SELECT user_id, max(c) AS c FROM (SELECT user_id, dom, count(*) AS c FROM g GROUP BY ALL) GROUP BY user_id),
h AS (SELECT user_id, max(c) AS c FROM (SELECT user_id, nth, count(*) AS c FROM g GROUP BY ALL) GROUP BY user_id),
f AS (SELECT g.user_id, count(*) FILTER (WHERE abs(gap - greatest(1, round_even(gap / med, 0)) * med) <= greatest(1.0, 0.25 * med)) / count(*) AS near FROM g JOIN m ON g.user_id = m.user_id WHERE gap IS NOT NULL GROUP BY g.user_id),
a AS (SELECT m.user_id, n, span, med, wd_med, w.c / n AS wd, q.c / n AS dom, h.c / n AS nth, near FROM m JOIN w USING (user_id) JOIN wm USING (user_id) JOIN q ON m.user_id = q.user_id JOIN h ON m.user_id = h.user_id JOIN f ON m.user_id = f.user_id),
k AS (SELECT *, CASE WHEN wd >= 0.7 AND span >= 21 AND wd_med BETWEEN 5 AND 9 THEN 'weekly' WHEN wd >= 0.7 AND span >= 21 AND wd_med BETWEEN 12 AND 16 THEN 'biweekly' WHEN dom >= 0.7 AND span >= 60 THEN 'monthly-dom'
  WHEN nth >= 0.7 AND span >= 60 THEN 'monthly-nth' WHEN near >= 0.6 AND med >= 2 THEN 'interval' END AS kind FROM a),
r AS (SELECT user_id, n, kind, CAST(CASE kind WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 WHEN 'interval' THEN med ELSE 30 END AS DOUBLE) AS period, CASE kind WHEN 'interval' THEN near WHEN 'monthly-dom' THEN dom WHEN 'monthly-nth' THEN nth ELSE wd END AS s FROM k WHERE kind IS NOT NULL)"""


@query(_RHYTHM + " SELECT user_id, n, kind, period, round(s, 6) AS share, round(least(1.0, s * least(1.0, n / 8)), 3) AS confidence FROM r")
def detect_rhythm(spark, d):
    return series.detect_rhythm(_events(spark, d), "user_id", "ts")


@query(
    _RHYTHM
    + """, c AS (SELECT user_id, kind, period, round(least(1.0, s * least(1.0, n / 8)), 3) AS confidence FROM r), o AS (SELECT user_id, 'weekly' AS kind, 7.0 AS period, 0.5 AS confidence, CASE WHEN user_id % 4 = 0 THEN 'dismissed' ELSE 'active' END AS status FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 2 = 0)
    SELECT coalesce(o.user_id, c.user_id) AS user_id, CASE WHEN o.status = 'dismissed' OR c.user_id IS NULL THEN o.kind ELSE c.kind END AS kind, CAST(CASE WHEN o.status = 'dismissed' OR c.user_id IS NULL THEN o.period ELSE c.period END AS DOUBLE) AS period,
    CAST(CASE WHEN o.status = 'dismissed' OR c.user_id IS NULL THEN o.confidence ELSE c.confidence END AS DOUBLE) AS confidence, CASE WHEN o.status = 'dismissed' THEN 'dismissed' ELSE 'active' END AS status FROM o FULL JOIN (SELECT * FROM c WHERE confidence >= 0.4) c ON o.user_id = c.user_id"""
)
def rhythm_store(spark, d):
    """Every other user has a weekly rhythm stored, every fourth has dismissed it."""
    e = _events(spark, d)
    stored = e.select("user_id").distinct().where("user_id % 2 = 0").select(
        "user_id", F.lit("weekly").alias("kind"), F.lit(7.0).alias("period"), F.lit(0.5).alias("confidence"), F.when(F.col("user_id") % 4 == 0, "dismissed").otherwise("active").alias("status")
    )
    return series.store_rhythms(stored, series.detect_rhythm(e, "user_id", "ts"), "user_id")


@query(
    _RHYTHM
    + ", l AS (SELECT user_id, max(day) AS last FROM d GROUP BY user_id), t AS (SELECT CAST(max(ts) AS DATE) AS today FROM events) SELECT r.user_id, kind, last, CAST(date_diff('day', last, today) AS INT) AS age, date_diff('day', last, today) > period + greatest(1.0, 0.5 * period) AS overdue FROM r JOIN l ON r.user_id = l.user_id, t"
)
def rhythm_due(spark, d):
    e = _events(spark, d)
    last = e.groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last"))
    today = e.agg(F.max(F.to_date("ts")).alias("today"))  # one row
    due = series.detect_rhythm(e, "user_id", "ts").join(last, "user_id").crossJoin(F.broadcast(today))
    age = F.datediff("today", "last")
    return due.select("user_id", "kind", "last", age.alias("age"), (age > F.col("period") + F.greatest(F.lit(1.0), 0.5 * F.col("period"))).alias("overdue"))


@query(
    """WITH i AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, 1 + o_orderkey % 5 AS step FROM orders),
    x AS (SELECT o_orderkey, CAST(unnest(generate_series(CAST(s AS TIMESTAMP), CAST(s + 21 AS TIMESTAMP), to_days(CAST(step AS INT)))) AS DATE) AS day, s FROM i)
    SELECT o_orderkey, day FROM x WHERE day BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND date_diff('day', s, day) <> 6"""
)
def interval_expand(spark, d):
    """Recurring entries made from orders, without the exception dates (the sixth day)."""
    rows = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("s"), (1 + F.col("o_orderkey") % 5).alias("step"))
    rows = rows.withColumn("until", F.date_add("s", 21))
    return series.expand_intervals(rows, ["o_orderkey"], "s", "until", "step", rows.select("o_orderkey", F.date_add("s", 6).alias("day")), F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return tumbling(_events(spark, d), "ts", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM n GROUP BY user_id, k HAVING count(*) >= 2"""
)
def session_windows(spark, d):
    found = sessions_by_gap(_events(spark, d), "ts", ["user_id"], "6 hours", 2)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("SELECT event_id, hour(ts) * 60 + minute(ts) >= 1320 OR hour(ts) * 60 + minute(ts) < 420 AS quiet FROM events")
def quiet_hours(spark, d):
    return _events(spark, d).select("event_id", clock.in_minutes(F.col("ts"), 22 * 60, 7 * 60).alias("quiet"))


_PART = "CASE WHEN hour(ts) < 5 THEN 'the small hours' WHEN hour(ts) < 8 THEN 'early morning' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 14 THEN 'midday' WHEN hour(ts) < 18 THEN 'afternoon' WHEN hour(ts) < 22 THEN 'evening' ELSE 'night' END"
_DAY = "CASE WHEN isodow(ts) >= 6 THEN 'the weekend' WHEN isodow(ts) = 1 THEN 'the start of the work week' WHEN isodow(ts) = 5 THEN 'the end of the work week' ELSE 'midweek' END"
_SEASON = "CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) <= 5 THEN 'spring' WHEN month(ts) <= 8 THEN 'summer' ELSE 'autumn' END"


@query(f"SELECT event_id, {_PART} AS part, {_SEASON} AS season, isodow(ts) >= 6 AS weekend, {_DAY} AS day FROM events")
def semantic_clock(spark, d):
    return _events(spark, d).select("event_id", clock.part_of_day(F.hour("ts")).alias("part"), clock.season(F.month("ts")).alias("season"), (F.weekday("ts") >= 5).alias("weekend"), clock.day_descriptor(F.weekday("ts")).alias("day"))


@query(
    """WITH q AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m FROM events), p AS (SELECT event_id, CAST(floor((m + 7) / 15.0) AS INT) AS q FROM q),
    n AS (SELECT ['twelve','one','two','three','four','five','six','seven','eight','nine','ten','eleven'] AS w)
    SELECT event_id, CASE q % 4 WHEN 0 THEN w[(q // 4) % 12 + 1] || ' o''clock' WHEN 1 THEN 'quarter past ' || w[(q // 4) % 12 + 1] WHEN 2 THEN 'half past ' || w[(q // 4) % 12 + 1] ELSE 'quarter to ' || w[(q // 4 + 1) % 12 + 1] END AS spoken FROM p, n"""
)
def spoken_when(spark, d):
    return _events(spark, d).select("event_id", clock.spoken_time(F.col("ts")).alias("spoken"))


@query(
    "WITH t AS (SELECT max(ts) AS now FROM events), m AS (SELECT event_id, floor((floor(epoch(now)) - floor(epoch(ts))) / 60) AS m FROM events, t) SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN CAST(m AS BIGINT) || ' min ago' WHEN m < 1440 THEN CAST(floor(m / 60) AS BIGINT) || ' h ago' ELSE CAST(floor(m / 1440) AS BIGINT) || ' d ago' END AS said FROM m"
)
def rel_time(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max("ts").alias("now"))  # one row
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select("event_id", "ts").crossJoin(F.broadcast(now)).select("event_id", clock.relative_time(age).alias("said"))


_REFS = "CASE event_id % 5 WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' WHEN 2 THEN 'weekday:friday:this' WHEN 3 THEN 'relative:+' || (event_id % 90) ELSE 'someday' END"


@query(f"WITH r AS (SELECT event_id, CAST(ts AS DATE) AS t, {_REFS} AS ref FROM events) SELECT event_id, ref, CAST(CASE WHEN ref = 'today' THEN t WHEN ref = 'tomorrow' THEN t + 1 WHEN ref LIKE 'weekday%' THEN t + CAST((5 - isodow(t) + 7) % 7 AS INT) WHEN ref LIKE 'relative%' THEN t + CAST(event_id % 90 AS INT) END AS DATE) AS day FROM r")
def resolve_dateref(spark, d):
    rows = _events(spark, d).select("event_id", F.to_date("ts").alias("t"), F.expr(_REFS).alias("ref"))
    return rows.select("event_id", "ref", clock.resolve_date(F.col("ref"), F.col("t")).alias("day"))


@query(f"SELECT event_id, ref <> 'someday' AS valid FROM (SELECT event_id, {_REFS} AS ref FROM events)")
def dateref_valid(spark, d):
    return _events(spark, d).select("event_id", F.expr(_REFS).alias("ref")).select("event_id", F.rlike("ref", F.lit(clock.DATE_REF)).alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN floor(epoch(ts)) END AS at FROM events")
def parse_ts(spark, d):
    """Times written in three ways, and some that can't be read, back as epoch seconds."""
    way = F.col("event_id") % 4
    text = (
        F.when(way == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(way == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(way == 2, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .otherwise(F.lit("soon"))
    )
    return _events(spark, d).select("event_id", clock.parse_time(text).alias("at"))


@query("SELECT event_id, round(pow(0.5, (epoch((SELECT max(ts) FROM events)) - epoch(ts)) / 1209600.0), 6) AS recency FROM events")
def recency_decay(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max(clock.epoch(F.col("ts"))).alias("now"))  # one row
    return e.select("event_id", "ts").crossJoin(F.broadcast(now)).select("event_id", F.round(clock.half_life(F.col("now") - clock.epoch(F.col("ts")), 1209600.0), 6).alias("recency"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return _events(spark, d).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("WITH n AS (SELECT min(ts) + INTERVAL 5 DAY AS now FROM events) SELECT event_id, CAST(floor((floor(epoch(ts)) - floor(epoch(now))) / 60) AS BIGINT) AS minutes FROM events, n WHERE floor(epoch(ts)) - floor(epoch(now)) BETWEEN 0 AND 7200 ORDER BY ts, event_id LIMIT 20")
def upcoming_window(spark, d):
    e = _events(spark, d)
    now = e.agg((F.min("ts") + F.expr("INTERVAL 5 DAY")).alias("now"))  # one row
    ahead = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("now").cast("timestamp"))
    return e.crossJoin(F.broadcast(now)).where(ahead.between(0, 7200)).orderBy("ts", "event_id").limit(20).select("event_id", F.floor(ahead / 60).alias("minutes"))


@query("WITH n AS (SELECT CAST(max(ts) AS DATE) AS now FROM events) SELECT event_id, event_type FROM events, n WHERE CASE event_type WHEN 'click' THEN date_diff('day', CAST(ts AS DATE), now) <= 3 WHEN 'view' THEN true ELSE date_diff('day', CAST(ts AS DATE), now) <= 10 END")
def retention_by_category(spark, d):
    e = _events(spark, d)
    now = e.agg(F.max(F.to_date("ts")).alias("now"))  # one row
    return archive.retain(e.crossJoin(F.broadcast(now)), "event_type", "ts", F.col("now"), {"click": 3, "view": 0}, 10).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 95)")
def queue_antijoin(spark, d):
    e = _events(spark, d)
    queue = e.where("event_type = 'purchase'").select("user_id", "value")
    return archive.not_queued(e.where("event_type = 'click'"), queue, "user_id", F.col("value") > 95).select("event_id", "user_id")


@query("SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) FILTER (WHERE l_linestatus = 'O') = 0")
def parent_complete(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "O").alias("open"))
    return lines.where("open = 0").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))


_OP = "CASE WHEN event_id % 7 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'update' ELSE 'add' END"


@query(
    f"""WITH o AS (SELECT user_id, event_id, {_OP} AS op, CASE WHEN event_id % 5 > 0 THEN value END AS v FROM events),
    s AS (SELECT user_id, arg_max(op, event_id) AS op, max(event_id) FILTER (WHERE op = 'delete') AS gone, max(event_id) FILTER (WHERE op <> 'delete' AND v IS NOT NULL) AS at_id, arg_max(v, event_id) FILTER (WHERE op <> 'delete' AND v IS NOT NULL) AS v FROM o GROUP BY user_id)
    SELECT user_id, CASE WHEN gone IS NULL OR at_id > gone THEN v END AS v FROM s WHERE op <> 'delete'"""
)
def cdc_apply(spark, d):
    ops = _events(spark, d).select("user_id", "event_id", F.expr(_OP).alias("op"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("v"))
    return archive.apply_changes(ops, "user_id", "op", "v", ["event_id"])


# --- folds -------------------------------------------------------------------------------------------------------


def _activation_sql(tau: float, boost: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id, event_type AS item, epoch(ts) AS tm, {boost} AS b FROM events),
    m AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY tm) AS rn, count(*) OVER (PARTITION BY user_id, item) AS n FROM (SELECT user_id, item, tm, sum(b) AS b FROM e GROUP BY ALL)),
    f AS (SELECT user_id, item, rn, n, tm, least(1.0, b)::DOUBLE AS v FROM m WHERE rn = 1 UNION ALL
      SELECT m.user_id, m.item, m.rn, m.n, m.tm, least(1.0, CASE WHEN f.v * exp((f.tm - m.tm) / {tau}) < 0.02 THEN 0 ELSE f.v * exp((f.tm - m.tm) / {tau}) END + m.b)::DOUBLE FROM f JOIN m ON m.user_id = f.user_id AND m.item = f.item AND m.rn = f.rn + 1),
    t AS (SELECT user_id, max(tm) AS last FROM e GROUP BY user_id)
    SELECT user_id, item, round(v * exp((tm - last) / {tau}), 6) AS activation FROM f JOIN t USING (user_id) WHERE rn = n AND (tm = last OR v * exp((tm - last) / {tau}) >= 0.02)"""


@query(_activation_sql(900.0, "0.5"))
def activation_fold(spark, d):
    e = _events(spark, d).select("user_id", clock.epoch(F.col("ts")).alias("at"), "event_type")
    return working.activation(e, "user_id", "at", "event_type")


@query(_activation_sql(86400.0, "CASE WHEN event_type IN ('click', 'purchase') THEN 0.5 ELSE 0.35 END"))
def activation_boosts(spark, d):
    """Both boosts, with a decay of a day: what was used directly gains more than what was only met."""
    e = _events(spark, d).select("user_id", clock.epoch(F.col("ts")).alias("at"), "event_type")
    direct = F.col("event_type").isin("click", "purchase")
    return working.activation(e, "user_id", "at", "event_type", F.when(direct, working.SURFACED).otherwise(working.MENTIONED), tau=86400.0)


_SIGNAL = "SELECT user_id, event_type, event_id, CASE WHEN value > 98 THEN 'expert' WHEN value > 95 THEN 'advanced' ELSE 'use' END AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events"


@query(
    f"""SELECT user_id, event_type, any_value(n) AS n, round(least(1.0, greatest(0.05 * any_value(n), coalesce(max(0.9 + 0.05 * (n - i)) FILTER (WHERE s = 'expert'), 0), coalesce(max(0.7 + 0.05 * (n - i)) FILTER (WHERE s = 'advanced'), 0))), 6)::DOUBLE AS fluency
    FROM ({_SIGNAL}) GROUP BY user_id, event_type"""
)
def fluency_fold(spark, d):
    signal = F.when(F.col("value") > 98, "expert").when(F.col("value") > 95, "advanced").otherwise("use")
    return folds.fluency(_events(spark, d).select("user_id", "event_type", "event_id", signal.alias("signal")), ["user_id", "event_type"], "event_id", "signal")


@query(
    """WITH o AS (SELECT user_id, event_type, event_id, CASE WHEN value > 90 THEN 'engaged' WHEN value > 50 THEN 'deflected' WHEN value < 2 THEN 'dropped' ELSE 'raised' END AS o FROM events),
    k AS (SELECT *, CASE WHEN o = 'deflected' THEN row_number() OVER (PARTITION BY user_id, event_type, o ORDER BY event_id) END AS nth FROM o),
    e AS (SELECT user_id, event_type, event_id, CASE WHEN nth = 2 THEN 'retired' ELSE o END AS s FROM k WHERE o IN ('engaged', 'dropped') OR nth = 2)
    SELECT o.user_id, o.event_type, any_value(n) AS n, coalesce(arg_min(s, e.event_id), 'open') AS status, CAST(any_value(d) AS INT) AS deflected
    FROM (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE o = 'deflected') AS d FROM o GROUP BY ALL) o LEFT JOIN e ON o.user_id = e.user_id AND o.event_type = e.event_type GROUP BY o.user_id, o.event_type"""
)
def outcome_fold(spark, d):
    outcome = F.when(F.col("value") > 90, "engaged").when(F.col("value") > 50, "deflected").when(F.col("value") < 2, "dropped").otherwise("raised")
    return folds.outcomes(_events(spark, d).select("user_id", "event_type", "event_id", outcome.alias("outcome")), ["user_id", "event_type"], "event_id", "outcome")


@query(
    """WITH t AS (SELECT CAST(max(ts) AS DATE) AS now FROM events), g AS (SELECT user_id, event_type, CAST(max(ts) AS DATE) AS last, least(0.95, 0.5 + 0.1 * count(*)) AS c FROM events GROUP BY ALL),
    c AS (SELECT user_id, event_type, round(c - CASE WHEN date_diff('day', last, now) >= 14 THEN 0.1 * (date_diff('day', last, now) // 14) ELSE 0 END, 6) AS confidence FROM g, t) SELECT user_id, event_type, CAST(confidence AS DOUBLE) AS confidence FROM c WHERE confidence >= 0.25"""
)
def decay_confidence(spark, d):
    """+0.1 for each use up to 0.95; -0.1 for every 14 days without; below 0.25 a row retires."""
    e = _events(spark, d)
    now = e.agg(F.max(F.to_date("ts")).alias("now"))  # one row
    rows = e.groupBy("user_id", "event_type").agg(F.max(F.to_date("ts")).alias("last"), F.count("*").alias("n")).crossJoin(F.broadcast(now))
    level = F.least(F.lit(0.95), 0.5 + 0.1 * F.col("n")) - 0.1 * F.floor(F.datediff("now", "last") / 14)
    return rows.select("user_id", "event_type", F.round(level, 6).alias("confidence")).where("confidence >= 0.25")
