"""Queries of usage events: over the events table, and over a log of the engine's own kinds."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import quantiles as Q
from ..operators import state
from .base import Derived, query, shared, table

# A log of the engine's own events made of the events table: a click stands for a search, a view for a recall, a
# purchase for an opened hit, a signup for a note on an edit, an error for feedback. Six events in a row are a request.
_KINDS = {"click": "search", "view": "recall", "purchase": "open", "signup": "rag_edit", "error": "feedback"}
_OUTCOMES = ["useful", "wrong", "code_failed", "code_passed"]
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_AT = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_OUTCOME = f"CASE WHEN event_type = 'error' THEN {_OUTCOMES}[1 + event_id % 4] END"


def _events(spark, sf):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    request = F.floor(F.col("event_id") / 6)
    return table(spark, sf, "events").select("*", at.alias("at"), request.alias("q"), F.concat(F.lit("r"), request.cast("string")).alias("request_id"))


def _log_table(spark, sf):
    e, n = _events(spark, sf), F.col("event_id")
    kind = F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv])[F.col("event_type")]
    when = lambda *kinds: F.col("event_type").isin(*kinds)
    outcome = F.when(when("error"), F.element_at(F.array(*map(F.lit, _OUTCOMES)), (1 + n % 4).cast("int")))
    return e.select(
        "at", kind.alias("event"), "request_id", F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session"),
        F.when(when("click"), F.concat(F.lit("q"), F.floor(n / 12).cast("string"))).alias("query_hash"), F.when(when("view"), F.floor(F.col("value") * 10)).alias("elapsed_ms"),
        F.when(when("view", "signup"), F.when(n % 3 == 0, 0).otherwise(F.floor(F.col("value") * 20))).cast("long").alias("injected_bytes"),
        F.when(when("purchase"), F.concat(F.lit("h"), (n % 50).cast("string"))).alias("result_id"), outcome.alias("outcome"), F.when(when("error"), n % 4 >= 2).alias("automatic"),
    )


LOG = Derived("log", f"""SELECT {_AT} AS at, {_CASE} AS event, 'r' || event_id // 6 AS request_id, CASE WHEN user_id % 10 <> 0 THEN 's' || user_id END AS session,
CASE WHEN event_type = 'click' THEN 'q' || event_id // 12 END AS query_hash, CASE WHEN event_type = 'view' THEN floor(value * 10)::BIGINT END AS elapsed_ms,
CASE WHEN event_type IN ('view', 'signup') THEN CASE WHEN event_id % 3 = 0 THEN 0 ELSE floor(value * 20) END END::BIGINT AS injected_bytes, CASE WHEN event_type = 'purchase' THEN 'h' || event_id % 50 END AS result_id,
{_OUTCOME} AS outcome, CASE WHEN event_type = 'error' THEN event_id % 4 >= 2 END AS automatic FROM events""", _log_table)  # fmt: skip


def _hits_table(spark, sf):
    """Three hits for each search: ids that differ, scores that differ, every fourth without a block."""
    e = _events(spark, sf).where("event_type = 'click'").select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    text = lambda head, n, tail="": F.concat(F.lit(head), n.cast("string"), F.lit(tail))
    n, j = F.col("event_id"), F.col("j")
    return e.select(
        "request_id", "at", text("h", (13 * F.col("q") + n + 13 * j) % 50).alias("id"), text("p/", (n + 7 * j) % 40, ".md").alias("source"), (24 * j + 1).cast("long").alias("line"),
        (F.col("value") * 10 + (n + 2 * j) % 5).alias("score"), F.when((n + j) % 4 != 0, text("b", (n + 3 * j) % 30)).alias("block"),
    )


HITS = Derived("hits", f"""SELECT 'r' || event_id // 6 AS request_id, {_AT} AS at, 'h' || (13 * (event_id // 6) + event_id + 13 * j) % 50 AS id, 'p/' || (event_id + 7 * j) % 40 || '.md' AS source, (24 * j + 1)::BIGINT AS line,
value * 10 + (event_id + 2 * j) % 5 AS score, CASE WHEN (event_id + j) % 4 <> 0 THEN 'b' || (event_id + 3 * j) % 30 END AS block FROM (SELECT *, unnest([0, 1, 2]) AS j FROM events WHERE event_type = 'click')""", _hits_table)  # fmt: skip


def _shown_table(spark, sf):
    """What a request's recalls showed: none to two hits, some of its own searches' and some of others'."""
    q = _events(spark, sf).select("q", "request_id").distinct().where("q % 3 > 0")
    q = q.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") % 3 - 1)).alias("pos"))
    return q.select("request_id", "pos", F.concat(F.lit("h"), ((19 * F.col("q") + 13 * F.col("pos")) % 50).cast("string")).alias("id"))


SHOWN = Derived("shown", "SELECT 'r' || q AS request_id, pos, 'h' || (19 * q + 13 * pos) % 50 AS id FROM (SELECT q, unnest(range(0, q % 3)) AS pos FROM (SELECT DISTINCT event_id // 6 AS q FROM events))", _shown_table)
_SQL = f"WITH {LOG.sql}, {HITS.sql}, {SHOWN.sql}"


def _named(sql: str) -> str:
    """``at`` is a keyword of DuckDB."""
    return re.sub(r"""(?<!["'\w])at(?!["'\w])""", '"at"', sql)


def _log(spark, sf):
    """The three as one log of the engine's events."""
    h = HITS.df(spark, sf).groupBy("request_id", "at").agg(
        F.array_sort(F.collect_list(F.struct("id", "source", "line", "score", F.array().cast("array<string>").alias("matched_terms"), F.lit(True).alias("own"), F.when(F.col("block").isNotNull(), F.array("block")).otherwise(F.array().cast("array<string>")).alias("blocks")))).alias("hits")
    )
    s = SHOWN.df(spark, sf).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("hit_ids"))
    log = LOG.df(spark, sf).join(h, ["request_id", "at"], "left").withColumn("hits", F.when(F.col("event") == "search", F.col("hits")))
    return log.join(s, "request_id", "left").withColumn("hit_ids", F.when(F.col("event") == "recall", F.col("hit_ids")))


_PCT = "list_sort(list({x}))[1 + least(count(*) - 1, floor(count(*) * {q}))::BIGINT]"


@query(_named(_SQL + f", r AS (SELECT l.*, (SELECT count(*) FROM shown s WHERE s.request_id = l.request_id) AS n FROM log l WHERE event = 'recall' AND at >= '2024-01-15') SELECT count(*) AS recalls, count(*) FILTER (WHERE n > 0) AS injected, round(count(*) FILTER (WHERE n > 0) / count(*)::DOUBLE, 3) AS injection_rate, {_PCT.format(x='elapsed_ms', q=0.5)} AS p50_ms, {_PCT.format(x='elapsed_ms', q=0.95)} AS p95_ms FROM r"))
def recall_stats(spark, sf):
    return E.recall_stats(_log(spark, sf), "2024-01-15")


@query(_named(_SQL + """, s AS (SELECT request_id, max(at) AS at, arg_max(query_hash, at) AS query_hash FROM log WHERE event = 'search' GROUP BY request_id),
h AS (SELECT h.* FROM hits h JOIN s USING (request_id, at)), top AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC) = 1),
f AS (SELECT request_id, id FROM shown WHERE pos = 0)
SELECT l.request_id, s.query_hash AS hash, top.score AS top_score, coalesce(o.source, top.source) AS source, coalesce(o.line, top.line) AS line, f.id IS NOT NULL AS injected, f.id IS NULL OR o.id IS NOT NULL AS opener_found
FROM log l JOIN s USING (request_id) JOIN top USING (request_id) LEFT JOIN f USING (request_id) LEFT JOIN h o ON o.request_id = l.request_id AND o.id = f.id WHERE l.event = 'recall' AND l.at >= '2024-01-05'"""))
def recall_rows(spark, sf):
    return E.recall_rows(_log(spark, sf), "2024-01-05")


@query("SELECT event_type, " + _PCT.format(x="value", q=0.5) + " AS p50, " + _PCT.format(x="value", q=0.95) + " AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return E.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY event_type")
def interpolated_median(spark, sf):
    got = Q.interpolated(table(spark, sf, "events"), ["event_type"], "value", {"median": 0.5})
    return got.select("event_type", F.round("median", 6).alias("median"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS p1, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem")
def price_quantiles(spark, sf):
    """One group of all rows, as at any size above quantiles.FEW: counted by cells, never ordered in one task."""
    got = Q.interpolated(table(spark, sf, "lineitem"), [], "l_extendedprice", {"p1": 0.01, "p50": 0.5, "p99": 0.99}, few=1000)
    return got.select(*[F.round(c, 6).alias(c) for c in ("p1", "p50", "p99")])


@query(_named(_SQL + " SELECT (SELECT count(DISTINCT request_id) FROM log WHERE event = 'search') AS searches, count(DISTINCT h.request_id) AS with_open FROM hits h WHERE EXISTS (SELECT 1 FROM log o WHERE o.event = 'open' AND o.request_id = h.request_id AND o.result_id = h.id)"))
def usage_report(spark, sf):
    return E.usage_report(_log(spark, sf))


@query(_named(_SQL + " SELECT DISTINCT h.request_id FROM hits h JOIN log o ON o.event = 'open' AND o.request_id = h.request_id AND o.result_id = h.id"))
def searches_with_open(spark, sf):
    return E.searches_with_open(_log(spark, sf))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")
def feedback_pivot(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).count().na.fill(0)


@query(_named(_SQL + f", r AS (SELECT * FROM log WHERE event = 'rag_edit'), f AS (SELECT * FROM log WHERE event = 'feedback' AND automatic) SELECT (SELECT count(*) FROM r) AS fired, (SELECT count(*) FROM r WHERE injected_bytes > 0) AS injected, (SELECT {_PCT.format(x='injected_bytes', q=0.5)} FROM r WHERE injected_bytes > 0) AS injected_bytes_p50, (SELECT round(count(*) FILTER (WHERE outcome = 'code_failed') / nullif(count(*) FILTER (WHERE outcome IN ('code_passed', 'code_failed')), 0)::DOUBLE, 3) FROM f) AS code_failed_share"))
def rag_report(spark, sf):
    return E.rag_report(_log(spark, sf))


@query(_named(_SQL + """, e AS (SELECT request_id, id, arg_max(source, at || source) AS source FROM hits GROUP BY request_id, id), a AS (SELECT id, arg_max(source, at || request_id || source) AS source FROM hits GROUP BY id)
SELECT s.request_id, s.id, coalesce(e.source, a.source) AS source FROM shown s LEFT JOIN e USING (request_id, id) LEFT JOIN a ON a.id = s.id"""))
def ref_resolution(spark, sf):
    return E.resolve_refs(SHOWN.df(spark, sf).select("request_id", "id"), HITS.df(spark, sf))


@query("SELECT CASE WHEN value < 30 THEN 'below' WHEN value < 50 THEN 'near' ELSE 'above' END AS bin, count(*) AS n FROM events WHERE value >= 0 GROUP BY bin")
def score_bins(spark, sf):
    return E.score_bins(table(spark, sf, "events"), "value", 30.0, 20.0)


@query("SELECT bin, least(10, count(*)) AS n FROM (SELECT CASE WHEN value < 30 THEN 'below' WHEN value < 50 THEN 'near' ELSE 'above' END AS bin FROM events WHERE value >= 0) GROUP BY bin")
def stratified_counts(spark, sf):
    return E.stratified(table(spark, sf, "events"), "value", 30.0, 20.0, 10, 0, "event_id").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT e.event_id, v.event_id AS last_event_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON e.user_id = v.user_id AND e.ts >= v.ts
WHERE e.event_type = 'purchase'""".replace("v.event_id AS last_event_id", "CASE WHEN date_diff('microsecond', v.ts, e.ts) <= 86400000000 THEN v.event_id END AS last_event_id"))
def asof_latest(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return E.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", 86400, "event_id").select("event_id", "last_event_id")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 35 DAY FROM events) AND CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY event_type")
def horizon_filter(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts")).first()[0]
    return e.where((F.col("ts") >= F.lit(last) - F.expr("INTERVAL 35 DAYS")) & (F.to_date("ts") < F.lit(last.date()))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query(_named(_SQL + " SELECT DISTINCT l.session, coalesce(l.query_hash, l.request_id) AS query, h.block FROM log l JOIN hits h ON h.request_id = l.request_id AND h.at = l.at WHERE l.event = 'search' AND l.session IS NOT NULL AND h.block IS NOT NULL"))
def distinct_uses(spark, sf):
    return E.distinct_uses(_log(spark, sf))


@query("""SELECT user_id, round(ln(sum(CASE WHEN event_type = 'click' THEN 2.0::DOUBLE ELSE 1.0 END * power(greatest(0.5::DOUBLE, (epoch((SELECT max(ts) FROM events)) - epoch(ts)) / 86400.0), -0.5::DOUBLE))), 6) AS activation FROM events GROUP BY user_id""")
def activation(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").cast("timestamp").alias("t")).select(F.unix_micros("t")).first()[0]
    days = (F.lit(last) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    return E.activation(e, "user_id", days, F.when(F.col("event_type") == "click", 2.0).otherwise(1.0))


WEEK = shared(
    "week", "events", id="'e' || event_id", kind="CASE WHEN event_type IN ('click', 'view') THEN 'prose' ELSE 'absent' END", rank="nullif(event_id % 4, 0)", top_score="CASE WHEN event_id % 17 > 0 THEN value END", error="CASE WHEN event_id % 17 = 0 THEN 'timeout' END"
)


@query(f"""WITH {WEEK.sql} SELECT round(count(*) FILTER (WHERE kind = 'prose' AND error IS NULL AND rank = 1) / count(*) FILTER (WHERE kind = 'prose' AND error IS NULL)::DOUBLE, 4) AS recall_1,
round(count(*) FILTER (WHERE kind = 'absent' AND id <> 'e3' AND top_score < 7.17) / count(*) FILTER (WHERE kind = 'absent' AND id <> 'e3')::DOUBLE, 4) AS absent_ok, count(*) FILTER (WHERE error IS NOT NULL) AS errors,
list(id ORDER BY id) FILTER (WHERE kind = 'absent' AND id <> 'e3' AND top_score >= 7.17) AS over FROM week""")
def weekly_summary(spark, sf):
    known = ["e3"]
    kind, ok = F.col("kind"), F.col("error").isNull()
    absent = (kind == "absent") & ~F.col("id").isin(known)
    share = lambda hit, of: F.round(F.count_if(of & hit) / F.count_if(of), 4)
    return WEEK.df(spark, sf).agg(
        share(F.col("rank") == 1, (kind == "prose") & ok).alias("recall_1"), share(F.col("top_score") < 7.17, absent).alias("absent_ok"), F.count_if(~ok).alias("errors"),
        F.array_sort(F.collect_list(F.when(absent & (F.col("top_score") >= 7.17), F.col("id")))).alias("over"),
    )


@query("WITH wanted AS (SELECT sha256(text) AS hash FROM conversations WHERE turn = 0) SELECT DISTINCT conv_id, turn FROM conversations c JOIN wanted w ON w.hash = sha256(c.text)")
def hash_semi_join(spark, sf):
    c = table(spark, sf, "conversations").withColumn("hash", F.sha2("text", 256))
    return c.join(c.where("turn = 0").select("hash"), "hash", "left_semi").select("conv_id", "turn").distinct()


@query(_named(f"WITH {HITS.sql} SELECT request_id, sha256('q-' || request_id) AS query_hash, id, source, score FROM hits"))
def telemetry(spark, sf):
    h = HITS.df(spark, sf).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id", "source", "score"))), lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source"), x["score"].alias("score"))).alias("hits"))
    logged = E.telemetry(h.withColumn("query", F.concat(F.lit("q-"), "request_id")))
    return logged.select("request_id", "query_hash", F.inline("hits"))


# Alert calls made of the events table: a user's events are the calls of one marker.
_CALLS = {"click": "alert", "view": "ok", "purchase": "ok", "signup": "alert", "error": "once"}


def _alerts_table(spark, sf):
    call = F.create_map(*[F.lit(x) for kv in _CALLS.items() for x in kv])[F.col("event_type")]
    return table(spark, sf, "events").select(F.col("event_id").alias("n"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("marker"), call.alias("call"))


ALERTS = Derived("alerts", "SELECT event_id AS n, strftime(ts, '%Y-%m-%d') AS day, 'm' || user_id AS marker, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CALLS.items()) + " END AS call FROM events", _alerts_table)
_FSM = f"""WITH RECURSIVE {ALERTS.sql}, o AS (SELECT *, row_number() OVER (PARTITION BY marker ORDER BY n) AS k FROM alerts),
step AS (SELECT n, day, marker, call, k, CASE WHEN call = 'ok' THEN '' ELSE '!' END AS state, CASE WHEN call = 'ok' THEN '' ELSE day END AS since, call <> 'ok' AS written FROM o WHERE k = 1
UNION ALL SELECT o.n, o.day, o.marker, o.call, o.k,
CASE WHEN o.call = 'ok' THEN (CASE WHEN s.state = '!' THEN 'OK' ELSE s.state END) WHEN o.call = 'once' AND s.state = 'OK' THEN 'OK' ELSE '!' END,
CASE WHEN o.call = 'ok' THEN (CASE WHEN s.state = '!' THEN o.day ELSE s.since END) WHEN o.call = 'once' AND s.state = 'OK' THEN s.since ELSE o.day END,
CASE WHEN o.call = 'ok' THEN s.state = '!' WHEN o.call = 'once' AND s.state = 'OK' THEN FALSE ELSE NOT (s.state = '!' AND s.since = o.day) END
FROM step s JOIN o ON o.marker = s.marker AND o.k = s.k + 1)"""


@query(_FSM + " SELECT n, marker, state FROM step WHERE written")
def alert_transitions(spark, sf):
    return state.alert_transitions(ALERTS.df(spark, sf))


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS state FROM events GROUP BY user_id".replace("(epoch_us(ts), event_id)", "struct_pack(a := ts, b := event_id)"))
def last_state(spark, sf):
    return state.last_state(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(_FSM + ", w AS (SELECT marker, state, n FROM step WHERE written QUALIFY row_number() OVER (PARTITION BY marker ORDER BY n DESC) = 1) SELECT marker, n FROM w WHERE state = '!'")
def open_alerts(spark, sf):
    return state.open_alerts(state.alert_transitions(ALERTS.df(spark, sf)))


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, k, event_id, ts AS last, TRUE AS admitted FROM o WHERE k = 1 UNION ALL
SELECT o.user_id, o.k, o.event_id, CASE WHEN o.ts - g.last >= INTERVAL 6 HOUR THEN o.ts ELSE g.last END, o.ts - g.last >= INTERVAL 6 HOUR FROM g JOIN o ON o.user_id = g.user_id AND o.k = g.k + 1)
SELECT event_id, user_id, admitted FROM g""")
def throttled_calls(spark, sf):
    """Each user's calls, of which one passes in six hours."""
    return state.throttled(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 6 * 3600, "event_id").select("event_id", "user_id", "admitted")
