"""State machines and streams (T)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightmill.functions.numeric import rounded_ms
from brightmill.operators.aggregates import top
from brightmill.operators.state import Breaker, KeyRing, Ledger, Limiter, replay
from brightmill.operators.windows import reached, trailing
from brightmill.plans.analytics import SAMPLE_CAP, SAMPLE_KEEP
from brightmill.plans.catalog import query
from brightmill.sources.views import BatchViews, Views, sql_text
from brightmill.streaming import jobs, monitors

DAY_MS = 86_400_000


def _timed(v: Views) -> DataFrame:
    return v.st.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def _streamed(v: Views, name: str, keys: list[str], rows: Callable[[Views], DataFrame], new: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """A machine over the event stream; `rows` of the views over a batch."""
    v.table("events")  # ships the package to the workers
    own = [k for k in keys if k not in schema]  # states and results are laid out by the keys
    entries = jobs.run_machine(v.spark, v.folder, name, keys, lambda batch: rows(BatchViews(v.spark, batch)), new, step, ", ".join([*(f"{k} long" for k in own), schema]))
    return entries.drop(*own)


# The machines as SQL: each user's events are numbered, and one recursive step a number takes all users' states on.
_STEPS = """WITH RECURSIVE e AS (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM st)"""
LIMITER_SQL = """
, w AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS kept, false AS allowed, NULL::BIGINT AS ms FROM e UNION ALL
  SELECT user_id, n, event_id, CASE WHEN fits THEN list_append(inside, ms) ELSE list_filter(inside, lambda x: x <> ms) END, fits, ms FROM (
    SELECT *, len(inside) < 2 AS fits FROM (SELECT e.user_id, e.n, e.event_id, e.ms, list_filter(w.kept, lambda x: x > e.ms - 86400000) AS inside FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
)"""


@query("t1_rate_limiter", "st", _STEPS + LIMITER_SQL + """
SELECT event_id, user_id, allowed, CAST(len(kept) AS INTEGER) AS used, greatest((coalesce(kept[1], ms) + 86400000 - ms + 999) // 1000, 1) AS reset_s FROM w WHERE n > 0""")
def _(v: Views) -> DataFrame:
    """Two requests a day and user."""
    step = lambda state, row: state.step(row["ms"])
    return replay(_timed(v).select("user_id", "ms", "event_id"), ["user_id"], ["ms", "event_id"], lambda: Limiter(2, DAY_MS), step, "event_id long, user_id long, allowed boolean, used int, reset_s long")


@query("t1_rate_limiter_stream", "st", _STEPS + LIMITER_SQL + " SELECT event_id, user_id, allowed FROM w WHERE n > 0")
def _(v: Views) -> DataFrame:
    """The same limiter over the event stream."""
    step = lambda state, row: state.step(row["ms"])
    rows = lambda v: _timed(v).select("user_id", "ms", "event_id")
    return _streamed(v, "limiter", ["user_id"], rows, lambda: Limiter(2, DAY_MS), step, "event_id long, user_id long, allowed boolean")


@query("t2_daily_counter", "u", """
SELECT event_id, n, n <= 3 AS allowed, n >= 0.8 * 3 AS approaching FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS n FROM u)""")
def _(v: Views) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id", F.col("ts").cast("date")).orderBy("ts", "event_id")).cast("long")
    return v.u.select("event_id", n.alias("n")).select("event_id", "n", (F.col("n") <= 3).alias("allowed"), (F.col("n") >= 0.8 * 3).alias("approaching"))


@query("t3_key_limits", "u", """
SELECT event_id, CAST(n AS BIGINT) AS n, CAST(t AS BIGINT) AS tokens, n >= 4 OR t + tokens_used > 2000 AS limited FROM (
  SELECT event_id, tokens_used, count(*) OVER w AS n, coalesce(sum(tokens_used) OVER w, 0) AS t FROM (SELECT *, epoch_ms(ts) AS ms FROM u) WINDOW w AS (PARTITION BY k ORDER BY ms RANGE BETWEEN 86400000 PRECEDING AND 1 PRECEDING))""")
def _(v: Views) -> DataFrame:
    """Requests and tokens of a key in the day before each request."""
    rows = trailing(v.u.select("event_id", "k", rounded_ms(F.col("ts")).alias("ms"), "tokens_used"), ["k"], "ms", DAY_MS, "n", {"tokens": "tokens_used"})
    return rows.select("event_id", "n", "tokens", ((F.col("n") >= 4) | (F.col("tokens") + F.col("tokens_used") > 2000)).alias("limited"))


_WINDOWS = {"hour": (3_600_000, 1), "half_day": (43_200_000, 2), "day": (DAY_MS, 4), "week": (7 * DAY_MS, 15)}


@query("t3_key_limits_of_all_windows", "u", f"""
SELECT event_id, list_filter([{', '.join(f"CASE WHEN n_{x} >= {most} THEN '{x}' END" for x, (_, most) in _WINDOWS.items())}], lambda x: x IS NOT NULL) AS limited_by FROM (
  SELECT event_id, {', '.join(f"count(*) OVER (PARTITION BY k ORDER BY ms RANGE BETWEEN {length} PRECEDING AND 1 PRECEDING) AS n_{x}" for x, (length, _) in _WINDOWS.items())} FROM (SELECT *, epoch_ms(ts) AS ms FROM u))""")
def _(v: Views) -> DataFrame:
    """The windows whose request limit a key has reached at each request; one sort serves them all."""
    rows = reached(v.u.select("event_id", "k", rounded_ms(F.col("ts")).alias("ms")), ["k"], "ms", _WINDOWS)
    return rows.select("event_id", F.array_compact(F.array(*[F.when(F.col(x), x) for x in _WINDOWS])).alias("limited_by"))


BREAKER_SQL = _STEPS + """
, w AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 'closed' AS state, 0 AS streak, 0 AS successes, 0::BIGINT AS total, 0::BIGINT AS good, 0::BIGINT AS last FROM e UNION ALL
  SELECT user_id, n, event_id,
    CASE WHEN failed THEN CASE WHEN was = 'half_open' OR (was = 'closed' AND streak >= 5) THEN 'open' ELSE was END ELSE CASE WHEN was = 'half_open' AND successes >= 2 THEN 'closed' ELSE was END END,
    streak, successes, total, good, last FROM (
    SELECT e.user_id, e.n, e.event_id, e.failed, x.was, CASE WHEN e.failed THEN w.streak + (e.latency <= 400)::INT ELSE 0 END AS streak,
      CASE WHEN x.was <> w.state THEN 0 ELSE w.successes END + (NOT e.failed AND x.was = 'half_open')::INT AS successes,
      w.total + 1 AS total, w.good + (NOT e.failed)::INT AS good, CASE WHEN e.failed THEN e.ms ELSE w.last END AS last
    FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1, LATERAL (SELECT CASE WHEN w.state = 'open' AND e.ms - w.last >= 60000 THEN 'half_open' ELSE w.state END AS was) x)
)"""
_BREAKER = "event_id long, user_id long, state string, streak int, rate double, healthy boolean"


def _breaker_rows(v: Views) -> DataFrame:
    return _timed(v).select("user_id", "ms", "event_id", "failed", (F.col("failed") & (F.col("latency") > 400)).alias("rate_limited"))


def _breaker_step(state: Breaker, r: dict) -> dict:
    return state.step(r["ms"], r["failed"], r["rate_limited"])


@query("t4_circuit_breaker", "st", BREAKER_SQL + """
SELECT event_id, user_id, state, CAST(streak AS INTEGER) AS streak, 100.0::DOUBLE * good / total AS rate, CASE WHEN total >= 10 THEN 100.0::DOUBLE * good / total >= 50 ELSE state <> 'open' END AS healthy FROM w WHERE n > 0""")
def _(v: Views) -> DataFrame:
    return replay(_breaker_rows(v), ["user_id"], ["ms", "event_id"], Breaker, _breaker_step, _BREAKER)


@query("t4_circuit_breaker_stream", "st", BREAKER_SQL + """
SELECT event_id, user_id, state, CAST(streak AS INTEGER) AS streak, 100.0::DOUBLE * good / total AS rate, CASE WHEN total >= 10 THEN 100.0::DOUBLE * good / total >= 50 ELSE state <> 'open' END AS healthy FROM w WHERE n > 0""")
def _(v: Views) -> DataFrame:
    """The breaker over the event stream, from stored states."""
    return _streamed(v, "breaker", ["user_id"], _breaker_rows, Breaker, _breaker_step, _BREAKER)


@query("t4_breaker_timers", "st", BREAKER_SQL + " SELECT event_id, user_id, state, CAST(streak AS INTEGER) AS streak FROM w WHERE n > 0")
def _(v: Views) -> DataFrame:
    """The breaker as a state processor, whose timers half-open it without an event; the rows of events."""
    v.table("events")
    found = jobs.with_state_store(v.spark, lambda: jobs.run_complete(v.spark, v.folder, jobs.breaker_with_timers, "breaker-timers", "append"))
    return found.where("not by_timer").select("event_id", "user_id", "state", "streak")


ROTATION_SQL = """WITH RECURSIVE e AS (
  SELECT *, user_id // 5 AS provider, user_id % 2 AS paid, latency > 400 AS limited, row_number() OVER (PARTITION BY user_id // 5, user_id % 2 ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM st
), w AS (
  SELECT DISTINCT provider, paid, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS user_id, MAP {}::MAP(BIGINT, STRUCT(p BIGINT, s BIGINT, f BIGINT, a BOOLEAN)) AS keys, 0::BIGINT AS wait FROM e UNION ALL
  SELECT provider, paid, n, event_id, user_id, map_from_entries(list_concat(list_filter(map_entries(keys), lambda x: x.key <> user_id), [{'key': user_id, 'value': own}])),
    CASE WHEN NOT failed OR event_type = 'signup' AND latency > 450 THEN 0 WHEN event_id % 9 = 0 THEN 5000 WHEN limited THEN CASE WHEN user_id % 3 = 0 THEN 45000 ELSE 60000 END ELSE least(300000, 30000 * power(2, least(own.s, 10))) END
  FROM (
    SELECT *, CASE WHEN failed THEN {'p': CASE WHEN coalesce(top, 0) = 0 THEN 999 ELSE top END + 1, 's': old.s + (NOT limited)::INT, 'f': old.f + (NOT limited)::INT, 'a': old.a OR old.f + (NOT limited)::INT >= 25}
      ELSE {'p': user_id, 's': 0, 'f': old.f, 'a': old.a} END::STRUCT(p BIGINT, s BIGINT, f BIGINT, a BOOLEAN) AS own FROM (
      SELECT *, list_max(list_transform(list_filter(map_values(map_from_entries(list_concat(list_filter(map_entries(keys), lambda x: x.key <> user_id), [{'key': user_id, 'value': old}]))), lambda x: NOT x.a), lambda x: x.p)) AS top FROM (
        SELECT e.provider, e.paid, e.n, e.event_id, e.user_id, e.failed, e.limited, e.latency, e.event_type, w.keys,
          coalesce(w.keys[e.user_id], {'p': e.user_id, 's': 0, 'f': 0, 'a': false}::STRUCT(p BIGINT, s BIGINT, f BIGINT, a BOOLEAN)) AS old FROM w JOIN e ON e.provider = w.provider AND e.paid = w.paid AND e.n = w.n + 1)))
)
SELECT event_id, user_id, keys[user_id].p AS priority, CAST(wait AS BIGINT) AS cooldown_ms, keys[user_id].a AS archived FROM w WHERE n > 0"""
_ROTATION = "event_id long, user_id long, priority long, cooldown_ms long, archived boolean"


def _rotation_rows(v: Views) -> DataFrame:
    """Users stand for keys, five neighbours for a provider's, in groups of paid and free ones."""
    late, third = (F.col("event_type") == "signup") & (F.col("latency") > 450), F.col("user_id") % 3 == 0
    return _timed(v).select(
        F.expr("user_id div 5").alias("provider"), (F.col("user_id") % 2).alias("paid"), "user_id", "ms", "event_id", "failed", (F.col("latency") > 400).alias("rate_limited"), late.alias("timed_out"),
        F.when(F.col("event_id") % 9 == 0, 5000).otherwise(0).alias("retry_after"), F.when(third, 45000).otherwise(0).alias("reset"),
    )


def _rotation_step(state: KeyRing, r: dict) -> dict:
    return state.step(r["user_id"], r["failed"], r["rate_limited"], r["timed_out"], r["retry_after"], r["reset"])


@query("t5_t6_key_rotation", "st", ROTATION_SQL)
def _(v: Views) -> DataFrame:
    return replay(_rotation_rows(v), ["provider", "paid"], ["ms", "event_id"], KeyRing, _rotation_step, _ROTATION)


@query("t5_t6_key_rotation_stream", "st", ROTATION_SQL)
def _(v: Views) -> DataFrame:
    """Rotation and waits over the event stream, from the stored ring of each provider's paid or free keys."""
    return _streamed(v, "rotation", ["provider", "paid"], _rotation_rows, KeyRing, _rotation_step, _ROTATION)


LEDGER_SQL = _STEPS + """
, a AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'deposit' WHEN 'view' THEN 'reserve' WHEN 'click' THEN 'finalize' ELSE 'none' END AS action, CAST(ceil(latency) AS BIGINT) AS amount FROM e
), w AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 100::BIGINT AS free, 0::BIGINT AS paid, NULL::BIGINT AS refreshed, 0::BIGINT AS held, true AS accepted FROM a UNION ALL
  SELECT user_id, n, event_id,
    CASE WHEN action = 'reserve' AND enough OR action = 'finalize' AND due >= 0 AND enough THEN f - least(f, due) WHEN action = 'finalize' AND due < 0 THEN f - due WHEN action = 'finalize' THEN 0 ELSE f END,
    CASE WHEN action = 'deposit' THEN paid + amount WHEN action = 'reserve' AND enough OR action = 'finalize' AND due >= 0 AND enough THEN paid - (due - least(f, due)) WHEN action = 'finalize' AND due >= 0 THEN 0 ELSE paid END,
    r, CASE WHEN action = 'reserve' AND enough THEN amount WHEN action = 'finalize' THEN 0 ELSE held END, action <> 'reserve' OR enough FROM (
    SELECT *, f + paid >= due AS enough FROM (
      SELECT a.user_id, a.n, a.event_id, a.action, a.amount, w.paid, w.held, CASE WHEN a.action = 'finalize' THEN a.amount - w.held ELSE a.amount END AS due,
        CASE WHEN w.refreshed IS NULL OR a.ms - w.refreshed >= 86400000 THEN 100 ELSE w.free END AS f, CASE WHEN w.refreshed IS NULL OR a.ms - w.refreshed >= 86400000 THEN a.ms ELSE w.refreshed END AS r
      FROM w JOIN a ON a.user_id = w.user_id AND a.n = w.n + 1))
)
SELECT event_id, user_id, CAST(free AS BIGINT) AS free, CAST(paid AS BIGINT) AS paid, accepted FROM w WHERE n > 0"""
_LEDGER = "event_id long, user_id long, free long, paid long, accepted boolean"


def _ledger_rows(v: Views) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "deposit").when(F.col("event_type") == "view", "reserve").when(F.col("event_type") == "click", "finalize").otherwise("none")
    return _timed(v).select("user_id", "ms", "event_id", action.alias("action"), F.ceil("latency").alias("amount"))


def _ledger_step(state: Ledger, r: dict) -> dict:
    return state.step(r["ms"], r["action"], r["amount"])


@query("t7_k14_credit_ledger", "st", LEDGER_SQL)
def _(v: Views) -> DataFrame:
    return replay(_ledger_rows(v), ["user_id"], ["ms", "event_id"], Ledger, _ledger_step, _LEDGER)


@query("t7_credit_ledger_stream", "st", LEDGER_SQL)
def _(v: Views) -> DataFrame:
    """The ledger over the event stream: each micro-batch is one commit of accounts and entries."""
    return _streamed(v, "ledger", ["user_id"], _ledger_rows, Ledger, _ledger_step, _LEDGER)


@query("t8_s11_sse_lines", "m", "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS chars FROM m")
def _(v: Views) -> DataFrame:
    """Events cut into chunks anywhere, put together in order and parsed line by line; broken JSON is skipped."""
    event = F.concat(F.lit("event: message\ndata: "), F.to_json(F.struct("turn", "role", F.length("text").alias("chars"))), F.lit("\n\ndata: {broken\n\n"))
    stream = v.m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))).alias("events"))
    body = F.concat(F.array_join(F.transform("events", lambda x: x.e), ""), F.lit("data: [DONE]\n"))
    pieces = F.transform(F.sequence(F.lit(0), F.length("body") - 1, F.lit(17)), lambda i: F.substring(F.col("body"), i + 1, F.lit(17)))
    chunks = stream.select("conv_id", body.alias("body")).select("conv_id", F.posexplode(pieces).alias("seq", "chunk"))
    whole = chunks.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x.chunk), "").alias("body"))
    lines = whole.select("conv_id", F.explode(F.split("body", "\n")).alias("line")).where(F.startswith("line", F.lit("data: ")) & (F.col("line") != "data: [DONE]"))
    parsed = lines.select("conv_id", F.from_json(F.substring("line", 7, 1 << 30), "turn long, role string, chars long").alias("d"))
    return parsed.where("d.role is not null").select("conv_id", "d.turn", "d.role", "d.chars")


@query("t8_chunk_stream", "m", "SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS chars FROM m")
def _(v: Views) -> DataFrame:
    """The same events as bytes that are cut anywhere, over several batches; an event's last line ends with the next event."""
    event = F.concat(F.lit("\n\nevent: message\ndata: "), F.to_json(F.struct("turn", "role", F.length("text").alias("chars"))), F.lit("\n\ndata: {broken é"))
    rows = v.m.select("conv_id", F.col("turn").cast("long").alias("ms"), F.encode(event, "UTF-8").alias("body"))
    cuts = rows.select("conv_id", "ms", "body", F.explode(F.sequence(F.lit(0), F.length("body") - 1, F.lit(17))).alias("i"))
    chunks = cuts.select("conv_id", "ms", F.col("i").cast("long").alias("event_id"), F.substring(F.col("body"), F.col("i") + 1, F.lit(17)).alias("chunk"))
    part = F.least(F.expr("(2 * ms + int(event_id > 17)) div 3"), F.lit(3))
    v.table("conversations")  # ships the package to the workers
    lines = monitors.lines_of_chunks(v.spark, [chunks.where(part == i) for i in range(4)]).where(F.startswith("line", F.lit("data: ")))
    parsed = lines.select("conv_id", F.from_json(F.substring("line", 7, 1 << 30), "turn long, role string, chars long").alias("d"))
    return parsed.where("d.role is not null").select("conv_id", "d.turn", "d.role", "d.chars")


@query("t10_hourly_rollup_stream", "st", "SELECT event_type AS method, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) FILTER (NOT failed) AS successes, count(*) FILTER (failed) AS failures FROM st GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return jobs.run_complete(v.spark, v.folder, jobs.hourly_rollup, "rollup")


@query("t12_alerts", "st", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (failed) / count(*) > 0.5 AS cascade, epoch_ms(max(ts)) - epoch_ms(min(ts)) > 36000000 AS runaway FROM st GROUP BY 1, 2""")
def _(v: Views) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    days = v.st.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return days.agg((F.count_if("failed") / F.count("*") > 0.5).alias("cascade"), (F.max(ms) - F.min(ms) > 36_000_000).alias("runaway"))


@query("t12_alert_ring", "st", """
SELECT event_id, CASE WHEN latency > 450 THEN 'runaway' ELSE 'failure' END AS alert FROM st WHERE failed OR latency > 450 ORDER BY ts DESC, event_id DESC LIMIT 100""")
def _(v: Views) -> DataFrame:
    """The last hundred alerts."""
    alerts = v.st.where(F.col("failed") | (F.col("latency") > 450)).select("event_id", "ts", F.when(F.col("latency") > 450, "runaway").otherwise("failure").alias("alert"))
    return top(alerts, 100, F.desc("ts"), F.desc("event_id")).select("event_id", "alert")


ALERT_SQL = """
WITH k AS (SELECT *, epoch_us(ts) // 1000 AS ms, user_id // 5 AS provider FROM st),
s AS (SELECT *, lag(event_type, 1) OVER own AS a, lag(event_type, 2) OVER own AS b, """ + ", ".join(f"last_value(CASE WHEN user_id % 5 = {i} THEN failed END IGNORE NULLS) OVER shared AS f{i}" for i in range(5)) + """
  FROM k WINDOW own AS (PARTITION BY user_id ORDER BY ms, event_id), shared AS (PARTITION BY provider ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)),
x AS (SELECT ms, event_id, unnest(list_filter([CASE WHEN event_type = a AND event_type = b THEN 'infinite_loop' END, CASE WHEN 2 * (""" + " + ".join(f"coalesce(f{i}::INT, 0)" for i in range(5)) + ") > " + " + ".join(f"(f{i} IS NOT NULL)::INT" for i in range(5)) + """ THEN 'provider_cascade' END,
  CASE WHEN latency > 450 THEN 'session_runaway' END], lambda n: n IS NOT NULL)) AS alert FROM s) """


@query("t12_w6_alert_stream", "st", ALERT_SQL + "SELECT event_id, alert FROM x")
def _(v: Views) -> DataFrame:
    """Loops, cascades and runaways, found from the states of sessions and providers that batches hand on."""
    v.table("events")
    return monitors.watch(v.spark, v.folder)[0].select("event_id", "alert")


@query("t12_alert_ring_stream", "st", ALERT_SQL + "SELECT event_id, alert FROM x ORDER BY ms DESC, event_id DESC, alert DESC LIMIT 100")
def _(v: Views) -> DataFrame:
    """The ring of the last hundred alerts, which each batch takes on."""
    v.table("events")
    return monitors.watch(v.spark, v.folder)[1].select("event_id", "alert")


_BOUNDS = (50.0, 100.0, 250.0, 400.0)


@query("t13_a33_metrics_updates", "st", "SELECT event_type, count(*) AS counter, arg_max(latency, {'ts': ts, 'event_id': event_id}) AS gauge, round(sum(latency), 6) AS total, " + ", ".join(f"count(*) FILTER (latency <= {b}) AS le_{b:.0f}" for b in _BOUNDS) + " FROM st GROUP BY event_type")
def _(v: Views) -> DataFrame:
    """Counters, gauges and histograms in update mode: a batch rewrites the metrics that it changed."""
    return monitors.run_updates(v.spark, v.folder, monitors.metric_values(_BOUNDS), "metric_values", ["event_type"]).withColumn("total", F.round("total", 6))


@query("t13_sample_cap_stream", "st", f"""
WITH r AS (SELECT event_type, latency, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM st)
SELECT event_type, count(*) AS samples, count(*) FILTER (latency <= 100) AS fast, round(sum(latency), 6) AS sum FROM r
WHERE k <= CASE WHEN n <= {SAMPLE_CAP} THEN n ELSE {SAMPLE_KEEP} + (n - {SAMPLE_CAP} - 1) % ({SAMPLE_CAP} - {SAMPLE_KEEP} + 1) END GROUP BY event_type""")
def _(v: Views) -> DataFrame:
    """A histogram's samples, trimmed while the stream runs."""
    kept = monitors.run_samples(v.spark, v.folder, SAMPLE_CAP, SAMPLE_KEEP)
    return kept.groupBy("event_type").agg(F.count("*").alias("samples"), F.count_if(F.col("value") <= 100).alias("fast"), F.round(F.sum("value"), 6).alias("sum"))


@query("t11_spend_stream", "u sub", """
WITH d AS (SELECT user_id, ts::DATE AS day, sum(tokens_used) AS spent FROM u WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT user_id, day + CAST(i AS INTEGER) AS day, CAST(coalesce(sum(spent) FILTER (i = 0), 0) AS BIGINT) AS today, coalesce(sum(spent) FILTER (i > 0), 0) / 7.0::DOUBLE AS average, count(*) FILTER (i > 0) AS days FROM d, range(8) AS t(i) GROUP BY 1, 2),
l AS (SELECT w.*, CASE WHEN coalesce(balance, 0) <= 0 THEN 0.0::DOUBLE WHEN average <= 100 THEN 999.0::DOUBLE ELSE floor(balance / nullif(average - 100, 0) * 10 + 0.5) / 10 END AS days_left FROM w LEFT JOIN sub USING (user_id))
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, today, round(average, 6) AS average, days_left, CASE WHEN today = 0 THEN 'none' WHEN days = 0 THEN CASE WHEN days_left <= 1 THEN 'critical' ELSE 'none' END WHEN average < 5 THEN 'none' WHEN today / nullif(average, 0) >= 3 THEN 'critical' WHEN today / nullif(average, 0) >= 2 THEN 'warning' ELSE 'none' END AS level FROM l""")
def _(v: Views) -> DataFrame:
    """The spend monitor for every day, from sliding windows over the stream and the stored balances."""
    return monitors.run_updates(v.spark, v.folder, monitors.spend_levels(v.sub.select("user_id", "balance")), "spend", ["user_id", "day"])


@query("t13_metrics_stream", "st", "SELECT event_type, count(*) AS counter, round(sum(latency), 6) AS total FROM st GROUP BY event_type")
def _(v: Views) -> DataFrame:
    return jobs.run_complete(v.spark, v.folder, jobs.metrics, "metrics")


@query("t15_deduplicated_stream", "u", "SELECT DISTINCT user_id, k FROM u")
def _(v: Views) -> DataFrame:
    return jobs.run_complete(v.spark, v.folder, jobs.first_deliveries, "deliveries", "append")


@query("t17_spans", "att", "SELECT l_orderkey AS span_id, count(*) AS children, round(sum(latency), 6) AS child_time, max(latency) AS longest, bool_or(reason = 'R') AS failed FROM att GROUP BY 1")
def _(v: Views) -> DataFrame:
    """A span's children by its id."""
    child = v.att.groupBy(F.col("id").alias("span_id"))
    return child.agg(F.count("*").alias("children"), F.round(F.sum("latency"), 6).alias("child_time"), F.max("latency").alias("longest"), F.bool_or(F.col("reason") == "R").alias("failed"))


@query("t17_trace", "att", """
WITH c AS (
  SELECT l_orderkey AS trace_id, l_orderkey || '.' || pos AS span_id, CAST(l_orderkey AS VARCHAR) AS parent_id, 'attempt' AS operation, epoch_ms(o_orderdate) + pos * 1000 AS start_ms, epoch_ms(o_orderdate) + pos * 1000 + CAST(floor(latency) AS BIGINT) AS end_ms,
    CASE WHEN reason = 'R' THEN 'error' WHEN reason = 'N' THEN 'ok' ELSE 'unset' END AS status FROM att JOIN orders ON o_orderkey = l_orderkey
), r AS (
  SELECT o_orderkey AS trace_id, CAST(o_orderkey AS VARCHAR) AS span_id, NULL AS parent_id, 'session' AS operation, epoch_ms(o_orderdate) AS start_ms, max(end_ms) AS end_ms,
    CASE WHEN max(end_ms) IS NULL THEN 'unset' WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status FROM orders LEFT JOIN c ON trace_id = o_orderkey GROUP BY o_orderkey, o_orderdate
)
SELECT trace_id, span_id, parent_id, operation, start_ms, CASE WHEN status <> 'unset' THEN end_ms END AS end_ms, CASE WHEN status <> 'unset' THEN end_ms - start_ms END AS duration_ms, status FROM (FROM c UNION ALL FROM r)""")
def _(v: Views) -> DataFrame:
    """A session's root span and its children; spans that haven't ended have no end and no duration."""
    begun = v.fallbacks.select("id", F.unix_millis(F.col("ts").cast("timestamp")).alias("begun"))
    status = F.when(F.col("reason") == "R", "error").when(F.col("reason") == "N", "ok").otherwise("unset")
    start = F.col("begun") + F.col("pos") * 1000
    child = v.att.join(begun, "id").select(
        F.col("id").alias("trace_id"), F.concat_ws(".", "id", "pos").alias("span_id"), F.col("id").cast("string").alias("parent_id"), F.lit("attempt").alias("operation"), start.alias("start_ms"),
        (start + F.floor("latency")).alias("end_ms"), status.alias("status"),
    )
    over = child.groupBy(F.col("trace_id").alias("id")).agg(F.max("end_ms").alias("end_ms"), F.bool_or(F.col("status") == "error").alias("bad"))
    root = begun.join(over, "id", "left").select(
        F.col("id").alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("session").alias("operation"), F.col("begun").alias("start_ms"), "end_ms",
        F.when(F.col("end_ms").isNull(), "unset").when(F.col("bad"), "error").otherwise("ok").alias("status"),
    )
    ended = F.col("status") != "unset"
    spans = child.unionByName(root)
    return spans.withColumns({"end_ms": F.when(ended, F.col("end_ms")), "duration_ms": F.when(ended, F.col("end_ms") - F.col("start_ms"))}).select("trace_id", "span_id", "parent_id", "operation", "start_ms", "end_ms", "duration_ms", "status")


#: What a candidate's call gives, by its model; `open` is one whose circuit is open.
_OUTCOMES = ("ok", "timeout", "rate_limit", "billing", "auth", "provider_unavailable", "unknown", "format", "open", "content_filter", "timeout", "rate_limit", "unknown")
KEYS_A_PROVIDER = 3


@query("t18_fallback_chain", "", f"""
WITH RECURSIVE c AS (SELECT l_orderkey AS id, l_suppkey % 4 AS provider, {sql_text(_OUTCOMES)}[l_partkey % {len(_OUTCOMES)} + 1] AS outcome, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 4, {sql_text(_OUTCOMES)}[l_partkey % {len(_OUTCOMES)} + 1]) AS n FROM lineitem
), w AS (
  SELECT o_orderkey AS id, 0::BIGINT AS n, false AS done, false AS success, NULL::BIGINT AS final_provider, 0::BIGINT AS tries, 0::BIGINT AS skipped, []::BIGINT[] AS skip, []::BIGINT[] AS spent, false AS used_fallback FROM orders UNION ALL
  SELECT id, n, done OR (NOT passed AND outcome IN ('ok', 'format', 'content_filter')), success OR (NOT passed AND outcome = 'ok'), CASE WHEN NOT passed AND outcome = 'ok' THEN provider ELSE final_provider END,
    tries + CASE WHEN passed OR outcome = 'ok' THEN 0 WHEN outcome = 'timeout' THEN 2 WHEN outcome IN ('rate_limit', 'auth', 'unknown') AND NOT list_contains(spent, provider) THEN 1 + {KEYS_A_PROVIDER} ELSE 1 END,
    skipped + (NOT done AND list_contains(skip, provider))::INT, CASE WHEN NOT passed AND outcome IN ('billing', 'provider_unavailable') THEN list_append(skip, provider) ELSE skip END,
    CASE WHEN NOT passed AND outcome IN ('rate_limit', 'auth', 'unknown') THEN list_append(spent, provider) ELSE spent END,
    used_fallback OR (NOT passed AND outcome = 'ok' AND (n > 1 OR tries > 0))
  FROM (SELECT w.id, c.n, c.provider, c.outcome, w.done, w.success, w.final_provider, w.tries, w.skipped, w.skip, w.spent, w.used_fallback, w.done OR list_contains(w.skip, c.provider) AS passed FROM w JOIN c ON c.id = w.id AND c.n = w.n + 1)
)
SELECT id, success, final_provider, tries, skipped, CASE WHEN success THEN used_fallback ELSE tries > 0 END AS used_fallback, NOT (success AND tries = 0) AS recorded FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1""")
def _(v: Views) -> DataFrame:
    """Candidates in order until one works.

    A time-out is tried twice; a rate limit, a bad key and an unknown error go on to the provider's next keys, three in a
    request; a billing problem or an unavailable provider skips its other candidates; an open circuit counts as an attempt;
    a wrong format or filtered content ends the request. First-try successes aren't recorded."""
    outcome = F.element_at(F.array(*map(F.lit, _OUTCOMES)), (F.col("model") % len(_OUTCOMES) + 1).cast("int"))
    item = F.struct("pos", (F.col("provider") % 4).alias("provider"), outcome.alias("outcome"))
    chains = v.att.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("candidates"))
    none = F.expr("cast(array() as array<struct<pos:int,provider:bigint,outcome:string>>)")
    rows = v.fallbacks.select("id").join(chains, "id", "left").withColumn("candidates", F.coalesce("candidates", none))
    zero, no, empty = F.lit(0).cast("long"), F.lit(False), F.array().cast("array<bigint>")
    start = F.struct(zero.alias("n"), no.alias("done"), no.alias("success"), F.lit(None).cast("long").alias("final"), zero.alias("tries"), zero.alias("skipped"), empty.alias("skip"), empty.alias("spent"), no.alias("fallback"))

    def step(s, c):
        passed = s["done"] | F.array_contains(s["skip"], c["provider"])
        is_ = lambda *names: ~passed & c["outcome"].isin(*names)
        keys = is_("rate_limit", "auth", "unknown")
        tried = F.when(passed | (c["outcome"] == "ok"), 0).when(is_("timeout"), 2).when(keys & ~F.array_contains(s["spent"], c["provider"]), 1 + KEYS_A_PROVIDER).otherwise(1)
        more = lambda name, when: F.when(when, F.array_append(s[name], c["provider"])).otherwise(s[name]).alias(name)
        return F.struct(
            (s["n"] + 1).alias("n"), (s["done"] | is_("ok", "format", "content_filter")).alias("done"), (s["success"] | is_("ok")).alias("success"), F.when(is_("ok"), c["provider"]).otherwise(s["final"]).alias("final"),
            (s["tries"] + tried).cast("long").alias("tries"), (s["skipped"] + (~s["done"] & passed).cast("long")).alias("skipped"), more("skip", is_("billing", "provider_unavailable")), more("spent", keys),
            (s["fallback"] | (is_("ok") & ((s["n"] > 0) | (s["tries"] > 0)))).alias("fallback"),
        )

    done = rows.select("id", F.aggregate("candidates", start, step).alias("s"))
    success, tries = F.col("s.success"), F.col("s.tries")
    return done.select(
        "id", success.alias("success"), F.col("s.final").alias("final_provider"), tries.alias("tries"), F.col("s.skipped").alias("skipped"), F.when(success, F.col("s.fallback")).otherwise(tries > 0).alias("used_fallback"),
        (~(success & (tries == 0))).alias("recorded"),
    )
