"""Usage, cost, credit, fallback and health aggregations (A1-A37)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightmill.functions.numeric import free_saving, round_even, round_up
from brightmill.operators.aggregates import chargeable, daily, day, fill_days, spent_credits, top, total, weighted
from brightmill.operators.windows import capped
from brightmill.plans.catalog import query
from brightmill.sources.views import Views, as_of, before

USER = 7
CREDITS_SQL = "CASE WHEN credits_used > 0 THEN credits_used ELSE greatest(CAST(ceil(tokens_used / 1000.0) AS BIGINT), 1) END"
CHARGEABLE_SQL = "(credits_used > 0 OR tokens_used > 0)"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = "strftime(ts, '%Y-%m-%d')"


@query("a1_a2_session_tokens", "u", f"""
SELECT CAST(coalesce(sum(tokens_used) FILTER (ts >= {NOW} - INTERVAL 1 DAY), 0) AS BIGINT) AS day_tokens, CAST(coalesce(sum(tokens_used) FILTER (ts >= {NOW} - INTERVAL 12 HOUR), 0) AS BIGINT) AS recent_tokens,
  count(*) FILTER (ts >= {NOW} - INTERVAL 1 DAY) AS day_requests, count(*) FILTER (ts >= {NOW} - INTERVAL 12 HOUR) AS recent_requests
FROM u WHERE user_id = {USER}""")
def _(v: Views) -> DataFrame:
    recent = F.col("ts") >= before("12 hours")
    return v.u.where((F.col("user_id") == USER) & (F.col("ts") >= before("1 day"))).agg(
        total("tokens_used").alias("day_tokens"), total(F.when(recent, F.col("tokens_used"))).alias("recent_tokens"), F.count("*").alias("day_requests"), F.count_if(recent).alias("recent_requests")
    )


@query("a3_top_users_by_cost", "c", """
SELECT user_id, round(sum(cost_usd), 9) AS cost, CAST(sum(tokens_used) AS BIGINT) AS tokens, count(*) AS requests FROM c GROUP BY user_id ORDER BY round(sum(cost_usd), 9) DESC, user_id LIMIT 10""")
def _(v: Views) -> DataFrame:
    by_user = v.c.groupBy("user_id").agg(F.round(F.sum("cost_usd"), 9).alias("cost"), F.sum("tokens_used").alias("tokens"), F.count("*").alias("requests"))
    return top(by_user, 10, F.desc("cost"), F.asc("user_id"))


@query("a4_model_efficiency", "c", """
SELECT model_id, round(sum(cost_usd), 9) AS cost, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(CASE WHEN sum(tokens_used) > 0 THEN sum(cost_usd) / sum(tokens_used) * 1000 ELSE 0 END, 8) AS cost_per_1k
FROM c GROUP BY model_id""")
def _(v: Views) -> DataFrame:
    cost, tokens = F.sum("cost_usd"), F.sum("tokens_used")
    rate = F.when(tokens > 0, F.try_divide(cost, tokens) * 1000).otherwise(0.0)
    return v.c.groupBy("model_id").agg(F.round(cost, 9).alias("cost"), tokens.alias("tokens"), F.round(rate, 8).alias("cost_per_1k")).orderBy("cost_per_1k", "model_id")


@query("a5_auth_health", "st", """
WITH h AS (SELECT CAST(user_id % 4 AS BIGINT) AS method, failed, ts, event_id, event_type FROM st)
SELECT method, count(*) FILTER (NOT failed) AS successes, count(*) FILTER (failed) AS failures, strftime(max(ts) FILTER (failed), '%Y-%m-%d %H:%M:%S') AS last_failure,
  arg_max(event_type, (ts, event_id)) FILTER (failed) AS last_reason,
  floor(CASE WHEN count(*) = 0 THEN 1 ELSE count(*) FILTER (NOT failed) / count(*) END * 10000 + 0.5) / 10000 AS rate,
  count(*) < 10 OR count(*) FILTER (NOT failed) / count(*) >= 0.8 AS healthy FROM h GROUP BY method""")
def _(v: Views) -> DataFrame:
    ok, bad, n = F.count_if(~F.col("failed")), F.count_if("failed"), F.count("*")
    when = F.when(F.col("failed"), F.struct("ts", "event_id"))
    return v.st.groupBy((F.col("user_id") % 4).alias("method")).agg(
        ok.alias("successes"), bad.alias("failures"), F.date_format(F.max(F.when(F.col("failed"), F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_failure"),
        F.max_by("event_type", when).alias("last_reason"), round_up(ok / n, 4).alias("rate"), ((n < 10) | (ok / n >= 0.8)).alias("healthy"),
    )


@query("a6_a7_spend_history", "u", f"""
SELECT {DAY} AS day, CAST(sum({CREDITS_SQL}) AS BIGINT) AS credits, {DAY} = '2024-01-30' AS is_today FROM u
WHERE user_id = {USER} AND ts >= TIMESTAMP '2024-01-23' AND {CHARGEABLE_SQL} GROUP BY {DAY}""")
def _(v: Views) -> DataFrame:
    """The last full day stands for today; the seven before are the history."""
    rows = v.u.where((F.col("user_id") == USER) & (F.col("ts") >= before("8 days")) & chargeable())
    return daily(rows, F.sum(spent_credits()).alias("credits")).withColumn("is_today", F.col("day") == "2024-01-30")


@query("a8_multi_window_usage", "u", f"""
SELECT k AS key_id, """ + ", ".join(f"count(*) FILTER (ts >= {NOW} - INTERVAL {n}) AS requests_{x}, CAST(coalesce(sum(tokens_used) FILTER (ts >= {NOW} - INTERVAL {n}), 0) AS BIGINT) AS tokens_{x}" for x, n in (("hour", "1 HOUR"), ("half_day", "12 HOUR"), ("day", "1 DAY"), ("week", "7 DAY"))) + f"""
FROM u WHERE ts >= {NOW} - INTERVAL 7 DAY GROUP BY k""")
def _(v: Views) -> DataFrame:
    """One scan for all windows."""
    windows = {"hour": "1 hour", "half_day": "12 hours", "day": "1 day", "week": "7 days"}
    measures = []
    for name, length in windows.items():
        inside = F.col("ts") >= before(length)
        measures += [F.count_if(inside).alias(f"requests_{name}"), total(F.when(inside, F.col("tokens_used"))).alias(f"tokens_{name}")]
    return v.u.where(F.col("ts") >= before("7 days")).groupBy(F.col("k").alias("key_id")).agg(*measures)


@query("a9_fallback_summary", "fb", """
SELECT count(*) AS events, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed, round(avg(total_latency), 6) AS avg_latency, round(avg(n_attempts), 6) AS avg_attempts,
  CAST(max(n_attempts) AS BIGINT) AS max_attempts FROM fb""")
def _(v: Views) -> DataFrame:
    n = F.col("n_attempts")
    return v.counted_fallbacks.agg(
        F.count("*").alias("events"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg("total_latency"), 6).alias("avg_latency"),
        F.round(F.avg(n), 6).alias("avg_attempts"), F.max(n).cast("long").alias("max_attempts"),
    )


@query("a10_top_failure_reasons", "att", """
SELECT reason, count(*) AS failures, round_even(avg(latency), 0) AS avg_latency FROM att GROUP BY reason ORDER BY failures DESC, reason LIMIT 10""")
def _(v: Views) -> DataFrame:
    tries = v.att.groupBy("reason").agg(F.count("*").alias("failures"), round_even(F.avg("latency")).alias("avg_latency"))
    return top(tries, 10, F.desc("failures"), F.asc("reason"))


@query("a11_failed_providers", "att", """
SELECT provider, count(*) AS failures, count(DISTINCT model) AS models, arg_min(reason, (o_orderdate, o_orderkey, pos)) AS first_reason
FROM att JOIN orders ON o_orderkey = l_orderkey GROUP BY provider ORDER BY failures DESC, provider LIMIT 10""")
def _(v: Views) -> DataFrame:
    tries = v.att.join(v.fallbacks.select("id", "ts"), "id").groupBy("provider")
    found = tries.agg(F.count("*").alias("failures"), F.count_distinct("model").alias("models"), F.min_by("reason", F.struct("ts", "id", "pos")).alias("first_reason"))
    return top(found, 10, F.desc("failures"), F.asc("provider"))


@query("a12_failures_by_model", "fb", """
SELECT model_class, count(*) AS events, count(*) FILTER (NOT success) AS failures, count(*) FILTER (success) AS successes, round_even(avg(n_attempts), 1) AS avg_attempts,
  round_even(count(*) FILTER (NOT success) / greatest(count(*), 1) * 100, 1) AS failure_rate FROM fb GROUP BY model_class ORDER BY failures DESC, model_class LIMIT 20""")
def _(v: Views) -> DataFrame:
    bad, n = F.count_if(~F.col("success")), F.count("*")
    found = v.counted_fallbacks.groupBy("model_class").agg(
        n.alias("events"), bad.alias("failures"), F.count_if("success").alias("successes"), round_even(F.avg("n_attempts"), 1).alias("avg_attempts"),
        round_even(bad / F.greatest(n, F.lit(1)) * 100, 1).alias("failure_rate"),
    )
    return top(found, 20, F.desc("failures"), F.asc("model_class"))


@query("a13_usage_summary", "u", """
SELECT count(*) AS requests, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(credits_used), 0) AS BIGINT) AS credits, round(avg(response_time), 6) AS avg_response_time,
  count(*) FILTER (status_code < 400) AS succeeded, count(*) FILTER (status_code >= 400) AS failed FROM u""")
def _(v: Views) -> DataFrame:
    ok = F.col("status_code") < 400
    return v.u.agg(
        F.count("*").alias("requests"), total("tokens_used").alias("tokens"), total("credits_used").alias("credits"), F.round(F.avg("response_time"), 6).alias("avg_response_time"),
        F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
    )


@query("a14_usage_by_day", "u", f"""
SELECT {DAY} AS day, count(*) AS requests, CAST(sum(tokens_used) AS BIGINT) AS tokens, CAST(sum(credits_used) AS BIGINT) AS credits FROM u GROUP BY {DAY}""")
def _(v: Views) -> DataFrame:
    return daily(v.u, F.count("*").alias("requests"), F.sum("tokens_used").alias("tokens"), F.sum("credits_used").alias("credits")).orderBy("day")


@query("a15_usage_by_endpoint", "u", """
SELECT endpoint, count(*) AS requests, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM u GROUP BY endpoint ORDER BY requests DESC, endpoint LIMIT 10""")
def _(v: Views) -> DataFrame:
    return top(v.u.groupBy("endpoint").agg(F.count("*").alias("requests"), F.sum("tokens_used").alias("tokens")), 10, F.desc("requests"), F.asc("endpoint"))


@query("a16_user_usage_by_day", "u", f"""
SELECT {DAY} AS day, count(*) AS requests, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(avg(response_time), 6) AS avg_latency FROM u WHERE user_id = {USER} GROUP BY {DAY}""")
def _(v: Views) -> DataFrame:
    return daily(v.u.where(F.col("user_id") == USER), F.count("*").alias("requests"), F.sum("tokens_used").alias("tokens"), F.round(F.avg("response_time"), 6).alias("avg_latency"))


@query("a17_user_model_breakdown", "c", f"""
SELECT coalesce(CASE WHEN cached THEN NULL ELSE 'm' || model_id END, provider) AS model, count(*) AS requests, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(avg(response_time), 6) AS avg_latency
FROM c WHERE user_id = {USER} GROUP BY 1""")
def _(v: Views) -> DataFrame:
    """A virtual model's id where there is one, else the provider."""
    key = F.coalesce(F.when(~F.col("cached"), F.concat(F.lit("m"), "model_id")), "provider")
    found = v.c.where(F.col("user_id") == USER).groupBy(key.alias("model"))
    return found.agg(F.count("*").alias("requests"), F.sum("tokens_used").alias("tokens"), F.round(F.avg("response_time"), 6).alias("avg_latency")).orderBy(F.desc("requests"), "model")


@query("a18_user_tokens_by_day", "u", f"""
SELECT {DAY} AS day, CAST(sum(tokens_used) AS BIGINT) AS tokens, count(*) AS requests FROM u WHERE user_id = {USER} AND ts >= {NOW} - INTERVAL 30 DAY GROUP BY {DAY}""")
def _(v: Views) -> DataFrame:
    return daily(v.u.where((F.col("user_id") == USER) & (F.col("ts") >= before("30 days"))), F.sum("tokens_used").alias("tokens"), F.count("*").alias("requests"))


@query("a19_credits_by_day", "u", f"""
WITH d AS (SELECT {DAY} AS day, CAST(sum({CREDITS_SQL}) AS BIGINT) AS credits FROM u WHERE user_id = {USER} AND ts >= {NOW} - INTERVAL 7 DAY AND {CHARGEABLE_SQL} GROUP BY {DAY})
SELECT strftime(g.d, '%Y-%m-%d') AS day, coalesce(credits, 0) AS credits
FROM generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d) LEFT JOIN d ON d.day = strftime(g.d, '%Y-%m-%d')""")
def _(v: Views) -> DataFrame:
    """A dense calendar of the last seven days before today; days without use have 0."""
    rows = v.u.where((F.col("user_id") == USER) & (F.col("ts") >= before("7 days")) & chargeable())
    return fill_days(daily(rows, F.sum(spent_credits()).alias("credits")), "2024-01-24", "2024-01-30", credits=0)


SUMMARY_SQL = """count(*) AS requests, round(sum(cost_usd), 9) AS cost, CAST(sum(tokens_used) AS BIGINT) AS tokens, round(sum(cost_usd) / greatest(count(*), 1), 12) AS avg_cost,
  round(coalesce(sum(cost_usd) FILTER (cached), 0), 9) AS cache_savings, round(coalesce(sum(input_tokens * 2.5::DOUBLE / 1e6 + output_tokens * 10::DOUBLE / 1e6) FILTER (cost_usd = 0), 0), 9) AS free_savings,
  round(sum(cost_usd) / 30 * 30, 9) AS monthly"""


def _summary() -> list:
    cost, n = F.sum("cost_usd"), F.count("*")
    return [
        n.alias("requests"), F.round(cost, 9).alias("cost"), F.sum("tokens_used").alias("tokens"), F.round(cost / F.greatest(n, F.lit(1)), 12).alias("avg_cost"),
        F.round(F.coalesce(F.sum(F.when(F.col("cached"), F.col("cost_usd"))), F.lit(0.0)), 9).alias("cache_savings"),
        F.round(F.coalesce(F.sum(F.when(F.col("cost_usd") == 0, free_saving(F.col("input_tokens"), F.col("output_tokens")))), F.lit(0.0)), 9).alias("free_savings"),
        F.round(cost / 30 * 30, 9).alias("monthly"),
    ]


@query("a20_user_cost_summary", "c", f"SELECT user_id, {SUMMARY_SQL} FROM c GROUP BY user_id")
def _(v: Views) -> DataFrame:
    return v.c.groupBy("user_id").agg(*_summary())


@query("a20_user_cost_by_model", "c", """
SELECT user_id, model_id, round(sum(cost_usd), 9) AS cost, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM c GROUP BY user_id, model_id""")
def _(v: Views) -> DataFrame:
    return v.c.groupBy("user_id", "model_id").agg(F.round(F.sum("cost_usd"), 9).alias("cost"), F.sum("tokens_used").alias("tokens"))


@query("a21_global_cost_stats", "c", f"SELECT model_id, provider, grouping(model_id) AS no_model, grouping(provider) AS no_provider, count(DISTINCT user_id) AS users, {SUMMARY_SQL} FROM c GROUP BY GROUPING SETS ((), (model_id), (provider))")
def _(v: Views) -> DataFrame:
    sets = v.c.groupingSets([[], [F.col("model_id")], [F.col("provider")]], "model_id", "provider")
    return sets.agg(F.grouping("model_id").cast("long").alias("no_model"), F.grouping("provider").cast("long").alias("no_provider"), F.count_distinct("user_id").alias("users"), *_summary())


HEALTH_SQL = "WITH e AS (SELECT user_id % 5 AS model, user_id, count(*) AS n, avg(latency) AS lat, 100.0 * count(*) FILTER (NOT failed) / count(*) AS rate, max(ts) FILTER (NOT failed) AS last_ok, max(ts) FILTER (failed) AS last_bad FROM st GROUP BY user_id)"


def _endpoints(v: Views) -> DataFrame:
    """One health row for each endpoint (user) of a model."""
    n = F.count("*")
    return v.st.groupBy("user_id").agg(
        n.alias("n"), F.avg("latency").alias("lat"), (100.0 * F.count_if(~F.col("failed")) / n).alias("rate"),
        F.max(F.when(~F.col("failed"), F.col("ts"))).alias("last_ok"), F.max(F.when(F.col("failed"), F.col("ts"))).alias("last_bad"),
    ).withColumn("model", F.col("user_id") % 5)


@query("a22_a23_weighted_model_stats", "st", HEALTH_SQL + """
SELECT model, round(coalesce(sum(lat * n) / nullif(sum(n), 0), 0), 6) AS latency, floor(coalesce(sum(rate * n) / nullif(sum(n), 0), 100) * 100 + 0.5) / 100 AS rate,
  floor(count(*) FILTER (rate >= 50) / count(*) * 100 * 100 + 0.5) / 100 AS uptime, strftime(max(last_ok), '%Y-%m-%d %H:%M:%S') AS last_ok, strftime(max(last_bad), '%Y-%m-%d %H:%M:%S') AS last_bad,
  count(*) FILTER (rate >= 50) / count(*) * 100 >= 50 AND coalesce(sum(rate * n) / nullif(sum(n), 0), 100) >= 50 AS healthy FROM e GROUP BY model""")
def _(v: Views) -> DataFrame:
    up = F.count_if(F.col("rate") >= 50) / F.count("*") * 100
    rate = weighted("rate", "n", 100.0)
    stamp = lambda c: F.date_format(F.max(c), "yyyy-MM-dd HH:mm:ss")
    return _endpoints(v).groupBy("model").agg(
        F.round(weighted("lat", "n", 0.0), 6).alias("latency"), round_up(rate, 2).alias("rate"), round_up(up, 2).alias("uptime"), stamp("last_ok").alias("last_ok"), stamp("last_bad").alias("last_bad"),
        ((up >= 50) & (rate >= 50)).alias("healthy"),
    )


@query("a24_key_stats", "st", """
WITH k AS (SELECT user_id, count(*) AS n, count(*) FILTER (failed) AS f, count(*) FILTER (NOT failed) / count(*) AS r FROM st GROUP BY user_id)
SELECT CAST(user_id % 3 AS BIGINT) AS provider, count(*) AS keys, count(*) FILTER (f < n) AS active, round(avg(CASE WHEN n > 0 THEN r ELSE 1 END), 6) AS success, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(f) AS BIGINT) AS failures FROM k GROUP BY 1""")
def _(v: Views) -> DataFrame:
    keys = v.st.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("failed").alias("f"))
    ratio = F.when(F.col("n") > 0, F.try_divide(F.col("n") - F.col("f"), F.col("n"))).otherwise(1.0)
    return keys.groupBy((F.col("user_id") % 3).alias("provider")).agg(
        F.count("*").alias("keys"), F.count_if(F.col("f") < F.col("n")).alias("active"), F.round(F.avg(ratio), 6).alias("success"), F.sum("n").alias("requests"), F.sum("f").alias("failures")
    )


@query("a25_a34_health_snapshot", "st", HEALTH_SQL + """
SELECT count(*) AS total, count(*) FILTER (rate >= 50) AS healthy, count(*) FILTER (rate < 50) AS unhealthy, count(*) FILTER (rate < 40) AS open_circuits, coalesce(bool_and(rate >= 50), true) AS all_healthy FROM e""")
def _(v: Views) -> DataFrame:
    ok = F.col("rate") >= 50
    return _endpoints(v).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("healthy"), F.count_if(~ok).alias("unhealthy"), F.count_if(F.col("rate") < 40).alias("open_circuits"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_healthy")
    )


@query("a26_key_diagnostics", "", """
WITH k AS (SELECT s_suppkey, list_filter([CASE WHEN s_acctbal < 0 THEN 'negative balance' END, CASE WHEN s_nationkey > 20 THEN 'restricted region' END, CASE WHEN s_suppkey % 10 = 0 THEN 'archived' END], lambda x: x IS NOT NULL) AS issues FROM supplier)
SELECT issue, count(*) AS keys FROM (SELECT unnest(issues) AS issue FROM k) GROUP BY issue""")
def _(v: Views) -> DataFrame:
    flags = F.array(F.when(F.col("s_acctbal") < 0, "negative balance"), F.when(F.col("s_nationkey") > 20, "restricted region"), F.when(F.col("s_suppkey") % 10 == 0, "archived"))
    return v.table("supplier").select(F.explode(F.array_compact(flags)).alias("issue")).groupBy("issue").agg(F.count("*").alias("keys"))


_KEY_FLAGS = "s_acctbal < 0 AS overdrawn, s_nationkey <= 20 AS has_value, s_suppkey % 10 <> 0 AS active"


@query("a26_key_rows", "", f"""
WITH k AS (SELECT s_suppkey AS key_id, s_name AS name, {_KEY_FLAGS} FROM supplier WHERE s_suppkey % 25 <> 0)
SELECT key_id, overdrawn, has_value, active, list_filter([CASE WHEN NOT has_value THEN 'Key "' || name || '" has no stored key value' END, CASE WHEN NOT active THEN 'Key "' || name || '" is inactive' END], lambda x: x IS NOT NULL) AS issues FROM k""")
def _(v: Views) -> DataFrame:
    """Flags and issues of each key that isn't archived."""
    keys = v.table("supplier").where("s_suppkey % 25 <> 0").select(
        F.col("s_suppkey").alias("key_id"), F.col("s_name").alias("name"), (F.col("s_acctbal") < 0).alias("overdrawn"), (F.col("s_nationkey") <= 20).alias("has_value"), (F.col("s_suppkey") % 10 != 0).alias("active")
    )
    said = lambda what: F.concat(F.lit('Key "'), "name", F.lit(f'" {what}'))
    issues = F.array_compact(F.array(F.when(~F.col("has_value"), said("has no stored key value")), F.when(~F.col("active"), said("is inactive"))))
    return keys.select("key_id", "overdrawn", "has_value", "active", issues.alias("issues"))


@query("a27_a28_a29_extreme_prices", "model", """
SELECT tier, arg_max(model_id, (cost_in, -model_id)) FILTER (cost_in > 0) AS dearest, arg_min(model_id, (multiplier, model_id)) AS cheapest,
  coalesce(min(cost_out / cost_in) FILTER (cost_in > 0), 1.0::DOUBLE) AS least_ratio FROM model GROUP BY tier""")
def _(v: Views) -> DataFrame:
    """Of each tier: the dearest model (none if all are free), the one with the least multiplier, and the least ratio of the prices."""
    paid = F.col("cost_in") > 0
    return v.model.groupBy("tier").agg(
        F.max_by(F.when(paid, F.col("model_id")), F.when(paid, F.struct("cost_in", -F.col("model_id")))).alias("dearest"), F.min_by("model_id", F.struct("multiplier", "model_id")).alias("cheapest"),
        F.coalesce(F.min(F.when(paid, F.col("cost_out") / F.col("cost_in"))), F.lit(1.0)).alias("least_ratio"),
    )


@query("a30_u2_entitlement_merge", "sub plan_feature", """
SELECT s.segment, f.feature_id, CAST(max(f.limit_value) AS BIGINT) AS limit_value, max(f.limit_value) IS NULL AS unlimited
FROM (SELECT DISTINCT segment, plan_id FROM sub WHERE active) s JOIN plan_feature f ON f.plan_id = s.plan_id WHERE f.enabled GROUP BY 1, 2""")
def _(v: Views) -> DataFrame:
    """Any limit wins by maximum; a feature without one is simply granted."""
    plans = v.sub.where("active").select("segment", "plan_id").distinct()
    merged = plans.join(F.broadcast(v.plan_feature.where("enabled")), "plan_id").groupBy("segment", "feature_id").agg(F.max("limit_value").alias("limit_value"))
    return merged.withColumn("unlimited", F.col("limit_value").isNull())


FREE_MODELS = (0, 4)


@query("a30_u2_model_union", "sub plan", f"""
SELECT segment, list_sort(list_distinct(list_concat({list(FREE_MODELS)}::BIGINT[], flatten(list(model_ids::BIGINT[]))))) AS model_ids
FROM (SELECT DISTINCT s.segment, p.plan_id, p.model_ids FROM sub s JOIN plan p ON p.plan_id = s.plan_id WHERE s.active) GROUP BY segment""")
def _(v: Views) -> DataFrame:
    """The free models and those of every active plan of a segment."""
    plans = v.sub.where("active").select("segment", "plan_id").distinct().join(F.broadcast(v.plan), "plan_id")
    free = F.array(*(F.lit(x).cast("long") for x in FREE_MODELS))
    return plans.groupBy("segment").agg(F.array_sort(F.array_distinct(F.concat(free, F.flatten(F.collect_list("model_ids"))))).alias("model_ids"))


@query("a31_capability_or", "", """SELECT p_brand, bool_or(p_size > 45) AS large, bool_or(p_type LIKE '%BRASS%') AS brass FROM part GROUP BY p_brand""")
def _(v: Views) -> DataFrame:
    return v.table("part").groupBy("p_brand").agg(F.bool_or(F.col("p_size") > 45).alias("large"), F.bool_or(F.col("p_type").like("%BRASS%")).alias("brass"))


@query("a32_labelled_metrics", "st", """
SELECT event_type, failed, count(*) AS counter, round(sum(latency), 6) AS total, arg_max(latency, (ts, event_id)) AS gauge FROM st GROUP BY event_type, failed""")
def _(v: Views) -> DataFrame:
    return v.st.groupBy("event_type", "failed").agg(F.count("*").alias("counter"), F.round(F.sum("latency"), 6).alias("total"), F.max_by("latency", F.struct("ts", "event_id")).alias("gauge"))


BUCKETS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)


@query("a33_cumulative_histogram", "st", f"""
WITH b AS (SELECT unnest([{', '.join(map(str, BUCKETS))}, 1e308]::DOUBLE[]) AS le)
SELECT event_type, CASE WHEN le > 1e300 THEN '+Inf' ELSE CAST(CAST(le AS BIGINT) AS VARCHAR) END AS le, count(*) FILTER (latency <= le) AS n, round(sum(latency), 6) AS sum FROM st, b GROUP BY event_type, b.le""")
def _(v: Views) -> DataFrame:
    """All buckets in one pass, unpivoted after the aggregation."""
    counts = [F.count_if(F.col("latency") <= b).alias(f"{b:.0f}") for b in BUCKETS] + [F.count("*").alias("+Inf")]
    wide = v.st.groupBy("event_type").agg(F.round(F.sum("latency"), 6).alias("sum"), *counts)
    return wide.unpivot(["event_type", "sum"], [f"{b:.0f}" for b in BUCKETS] + ["+Inf"], "le", "n")


SAMPLE_CAP, SAMPLE_KEEP = 500, 250


@query("a33_sample_cap", "st", f"""
WITH r AS (SELECT event_type, latency, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM st)
SELECT event_type, count(*) AS samples, count(*) FILTER (latency <= 100) AS fast, round(sum(latency), 6) AS sum FROM r
WHERE k <= CASE WHEN n <= {SAMPLE_CAP} THEN n ELSE {SAMPLE_KEEP} + (n - {SAMPLE_CAP} - 1) % ({SAMPLE_CAP} - {SAMPLE_KEEP} + 1) END GROUP BY event_type""")
def _(v: Views) -> DataFrame:
    """A histogram's samples: whenever there are more than the cap, the last ones are kept."""
    kept = capped(v.st, ["event_type"], [F.desc("ts"), F.desc("event_id")], SAMPLE_CAP, SAMPLE_KEEP)
    return kept.groupBy("event_type").agg(F.count("*").alias("samples"), F.count_if(F.col("latency") <= 100).alias("fast"), F.round(F.sum("latency"), 6).alias("sum"))


@query("a35_conversation_preview", "m", """
SELECT conv_id, left(arg_max(text, turn), 100) AS last_message, left(arg_min(text, turn) FILTER (role = 'user'), 50) AS title, count(*) AS messages FROM m GROUP BY conv_id""")
def _(v: Views) -> DataFrame:
    first_user = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return v.m.groupBy("conv_id").agg(F.left(F.max_by("text", "turn"), F.lit(100)).alias("last_message"), F.left(first_user, F.lit(50)).alias("title"), F.count("*").alias("messages"))


@query("a36_w5_recent_latency", "st", """
SELECT event_id, round(avg(latency) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING), 9) AS avg_latency FROM st WHERE NOT failed""")
def _(v: Views) -> DataFrame:
    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-99, 0)
    return v.st.where(~F.col("failed")).select("event_id", F.round(F.avg("latency").over(last), 9).alias("avg_latency"))


@query("a37_plan_progress", "fb", """
SELECT model_class, CAST(floor(100.0 * count(*) FILTER (success) / nullif(count(*), 0) + 0.5) AS BIGINT) AS progress FROM fb GROUP BY model_class""")
def _(v: Views) -> DataFrame:
    return v.fallbacks.groupBy("model_class").agg(round_up(100.0 * F.count_if("success") / F.count("*")).cast("long").alias("progress"))
