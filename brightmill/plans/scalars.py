"""Numeric, date and conditional scalars (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.functions import numeric as N
from brightmill.plans.catalog import query
from brightmill.plans.texts import UTF16_SQL
from brightmill.sources.views import Views, sql_text


@query("f1_f2_rounding", "", """
SELECT p_partkey, round_even(p_retailprice / 3, 1) AS even1, round_even((p_size - 20) / 2.0::DOUBLE, 0) AS even0, floor((p_size - 20) / 2.0::DOUBLE + 0.5) AS up0, floor(p_retailprice / 7 * 100 + 0.5) / 100 AS up2 FROM part""")
def _(v: Views) -> DataFrame:
    half, price = (F.col("p_size") - 20) / 2, F.col("p_retailprice")
    return v.table("part").select("p_partkey", N.round_even(price / 3, 1).alias("even1"), N.round_even(half).alias("even0"), N.round_up(half).alias("up0"), N.round_up(price / 7, 2).alias("up2"))


@query("f3_f4_f5_arithmetic", "u", """
SELECT event_id, CAST(ceil(response_time / 7) AS BIGINT) AS c, greatest(CASE WHEN k > 50 THEN NULL ELSE k END, 10) AS g, coalesce(nullif(credits_used, 0), tokens_used) AS t, CASE WHEN k = 0 THEN 0 ELSE round(response_time / k, 9) END AS q FROM u""")
def _(v: Views) -> DataFrame:
    k = F.col("k")
    return v.u.select(
        "event_id", F.ceil(F.col("response_time") / 7).alias("c"), F.greatest(F.when(k <= 50, k), F.lit(10)).alias("g"), F.coalesce(F.nullif("credits_used", F.lit(0)), "tokens_used").alias("t"),
        F.when(k == 0, 0.0).otherwise(F.round(F.try_divide(F.col("response_time"), k), 9)).alias("q"),
    )


@query("f6_f7_f8_dates", "u", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, strftime(date_trunc('day', ts) - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before FROM u""")
def _(v: Views) -> DataFrame:
    ts = F.col("ts")
    return v.u.select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH").alias("hour"), F.date_format(F.date_trunc("day", ts) - F.expr("interval 7 days"), "yyyy-MM-dd").alias("week_before"))


@query("f9_f20_humanised", "u", """
SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s // 60 % 60 || 'm' END AS took,
  CASE WHEN tokens_used > 3000 THEN 'business' WHEN tokens_used > 1000 THEN 'pro' ELSE 'free' END AS required_plan, CASE WHEN k > 90 THEN '[URGENT] ' WHEN k > 70 THEN '[HIGH] ' ELSE '' END || endpoint AS subject
FROM (SELECT *, tokens_used * 3 AS s FROM u)""")
def _(v: Views) -> DataFrame:
    tokens, k = F.col("tokens_used"), F.col("k")
    return v.u.select(
        "event_id", N.duration_text(tokens * 3).alias("took"), F.when(tokens > 3000, "business").when(tokens > 1000, "pro").otherwise("free").alias("required_plan"),
        F.concat(F.when(k > 90, "[URGENT] ").when(k > 70, "[HIGH] ").otherwise(""), "endpoint").alias("subject"),
    )


@query("f9_f20_ages_and_sizes", "u", """
WITH s AS (SELECT event_id, tokens_used * tokens_used // 9 AS s, tokens_used * k * k AS b FROM u)
SELECT event_id, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS ago,
  CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN s // 3600 || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
    WHEN s < 7 * 86400 THEN s // 86400 || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS relative,
  CASE WHEN b = 0 THEN '0' ELSE regexp_replace(printf('%.2f', floor(b / power(1024.0::DOUBLE, p) * 100 + 0.5) / 100), '\\.?0+$', '') END || ' ' || ['B', 'KB', 'MB', 'GB'][p + 1] AS size
FROM (SELECT *, CASE WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS p FROM s)""")
def _(v: Views) -> DataFrame:
    rows = v.u.select("event_id", F.floor(F.col("tokens_used") * F.col("tokens_used") / 9).alias("s"), (F.col("tokens_used") * F.col("k") * F.col("k")).alias("b"))
    return rows.select("event_id", N.ago_text(F.col("s")).alias("ago"), N.relative_time(F.col("s")).alias("relative"), N.size_text(F.col("b")).alias("size"))


_HOURS = ("24", "0", "abc", "-5", "721", "720", " 12h", "", None, "1.9", "+3")


@query("p17_clamped_parameters", "u", f"""
WITH p AS (SELECT event_id, {sql_text(_HOURS)}[event_id % {len(_HOURS)} + 1] AS hours, CAST(k AS VARCHAR) AS page FROM u)
SELECT event_id, greatest(1, least(720, coalesce(nullif(try_cast(nullif(regexp_extract(trim(hours), '^[+-]?[0-9]+', 0), '') AS BIGINT), 0), 24))) AS hours, greatest(1, least(50, coalesce(nullif(try_cast(page AS BIGINT), 0), 20))) AS page FROM p""")
def _(v: Views) -> DataFrame:
    hours = F.element_at(F.array(*map(F.lit, _HOURS)), (F.col("event_id") % len(_HOURS) + 1).cast("int"))
    return v.u.select("event_id", N.clamp_column(hours, 1, 720, 24).alias("hours"), N.clamp_column(F.col("k").cast("string"), 1, 50, 20).alias("page"))


@query("f10_token_estimate", "mx", f"SELECT conv_id, turn, {UTF16_SQL % ('text', 'text')} AS units, CAST(ceil({UTF16_SQL % ('text', 'text')} / 4.0) AS BIGINT) + 4 AS tokens FROM mx")
def _(v: Views) -> DataFrame:
    return v.mx.select("conv_id", "turn", N.utf16_length(F.col("text")).alias("units"), N.message_tokens(F.col("text")).alias("tokens"))


@query("f11_f12_credits", "u", """
SELECT event_id, CAST(greatest(ceil(greatest(0, tokens_used - k * 10) / 1000.0::DOUBLE * 3.0::DOUBLE), 1) AS BIGINT) AS by_tokens, CAST(greatest(ceil(ceil(k / 10.0::DOUBLE * 0.05::DOUBLE * 1000) * 0.5::DOUBLE), 1) AS BIGINT) AS by_minutes FROM u""")
def _(v: Views) -> DataFrame:
    by_tokens = N.credits_from_tokens(F.col("tokens_used"), F.col("k") * 10, F.lit(3.0))
    return v.u.select("event_id", by_tokens.alias("by_tokens"), N.credits_from_minutes(F.col("k") / 10, F.lit(0.05), F.lit(0.5)).alias("by_minutes"))


@query("f13_f14_f15_costs", "c price", """
SELECT event_id, round(cost_usd, 9) AS cost, round(input_tokens * 2.5::DOUBLE / 1e6 + output_tokens * 10::DOUBLE / 1e6, 9) AS saved, round(greatest(0, input_tokens * 3::DOUBLE / 1e6 + output_tokens * 15::DOUBLE / 1e6 - cost_usd), 9) AS versus_premium FROM c""")
def _(v: Views) -> DataFrame:
    tin, tout = F.col("input_tokens"), F.col("output_tokens")
    premium = tin * 3.0 / 1e6 + tout * 15.0 / 1e6
    return v.c.select("event_id", F.round("cost_usd", 9).alias("cost"), F.round(N.free_saving(tin, tout), 9).alias("saved"), F.round(F.greatest(F.lit(0.0), premium - F.col("cost_usd")), 9).alias("versus_premium"))


@query("f16_f17_t11_anomaly", "u", """
WITH s AS (SELECT user_id, CAST(coalesce(sum(tokens_used) FILTER (ts >= TIMESTAMP '2024-01-30'), 0) AS BIGINT) AS today, coalesce(sum(tokens_used) FILTER (ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30'), 0) / 7.0::DOUBLE AS average,
  count(DISTINCT ts::DATE) FILTER (ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30') AS days, user_id * 40 AS balance FROM u GROUP BY user_id),
d AS (SELECT *, CASE WHEN balance <= 0 THEN 0.0::DOUBLE WHEN average <= 100 THEN 999.0::DOUBLE ELSE floor(balance / nullif(average - 100, 0) * 10 + 0.5) / 10 END AS days_left FROM s)
SELECT user_id, today, round(average, 6) AS average, days_left, CASE WHEN today = 0 THEN 'none' WHEN days = 0 THEN CASE WHEN days_left <= 1 THEN 'critical' ELSE 'none' END WHEN average < 5 THEN 'none' WHEN today / nullif(average, 0) >= 3 THEN 'critical' WHEN today / nullif(average, 0) >= 2 THEN 'warning' ELSE 'none' END AS level FROM d""")
def _(v: Views) -> DataFrame:
    """Today's spend against the mean of the seven days before, for every user in one pass."""
    day = lambda d: F.expr(f"timestamp_ntz'{d} 00:00:00'")
    today, past = F.col("ts") >= day("2024-01-30"), (F.col("ts") >= day("2024-01-23")) & (F.col("ts") < day("2024-01-30"))
    spent = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens_used"))), F.lit(0))
    s = v.u.groupBy("user_id").agg(spent(today).alias("today"), (spent(past) / 7.0).alias("average"), F.count_distinct(F.when(past, F.col("ts").cast("date"))).alias("days"))
    s = s.withColumn("days_left", N.days_remaining(F.col("user_id") * 40, F.col("average"), F.lit(100.0)))
    level = N.anomaly_level(F.col("today"), F.col("days"), F.col("average"), F.col("days_left"))
    return s.select("user_id", "today", F.round("average", 6).alias("average"), "days_left", level.alias("level"))


@query("f18_cost_recommendations", "c", """
WITH s AS (SELECT user_id, sum(cost_usd) AS cost, count(*) FILTER (cached) / count(*) AS hit, count(*) FILTER (tier = 'free') / count(*) AS free, sum(tokens_used) / count(*) AS size FROM c GROUP BY user_id)
SELECT user_id, list_filter([CASE WHEN cost > 0.1 THEN 'cheaper model' END, CASE WHEN hit < 0.1 THEN 'caching' END, CASE WHEN free < 0.2 THEN 'free tier' END, CASE WHEN size > 500 THEN 'shorter prompts' END], lambda x: x IS NOT NULL) AS advice FROM s""")
def _(v: Views) -> DataFrame:
    n = F.count("*")
    s = v.c.groupBy("user_id").agg(F.sum("cost_usd").alias("cost"), (F.count_if("cached") / n).alias("hit"), (F.count_if(F.col("tier") == "free") / n).alias("free"), (F.sum("tokens_used") / n).alias("size"))
    rules = F.array(F.when(F.col("cost") > 0.1, "cheaper model"), F.when(F.col("hit") < 0.1, "caching"), F.when(F.col("free") < 0.2, "free tier"), F.when(F.col("size") > 500, "shorter prompts"))
    return s.select("user_id", F.array_compact(rules).alias("advice"))


@query("f19_f21_limits_and_backoff", "u", """
SELECT event_id, CAST(greatest(2000, least(floor(tokens_used * 0.3::DOUBLE * 4), 20000)) AS BIGINT) AS budget, CAST(least(30000, 1000 * power(2, k % 8)) AS BIGINT) AS backoff, CAST(least(300000, 30000 * power(2, k % 6)) AS BIGINT) AS cooldown FROM u""")
def _(v: Views) -> DataFrame:
    return v.u.select("event_id", N.tool_budget(F.col("tokens_used")).alias("budget"), N.backoff_ms(F.col("k") % 8 + 1).alias("backoff"), N.cooldown_ms(F.col("k") % 6).alias("cooldown"))


_REASONS = ("timeout", "rate limit", "HTTP 429", "bad gateway", "request timed out", "quota")


@query("t6_cooldowns", "st", f"""
WITH f AS (SELECT event_id, {sql_text(_REASONS)}[event_id % {len(_REASONS)} + 1] AS reason, CAST(floor(latency) AS BIGINT) % 7 AS streak, CASE WHEN event_id % 5 = 0 THEN CAST(floor(latency * 100) AS BIGINT) WHEN event_id % 5 = 1 THEN 0 END AS retry_after,
  CASE WHEN event_id % 4 = 0 THEN 45000 END AS reset FROM st WHERE failed)
SELECT event_id, CAST(CASE WHEN regexp_matches(reason, '(?i)timeout|timed out') THEN NULL WHEN retry_after > 0 THEN retry_after WHEN regexp_matches(reason, '(?i)rate.?limit|429|RESOURCE_EXHAUSTED|quota') THEN coalesce(reset, 60000)
  ELSE least(300000, 30000 * power(2, streak)) END AS BIGINT) AS cooldown_ms FROM f""")
def _(v: Views) -> DataFrame:
    """The wait of a failed key: none after a time-out, else what the provider asks for, the key's own reset, 60 s, or a doubling wait."""
    pick = F.element_at(F.array(*map(F.lit, _REASONS)), (F.col("event_id") % len(_REASONS) + 1).cast("int"))
    fifth = F.col("event_id") % 5
    retry_after = F.when(fifth == 0, F.floor(F.col("latency") * 100)).when(fifth == 1, 0)
    return v.st.where("failed").select("event_id", N.key_cooldown(pick, F.floor("latency") % 7, retry_after, F.when(F.col("event_id") % 4 == 0, 45000)).alias("cooldown_ms"))


@query("f22_f23_f24_prices_flags_hashes", "", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 10 ELSE c_acctbal END AS price, strftime(make_timestamp(CAST(c_custkey * 86400 * 1000000 AS BIGINT)), '%Y-%m-%d') AS since, CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' ELSE 'no' END = 'true' AS flag,
  sha256(c_name) AS hash, left(c_name, 8) || '...' AS masked FROM customer""")
def _(v: Views) -> DataFrame:
    key = F.col("c_custkey")
    return v.table("customer").select(
        "c_custkey", F.when(key % 2 == 0, F.col("c_acctbal") * 10).otherwise(F.col("c_acctbal")).alias("price"), F.date_format(F.timestamp_seconds(key * 86400), "yyyy-MM-dd").alias("since"),
        (F.when(key % 3 == 0, "true").when(key % 3 == 1, "TRUE").otherwise("no") == "true").alias("flag"), F.sha2("c_name", 256).alias("hash"), F.concat(F.left("c_name", F.lit(8)), F.lit("...")).alias("masked"),
    )
