"""Window behaviours (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightmill.functions.numeric import message_tokens
from brightmill.functions.urls import normalize_url
from brightmill.operators.aggregates import chargeable, daily, fill_days, spent_credits
from brightmill.operators.windows import first_by, fitting_suffix, numbered, run_length
from brightmill.plans.analytics import CHARGEABLE_SQL, CREDITS_SQL, DAY
from brightmill.plans.catalog import query
from brightmill.plans.texts import NORMALIZE_SQL
from brightmill.sources.views import Views


@query("w1_latest_per_user", "u", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM u WHERE endpoint = 'purchase' GROUP BY user_id")
def _(v: Views) -> DataFrame:
    return first_by(v.u.where("endpoint = 'purchase'"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("w2_citation_ids", "", f"""
WITH n AS (SELECT page_id, {NORMALIZE_SQL} AS u FROM pages), f AS (SELECT u, min(page_id) AS first FROM n GROUP BY u)
SELECT page_id, n.u AS url, dense_rank() OVER (ORDER BY f.first) AS citation FROM n JOIN f USING (u)""")
def _(v: Views) -> DataFrame:
    """Ids by first sight: one row a URL is ranked, not one a page."""
    pages = v.pages.select("page_id", normalize_url(F.col("url")).alias("url"))
    first = pages.groupBy("url").agg(F.min("page_id").alias("first"))
    return pages.join(numbered(first, "first", "citation"), "url").select("page_id", "url", "citation")


@query("w3_first_wins", "", """
SELECT lang, source, arg_min(doc_id, (o, doc_id)) AS doc_id FROM (SELECT 0 AS o, lang, source, doc_id FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 1, lang, source, doc_id FROM documents) GROUP BY lang, source""")
def _(v: Views) -> DataFrame:
    d = v.table("documents").select("lang", "source", "doc_id")
    both = d.where("doc_id % 2 = 1").withColumn("o", F.lit(0)).unionByName(d.withColumn("o", F.lit(1)))
    return first_by(both, ["lang", "source"], F.asc("o"), F.asc("doc_id")).select("lang", "source", "doc_id")


@query("w4_token_budget", "m", """
SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(CAST(ceil(length(text) / 4.0) AS BIGINT) + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM m) WHERE used <= 300""")
def _(v: Views) -> DataFrame:
    return fitting_suffix(v.m, ["conv_id"], [F.desc("turn")], message_tokens(F.col("text")), 300).select("conv_id", "turn", "used")


@query("w6_repeated_actions", "st", """
SELECT event_id FROM (SELECT event_id, event_type, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM st WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = a AND event_type = b""")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = v.st.select("event_id", "event_type", F.lag("event_type", 1).over(w).alias("a"), F.lag("event_type", 2).over(w).alias("b"))
    return rows.where("event_type = a and event_type = b").select("event_id")


@query("w7_failure_runs", "st", """
WITH i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM st)
SELECT event_id, CAST(sum(failed::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS streak FROM i""")
def _(v: Views) -> DataFrame:
    return run_length(v.st, ["user_id"], ["ts", "event_id"], ~F.col("failed"), "streak").select("event_id", "streak")


@query("w8_date_buckets", "u", """
SELECT CASE date_diff('day', ts::DATE, DATE '2024-01-30') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE 'Earlier' END AS bucket, count(*) AS n FROM u GROUP BY 1""")
def _(v: Views) -> DataFrame:
    age = F.date_diff(F.lit("2024-01-30").cast("date"), F.col("ts").cast("date"))
    return v.u.groupBy(F.when(age == 0, "Today").when(age == 1, "Yesterday").otherwise("Earlier").alias("bucket")).agg(F.count("*").alias("n"))


@query("w9_last_user_turns", "m", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM m WHERE role = 'user') WHERE k <= 3")
def _(v: Views) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return v.m.where("role = 'user'").withColumn("k", k).where("k <= 3").select("conv_id", "turn")


@query("w10_trailing_ratio", "u", f"""
WITH d AS (SELECT {DAY} AS day, sum({CREDITS_SQL}) AS credits FROM u WHERE user_id = 7 AND {CHARGEABLE_SQL} GROUP BY 1),
c AS (SELECT strftime(g.d, '%Y-%m-%d') AS day, CAST(coalesce(credits, 0) AS BIGINT) AS credits FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d) LEFT JOIN d ON d.day = strftime(g.d, '%Y-%m-%d'))
SELECT day, credits, round(credits / nullif(avg(credits) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0), 6) AS ratio FROM c""")
def _(v: Views) -> DataFrame:
    days = fill_days(daily(v.u.where(F.col("user_id") == 7).where(chargeable()), F.sum(spent_credits()).alias("credits")), "2024-01-01", "2024-01-30", credits=0)
    mean = F.avg("credits").over(Window.partitionBy(F.lit(7)).orderBy("day").rowsBetween(-7, -1))
    return days.withColumn("ratio", F.round(F.try_divide(F.col("credits"), F.nullif(mean, F.lit(0.0))), 6))


@query("w11_w12_w13_key_order", "", """
SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal < 0, s_acctbal, s_suppkey) AS place, max(s_acctbal) OVER (PARTITION BY s_nationkey, s_acctbal < 0) AS most,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 10 = 0, s_acctbal < 0, s_acctbal, s_suppkey) = 1 AND s_suppkey % 10 <> 0 AS chosen FROM supplier""")
def _(v: Views) -> DataFrame:
    """Order of a provider's keys, the group's largest priority, and the first key that may be used."""
    paid, nation = F.col("s_acctbal") < 0, Window.partitionBy("s_nationkey")
    usable = nation.orderBy(F.col("s_suppkey") % 10 == 0, paid, "s_acctbal", "s_suppkey")
    return v.table("supplier").select(
        "s_suppkey", F.row_number().over(nation.orderBy(paid, "s_acctbal", "s_suppkey")).cast("long").alias("place"), F.max("s_acctbal").over(Window.partitionBy("s_nationkey", paid)).alias("most"),
        ((F.row_number().over(usable) == 1) & (F.col("s_suppkey") % 10 != 0)).alias("chosen"),
    )
