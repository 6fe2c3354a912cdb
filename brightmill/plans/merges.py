"""Sinks and mutations as merges (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.operators.merge import first_of_key, insert_if_absent, replace_children, update_where, upsert
from brightmill.plans.catalog import query
from brightmill.sources.views import Views, before


def customers(v: Views) -> tuple[DataFrame, DataFrame]:
    """Stored rows and a batch of new ones, of which some have stored keys."""
    c = v.table("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumns({"c_mktsegment": F.lit("NEW"), "c_nationkey": F.lit(99)})


_BOTH = "WITH o AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, 'NEW' AS c_mktsegment, 99 AS c_nationkey FROM customer WHERE c_custkey % 2 = 0) "


@query("k1_append", "u", "SELECT endpoint, count(*) AS n FROM (SELECT endpoint FROM u UNION ALL SELECT 'batch' FROM u WHERE k = 1) GROUP BY endpoint")
def _(v: Views) -> DataFrame:
    rows = v.u.select("endpoint").unionByName(v.u.where("k = 1").select(F.lit("batch").alias("endpoint")))
    return rows.groupBy("endpoint").agg(F.count("*").alias("n"))


@query("k2_insert_if_absent", "", _BOTH + "SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o USING (c_custkey)")
def _(v: Views) -> DataFrame:
    return insert_if_absent(*customers(v), ["c_custkey"])


UPSERT_SQL = _BOTH + """, m AS (SELECT c_custkey, CASE WHEN n.c_nationkey IS NOT NULL THEN n.c_mktsegment ELSE o.c_mktsegment END AS c_mktsegment, CASE WHEN o.c_nationkey IS NOT NULL THEN o.c_nationkey ELSE n.c_nationkey END AS c_nationkey,
  CASE WHEN o.c_nationkey IS NULL THEN 'inserted' WHEN n.c_nationkey IS NOT NULL THEN 'modified' ELSE 'kept' END AS change FROM o FULL JOIN n USING (c_custkey)) """


@query("k3_upsert", "", UPSERT_SQL + "SELECT * FROM m")
def _(v: Views) -> DataFrame:
    return upsert(*customers(v), ["c_custkey"], ["c_mktsegment"], ["c_nationkey"])


@query("k4_bulk_upsert_counts", "", UPSERT_SQL + "SELECT change, count(*) AS n FROM m GROUP BY change")
def _(v: Views) -> DataFrame:
    return upsert(*customers(v), ["c_custkey"], ["c_mktsegment"], ["c_nationkey"]).groupBy("change").agg(F.count("*").alias("n"))


@query("k5_increment", "u", "SELECT k AS key_id, 100 + count(*) AS requests, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM u GROUP BY k")
def _(v: Views) -> DataFrame:
    """Counters are sums over the log, from where they stood."""
    return v.u.groupBy(F.col("k").alias("key_id")).agg((F.lit(100) + F.count("*")).alias("requests"), F.sum("tokens_used").alias("tokens"))


@query("k6_hourly_bucket", "st", "SELECT event_type AS method, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) FILTER (NOT failed) AS successes, count(*) FILTER (failed) AS failures FROM st GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH")
    return v.st.groupBy(F.col("event_type").alias("method"), hour.alias("hour")).agg(F.count_if(~F.col("failed")).alias("successes"), F.count_if("failed").alias("failures"))


@query("k7_conditional_update", "", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 OR s_nationkey = 3 THEN 0 ELSE s_acctbal END AS s_acctbal, s_acctbal < 0 OR s_nationkey = 3 AS modified FROM supplier")
def _(v: Views) -> DataFrame:
    changed = update_where(v.table("supplier"), (F.col("s_acctbal") < 0) | (F.col("s_nationkey") == 3), s_acctbal=F.lit(0.0))
    return changed.select("s_suppkey", "s_acctbal", "modified")


@query("k8_unset", "m", "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN NULL ELSE role END AS role FROM m")
def _(v: Views) -> DataFrame:
    return update_where(v.m, F.col("conv_id") % 2 == 0, role=F.lit(None).cast("string")).select("conv_id", "turn", "role")


@query("k9_replace_children", "m", "SELECT conv_id, turn, role FROM m WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id, 0 AS turn, 'summary' AS role FROM m WHERE conv_id % 5 = 0 AND turn = 1")
def _(v: Views) -> DataFrame:
    new = v.m.where("conv_id % 5 = 0 and turn = 1").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("summary").alias("role"))
    # conversations of one turn keep what they have
    old = v.m.select("conv_id", "turn", "role").where("conv_id % 5 <> 0")
    return replace_children(old, new, "conv_id")


@query("k10_cascade_delete", "m", "SELECT conv_id, turn FROM m WHERE conv_id NOT IN (SELECT conv_id FROM m WHERE length(text) > 900)")
def _(v: Views) -> DataFrame:
    gone = v.m.where(F.length("text") > 900).select("conv_id").distinct()
    return v.m.select("conv_id", "turn").join(gone, "conv_id", "left_anti")


@query("k11_t15_idempotent_append", "u", "SELECT user_id, k, min(event_id) AS event_id FROM u GROUP BY user_id, k")
def _(v: Views) -> DataFrame:
    return first_of_key(v.u.select("user_id", "k", "event_id"), ["user_id", "k"], "event_id")


@query("k12_retained_rows", "u", "SELECT event_id FROM u WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def _(v: Views) -> DataFrame:
    return v.u.where(F.col("ts") > before("7 days")).select("event_id")


@query("k13_partially_retained_rows", "u", "SELECT event_id, endpoint FROM u WHERE NOT (endpoint = 'view' AND ts <= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)")
def _(v: Views) -> DataFrame:
    """Only rows of one status expire."""
    return v.u.where((F.col("ts") > before("7 days")) | (F.col("endpoint") != "view")).select("event_id", "endpoint")


@query("k14_compare_and_set", "u", """
WITH a AS (SELECT c_custkey AS user_id, c_custkey % 3 AS refreshed, CAST(floor(c_acctbal) AS BIGINT) AS free FROM customer),
w AS (SELECT a.user_id, arg_min(u.event_id, (u.ts, u.event_id)) AS event_id FROM a JOIN u ON u.user_id = a.user_id AND u.k % 3 = a.refreshed GROUP BY a.user_id)
SELECT a.user_id, CASE WHEN w.user_id IS NULL THEN a.free ELSE 100 END AS free, w.event_id AS refreshed_by FROM a LEFT JOIN w USING (user_id)""")
def _(v: Views) -> DataFrame:
    """Each event wants to refresh its user's credits if the last refresh is still the one it has read; the first such event
    wins, since it changes what the others compare with."""
    accounts = v.table("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 3).alias("refreshed"), F.floor("c_acctbal").cast("long").alias("free"))
    wishes = v.u.select("user_id", (F.col("k") % 3).alias("refreshed"), "ts", "event_id")
    won = first_of_key(wishes.withColumn("order", F.struct("ts", "event_id")), ["user_id", "refreshed"], "order")
    stored = accounts.join(won.select("user_id", "refreshed", F.col("order.event_id").alias("refreshed_by")), ["user_id", "refreshed"], "left")
    return stored.select("user_id", F.when(F.col("refreshed_by").isNull(), F.col("free")).otherwise(100).alias("free"), "refreshed_by")


@query("k12_k13_retention", "u", "SELECT count(*) FILTER (ts > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS week, count(*) FILTER (NOT (endpoint = 'view' AND ts <= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)) AS partial FROM u")
def _(v: Views) -> DataFrame:
    """Rows kept by age, and by age of one status only."""
    fresh = F.col("ts") > before("7 days")
    return v.u.agg(F.count_if(fresh).alias("week"), F.count_if(fresh | (F.col("endpoint") != "view")).alias("partial"))
