"""Writes to stored tables, and what is read back (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.operators.merge import replace_children
from brightmill.operators.stored import Store, bucket, day, expire
from brightmill.plans.catalog import query
from brightmill.plans.merges import UPSERT_SQL, customers
from brightmill.sources.views import Views
from brightmill.streaming.jobs import scratch


def _event_log(v: Views) -> Store:
    """The usage log by day, appended in two batches; the second one is sent twice, as after a lost answer."""
    store = Store(v.spark, scratch(v.spark, "usage"), {"usage": day("ts")})
    rows = v.u.select("event_id", "ts", "endpoint")
    store.commit("log", 0, append={"usage": rows.where("event_id % 3 = 0")})
    for _ in range(2):
        store.commit("log", 1, append={"usage": rows.where("event_id % 3 <> 0")})
    return store


@query("k1_stored_append", "u", "SELECT event_id, endpoint FROM u")
def _(v: Views) -> DataFrame:
    return _event_log(v).read("usage").select("event_id", "endpoint")


@query("k3_stored_upsert", "", UPSERT_SQL + "SELECT c_custkey, c_mktsegment, c_nationkey FROM m")
def _(v: Views) -> DataFrame:
    """Customers in hashed buckets; only buckets with new rows are rewritten."""
    old, new = customers(v)
    store = Store(v.spark, scratch(v.spark, "customers"), {"customers": bucket("c_custkey")})
    store.commit("seed", 0, append={"customers": old})
    for _ in range(2):
        store.upsert("merge", 0, "customers", new, ["c_custkey"], ["c_mktsegment"], ["c_nationkey"])
    return store.read("customers")


def _conversations(v: Views) -> Store:
    """Conversations and their messages in one store, both by the same buckets."""
    layout = bucket("conv_id")
    store = Store(v.spark, scratch(v.spark, "conversations"), {"conversations": layout, "messages": layout})
    heads = v.m.groupBy("conv_id").agg(F.count("*").alias("turns"))
    store.commit("seed", 0, append={"conversations": heads, "messages": v.m.select("conv_id", "turn", "role", F.length("text").alias("chars"))})
    return store


@query("k9_stored_replace", "m", "SELECT conv_id, turn, role FROM m WHERE conv_id % 5 <> 0 OR conv_id NOT IN (SELECT conv_id FROM m WHERE turn = 1) UNION ALL SELECT conv_id, 0 AS turn, 'summary' AS role FROM m WHERE conv_id % 5 = 0 AND turn = 1")
def _(v: Views) -> DataFrame:
    """Messages of some conversations are replaced by one; conversations of one turn keep theirs."""
    store = _conversations(v)
    new = v.m.where("conv_id % 5 = 0 and turn = 1").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("summary").alias("role"), F.lit(0).alias("chars"))
    store.rewrite("summaries", 0, "messages", store.touched("messages", new), lambda old: replace_children(old, new, "conv_id"))
    return store.read("messages").select("conv_id", "turn", "role")


@query("k10_stored_cascade", "m", "SELECT conv_id, turns, turn FROM m JOIN (SELECT conv_id, count(*) AS turns FROM m GROUP BY conv_id) h USING (conv_id) WHERE conv_id NOT IN (SELECT conv_id FROM m WHERE length(text) > 900)")
def _(v: Views) -> DataFrame:
    """Conversations and their messages are deleted in one step."""
    store = _conversations(v)
    base = store.manifest()
    gone = store.read("messages", base=base).where("chars > 900").select("conv_id").distinct()
    parts = store.touched("messages", gone)
    left = {t: store.read(t, parts, base).join(gone, "conv_id", "left_anti") for t in ("conversations", "messages")}
    store.commit("delete", 0, replace=left, drop=dict.fromkeys(left, parts), base=base)
    return store.read("conversations").join(store.read("messages").select("conv_id", "turn"), "conv_id")


@query("k12_stored_retention", "u", "SELECT event_id, endpoint FROM u WHERE ts >= TIMESTAMP '2024-01-24'")
def _(v: Views) -> DataFrame:
    """Days before the last week are dropped by their partitions."""
    store = _event_log(v)
    expire(store, "retention", 0, "usage", "2024-01-24")
    return store.read("usage").select("event_id", "endpoint")


@query("k13_stored_retention", "u", "SELECT event_id, endpoint FROM u WHERE NOT (endpoint = 'view' AND ts < TIMESTAMP '2024-01-24')")
def _(v: Views) -> DataFrame:
    """Of the days before, only rows of one status expire."""
    store = _event_log(v)
    expire(store, "retention", 0, "usage", "2024-01-24", F.col("endpoint") == "view")
    return store.read("usage").select("event_id", "endpoint")
