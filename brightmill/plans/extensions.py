"""Hooks, tools, prompts and observers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.operators.hooks import Hook, Tool, allowed, register, run_hooks
from brightmill.plans.catalog import query
from brightmill.sources.prompts import load_prompts
from brightmill.sources.views import Views
from brightmill.streaming import jobs
from brightmill.streaming.observers import ProgressObserver

TOOLS = register((
    Tool("search"), Tool("images", "pro", ("vision",)), Tool("agent", "business", ("tools", "reasoning")), Tool("old", enabled=False), Tool("files", "pro"), Tool("voice", None, ("audio",)),
    Tool("memory", "pro", factory=True), Tool("devices", "business", ("tools",), factory=True),
))


@query("h1_hook_chain", "u", """
SELECT event_id, CASE WHEN endpoint = 'view' THEN 'chat' ELSE endpoint END AS endpoint, 3 * tokens_used + 1 AS tokens_used FROM u WHERE endpoint <> 'error'""")
def _(v: Views) -> DataFrame:
    """Hooks out of order, two of the default priority in the order given, and one that Spark refuses."""
    hooks = [
        Hook("one more", lambda df: df.withColumn("tokens_used", F.col("tokens_used") + 1)), Hook("no such column", lambda df: df.withColumn("tokens_used", F.col("absent"))),
        Hook("narrow", lambda df: df.select("event_id", "endpoint", "tokens_used"), 200), Hook("no errors", lambda df: df.where("endpoint <> 'error'"), 1), Hook("thrice", lambda df: df.withColumn("tokens_used", F.col("tokens_used") * 3), 50),
        Hook("rename", lambda df: df.withColumn("endpoint", F.when(F.col("endpoint") == "view", "chat").otherwise(F.col("endpoint")))),
    ]
    return run_hooks(v.u, hooks)


@query("h2_tool_registry", "", """
WITH c AS (SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'business' END AS plan, list_filter([CASE WHEN c_nationkey % 2 = 0 THEN 'vision' END, CASE WHEN c_nationkey % 3 = 0 THEN 'tools' END, CASE WHEN c_nationkey % 4 < 2 THEN 'reasoning' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'audio' END], lambda x: x IS NOT NULL) AS caps FROM customer),
l AS (SELECT *, CASE plan WHEN 'pro' THEN 1 WHEN 'business' THEN 2 ELSE 0 END AS level FROM c)
SELECT user_id, list_filter(['search', CASE WHEN level >= 1 AND list_contains(caps, 'vision') THEN 'images' END, CASE WHEN level >= 2 AND list_contains(caps, 'tools') AND list_contains(caps, 'reasoning') THEN 'agent' END, CASE WHEN level >= 1 THEN 'files' END, CASE WHEN list_contains(caps, 'audio') THEN 'voice' END], lambda x: x IS NOT NULL) AS tools,
  list_filter([CASE WHEN level >= 1 THEN 'memory' END, CASE WHEN level >= 2 AND list_contains(caps, 'tools') THEN 'devices' END], lambda x: x IS NOT NULL) AS factories FROM l""")
def _(v: Views) -> DataFrame:
    """The tools of each customer's plan and model."""
    key, nation = F.col("c_custkey") % 4, F.col("c_nationkey")
    plan = F.when(key == 0, "free").when(key == 1, "pro").when(key == 2, "business")
    has = F.array_compact(F.array(F.when(nation % 2 == 0, "vision"), F.when(nation % 3 == 0, "tools"), F.when(nation % 4 < 2, "reasoning"), F.when(F.col("c_mktsegment") == "BUILDING", "audio")))
    rows = v.table("customer").select(F.col("c_custkey").alias("user_id"), plan.alias("plan"), has.alias("has"))
    return rows.select("user_id", allowed(TOOLS, F.col("plan"), F.col("has")).alias("tools"), allowed(TOOLS, F.col("plan"), F.col("has"), factory=True).alias("factories"))


@query("s9_prompt_files", "", """
WITH f AS (SELECT c_mktsegment AS name, c_mktsegment || chr(10) || count(*) AS text FROM customer GROUP BY 1)
SELECT c_custkey AS user_id, name, CASE name WHEN 'MACHINERY' THEN '' WHEN 'BUILDING' THEN 'first ' || text WHEN 'AUTOMOBILE' THEN 'first ' || text ELSE 'second ' || text END AS prompt FROM customer JOIN f ON name = c_mktsegment""")
def _(v: Views) -> DataFrame:
    """A prompt file for each of the few market segments, in two folders; one segment has none, one is in both."""
    first, second, absent = (jobs.scratch(v.spark, f"prompts-{n}") for n in ("first", "second", "absent"))
    jvm = v.spark._jvm
    for name, n in v.table("customer").groupBy("c_mktsegment").count().collect():
        for folder, kind, has in ((first, "first", name in ("BUILDING", "AUTOMOBILE")), (second, "second", name not in ("AUTOMOBILE", "MACHINERY"))):
            if has:
                path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.md")
                out = path.getFileSystem(v.spark._jsc.hadoopConfiguration()).create(path, True)
                out.write(f"{kind} {name}\n{n}".encode())
                out.close()
    wanted = v.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("name"))
    return load_prompts(wanted, [absent, first, second]).select("user_id", "name", F.col("text").alias("prompt"))


@query("h3_stream_progress", "", "SELECT 4::BIGINT AS batches, count(*) AS input_rows, 0::BIGINT AS late_rows FROM events")
def _(v: Views) -> DataFrame:
    """What the roll-up's micro-batches reported while it ran."""
    observer = ProgressObserver(v.spark, jobs.scratch(v.spark, "progress"))
    v.spark.streams.addListener(observer)
    try:
        jobs.run_complete(v.spark, v.folder, jobs.hourly_rollup, "observed")
        observer.wait(4)
    finally:
        v.spark.streams.removeListener(observer)
    with_rows = observer.rows().where("input_rows > 0")
    return with_rows.agg(F.count("*").alias("batches"), F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"))
