"""Sources, projections, filters, joins, ordering and set operations (S, P, J, O, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.operators.aggregates import top
from brightmill.operators.relational import contains_text, keyset_page, lookup, offset_page, or_default, ordered_children, where_given
from brightmill.plans.catalog import query
from brightmill.sources.views import VIRTUAL_MODELS, Views, before, sql_text

STAMP = "'%Y-%m-%d %H:%M:%S'"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query("s1_p6_scan_time_range", "u", "SELECT event_id, user_id, tokens_used FROM u WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def _(v: Views) -> DataFrame:
    return v.u.where((F.col("ts") >= F.expr("timestamp_ntz'2024-01-10 00:00:00'")) & (F.col("ts") < F.expr("timestamp_ntz'2024-01-12 00:00:00'"))).select("event_id", "user_id", "tokens_used")


@query("s2_point_lookup", "m", "SELECT conv_id, turn, role FROM m WHERE conv_id = 3 AND turn = 0")
def _(v: Views) -> DataFrame:
    return v.m.where("conv_id = 3 and turn = 0").select("conv_id", "turn", "role").limit(1)


@query("s3_exists", "", "SELECT n_nationkey, n_name, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS has_debtor FROM nation")
def _(v: Views) -> DataFrame:
    debtors = v.table("customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("has_debtor")).distinct()
    return lookup(v.table("nation").select("n_nationkey", "n_name"), debtors, ["n_nationkey"], has_debtor=False)


@query("s4_count", "u", "SELECT count(*) AS n FROM u WHERE status_code >= 400 AND user_id = 7")
def _(v: Views) -> DataFrame:
    return v.u.where("status_code >= 400 and user_id = 7").agg(F.count("*").alias("n"))


VM_IDS = tuple(row[0] for row in VIRTUAL_MODELS)


@query("s8_literal_dimension", "u vm", f"""
SELECT event_id, vm.id, vm.tier, vm.category, CAST(vm.max_tokens AS BIGINT) AS max_tokens, tokens_used * vm.multiplier::DOUBLE AS credits
FROM u JOIN vm ON vm.id = {sql_text(VM_IDS)}[k % {len(VM_IDS)} + 1]""")
def _(v: Views) -> DataFrame:
    """Each request with its virtual model, a literal table of a few rows."""
    asked = F.element_at(F.array(*map(F.lit, VM_IDS)), (F.col("k") % len(VM_IDS) + 1).cast("int"))
    rows = v.u.select("event_id", "tokens_used", asked.alias("id")).join(F.broadcast(v.vm), "id")
    return rows.select("event_id", "id", "tier", "category", "max_tokens", (F.col("tokens_used") * F.col("multiplier")).alias("credits"))


@query("s10_env_list", "", """
SELECT doc_id, list_filter(list_transform(string_split(coalesce(nullif('', ''), 'key' || doc_id || ', , ' || source || ' ,z'), ','), lambda x: trim(x)), lambda x: x <> '') AS keys FROM documents""")
def _(v: Views) -> DataFrame:
    """The first non-empty variable, split at commas, trimmed, without blanks."""
    value = F.coalesce(F.nullif(F.lit(""), F.lit("")), F.concat(F.lit("key"), "doc_id", F.lit(", , "), "source", F.lit(" ,z")))
    return v.table("documents").select("doc_id", F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "").alias("keys"))


@query("p1_p4_projection_defaults", "m", "SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 3 = 0 THEN ' ' ELSE role END), ''), 'app') AS source FROM m")
def _(v: Views) -> DataFrame:
    rows = v.m.withColumn("source", F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", or_default("source", "app").alias("source"))


@query("p2_exclusion_projection", "", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def _(v: Views) -> DataFrame:
    return v.table("customer").drop("c_name", "c_acctbal")


@query("p3_p12_computed_projection", "fb", "SELECT id AS event_id, CAST(n_attempts AS BIGINT) AS n_attempts, CASE WHEN success THEN 'ok' ELSE 'failed' END AS outcome, round_even(total_latency / 1000, 1) AS seconds FROM fb WHERE n_attempts > 0")
def _(v: Views) -> DataFrame:
    return v.counted_fallbacks.where("n_attempts > 0").select(
        F.col("id").alias("event_id"), "n_attempts", F.when(F.col("success"), "ok").otherwise("failed").alias("outcome"), F.bround(F.col("total_latency") / 1000, 1).alias("seconds")
    )


@query("p12_nested_predicate", "sub plan", "SELECT s.user_id, p.name FROM sub s JOIN plan p USING (plan_id) WHERE p.product = 'chat' AND p.sort >= 2 AND s.active")
def _(v: Views) -> DataFrame:
    """A predicate on fields of the plan that a subscription holds."""
    plan = v.plan.select("plan_id", F.struct("name", "product", "sort").alias("plan"))
    subscriptions = v.sub.where("active").join(F.broadcast(plan), "plan_id")
    return subscriptions.where((F.col("plan.product") == "chat") & (F.col("plan.sort") >= 2)).select("user_id", "plan.name")


@query("p5_p7_p8_predicates", "u", "SELECT event_id FROM u WHERE endpoint IN ('click', 'purchase') AND status_code = 200 AND (tokens_used > 4000 OR credits_used > 2)")
def _(v: Views) -> DataFrame:
    rows = where_given(v.u, status_code=200, user_id=None)
    return rows.where(F.col("endpoint").isin("click", "purchase") & ((F.col("tokens_used") > 4000) | (F.col("credits_used") > 2))).select("event_id")


@query("p9_null_or_future", "u", "SELECT event_id FROM u WHERE CASE WHEN k % 3 = 0 THEN NULL ELSE ts + INTERVAL 10 DAY END IS NULL OR ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-31'")
def _(v: Views) -> DataFrame:
    expires = F.when(F.col("k") % 3 != 0, F.col("ts") + F.expr("interval 10 days"))
    return v.u.where(expires.isNull() | (expires > before("0 days"))).select("event_id")


@query("p10_p11_text_search", "dx", """
SELECT doc_id, len(list_filter(string_split(lower(text), ' '), lambda w: starts_with(w, 'th'))) > 0 AS prefixed, contains(lower(text), 'a (b') OR contains(lower(text), 'short name') AS found FROM dx""")
def _(v: Views) -> DataFrame:
    words = F.split(F.lower("text"), " ")
    return v.dx.select("doc_id", F.exists(words, lambda w: F.startswith(w, F.lit("th"))).alias("prefixed"), (contains_text("text", "a (b") | contains_text("text", "Short Name")).alias("found"))


@query("p13_self_expression", "sub", "SELECT user_id FROM sub WHERE balance + user_id >= 5000")
def _(v: Views) -> DataFrame:
    return v.sub.where(F.col("balance") + F.col("user_id") >= 5000).select("user_id")


@query("p14_p15_title_search", "m", "SELECT conv_id, turn FROM m WHERE role IS NOT NULL AND text IS NOT NULL AND contains(lower(text), 'the thing')")
def _(v: Views) -> DataFrame:
    return v.m.where(F.col("role").isNotNull() & F.col("text").isNotNull() & contains_text("text", " the thing ")).select("conv_id", "turn")


@query("p18_period_start", "u", """
SELECT p.period, count(*) AS n FROM u JOIN (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('90d', 90)) AS p(period, days) ON u.ts >= TIMESTAMP '2024-01-31' - p.days * INTERVAL 1 DAY GROUP BY p.period""")
def _(v: Views) -> DataFrame:
    periods = {"24h": "1 day", "7d": "7 days", "30d": "30 days", "90d": "90 days"}
    wide = v.u.agg(*[F.count_if(F.col("ts") >= before(length)).alias(name) for name, length in periods.items()])
    return wide.unpivot([], list(periods), "period", "n").where("n > 0")


@query("j1_model_lookup", "c vm", "SELECT vm.id, vm.category, count(*) AS requests FROM c JOIN vm ON vm.tier = c.tier GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    by_tier = v.c.groupBy("tier").agg(F.count("*").alias("requests"))
    return by_tier.join(F.broadcast(v.vm), "tier").select("id", "category", "requests")


@query("j2_plan_features", "sub plan feature plan_feature", """
SELECT s.user_id, p.name, list(coalesce(nullif(pf.display_label, ''), f.label) ORDER BY f.sort) AS labels
FROM sub s JOIN plan p ON p.plan_id = s.plan_id JOIN plan_feature pf ON pf.plan_id = p.plan_id AND pf.enabled JOIN feature f ON f.feature_id = pf.feature_id AND f.active
WHERE s.active GROUP BY 1, 2""")
def _(v: Views) -> DataFrame:
    """What each active subscriber's plan grants. The labels are gathered by plan, from literal tables, before subscribers are joined."""
    joined = v.plan.join(v.plan_feature.where("enabled"), "plan_id").join(F.broadcast(v.feature.where("active").withColumnRenamed("sort", "feature_sort")), "feature_id")
    label = F.coalesce(F.nullif("display_label", F.lit("")), "label")
    lists = joined.groupBy("plan_id", "name").agg(F.sort_array(F.collect_list(F.struct("feature_sort", label.alias("label")))).alias("items"))
    granted = lists.select("plan_id", "name", F.col("items.label").alias("labels"))
    return v.sub.where("active").select("user_id", "plan_id").join(F.broadcast(granted), "plan_id").select("user_id", "name", "labels")


@query("j3_plan_feature_matrix", "sub plan feature plan_feature", """
SELECT p.plan_id, f.feature_id, coalesce(pf.enabled, false) AS enabled, CAST(pf.limit_value AS BIGINT) AS limit_value, coalesce(n.subscribers, 0) AS subscribers
FROM plan p CROSS JOIN feature f LEFT JOIN plan_feature pf ON pf.plan_id = p.plan_id AND pf.feature_id = f.feature_id
LEFT JOIN (SELECT plan_id, count(*) AS subscribers FROM sub WHERE active GROUP BY 1) n ON n.plan_id = p.plan_id""")
def _(v: Views) -> DataFrame:
    """The matrix of plans by features, literal tables of a few rows, with the active subscribers of each plan."""
    cells = v.plan.select("plan_id").join(F.broadcast(v.feature.select("feature_id")))
    matrix = lookup(cells, v.plan_feature.drop("display_label"), ["plan_id", "feature_id"], enabled=False)
    return lookup(matrix, v.sub.where("active").groupBy("plan_id").agg(F.count("*").alias("subscribers")), ["plan_id"], subscribers=0)


@query("j4_u3_semi_anti", "sub", """
SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS without_items""")
def _(v: Views) -> DataFrame:
    orders = v.table("orders")
    buyers = v.table("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.count("*").alias("with_orders"))
    bare = orders.join(v.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("without_items"))
    return buyers.join(bare)


@query("j5_j6_lookup_default", "u price", """
SELECT event_id, coalesce(p.tier, 'freemium') AS tier, coalesce(p.cost_in, 0.0)::DOUBLE AS cost_in, coalesce(q.name, 'none') AS plan
FROM u LEFT JOIN price p ON p.model_id = k % 5 LEFT JOIN (VALUES (0, 1, 'a'), (1, 0, 'b')) AS q(x, y, name) ON q.x = k % 2 AND q.y = k % 3""")
def _(v: Views) -> DataFrame:
    keyed = v.u.select("event_id", (F.col("k") % 5).alias("model_id"), (F.col("k") % 2).alias("x"), (F.col("k") % 3).alias("y"))
    priced = lookup(keyed, F.broadcast(v.price.drop("cost_out")), ["model_id"], tier="freemium", cost_in=0.0)
    pairs = v.spark.createDataFrame([(0, 1, "a"), (1, 0, "b")], "x long, y long, plan string")
    return lookup(priced, F.broadcast(pairs), ["x", "y"], plan="none").select("event_id", "tier", "cost_in", "plan")


@query("j7_unknown_ids", "u price", "SELECT DISTINCT k % 9 AS model_id FROM u WHERE k IS NOT NULL EXCEPT SELECT model_id FROM price")
def _(v: Views) -> DataFrame:
    """Models that requests name and no price list has."""
    asked = v.u.where("k is not null").select((F.col("k") % 9).alias("model_id")).distinct()
    return asked.join(v.price, "model_id", "left_anti")


@query("j8_j9_availability", "st vm", """
WITH h AS (SELECT user_id % 5 AS model, count(*) FILTER (NOT failed) / count(*) >= 0.6 AS ok FROM st GROUP BY user_id)
SELECT model, bool_or(ok) AS available, coalesce(max(l.legacy), false) AS legacy FROM h LEFT JOIN (VALUES (0, true), (3, false)) AS l(m, legacy) ON l.m = h.model GROUP BY model""")
def _(v: Views) -> DataFrame:
    healthy = v.st.groupBy("user_id").agg((F.count_if(~F.col("failed")) / F.count("*") >= 0.6).alias("ok"))
    by_model = healthy.groupBy((F.col("user_id") % 5).alias("model")).agg(F.bool_or("ok").alias("available"))
    legacy = v.spark.createDataFrame([(0, True), (3, False)], "model long, legacy boolean")
    return lookup(by_model, F.broadcast(legacy), ["model"], legacy=False)


@query("j10_calendar_join", "u", """
SELECT strftime(g.d, '%Y-%m-%d') AS day, count(event_id) AS n FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) g(d)
LEFT JOIN u ON date_trunc('day', u.ts) = g.d AND user_id = 3 GROUP BY 1""")
def _(v: Views) -> DataFrame:
    from brightmill.operators.aggregates import daily, fill_days

    return fill_days(daily(v.u.where("user_id = 3"), F.count("*").alias("n")), "2024-01-01", "2024-02-02", n=0)


CALLS_SQL = """WITH calls AS (SELECT user_id, event_id // 4 AS call_id, min(event_id) AS called FROM st WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
results AS (SELECT user_id, event_id // 4 AS call_id, arg_max(latency, event_id) AS result, count(*) AS writes FROM st WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2) """


def _calls(v: Views) -> tuple[DataFrame, DataFrame]:
    call = F.floor(F.col("event_id") / 4).alias("call_id")
    calls = v.st.where(F.col("event_type").isin("click", "view")).groupBy("user_id", call).agg(F.min("event_id").alias("called"))
    results = v.st.where(F.col("event_type").isin("purchase", "error")).groupBy("user_id", call).agg(F.max_by("latency", "event_id").alias("result"), F.count("*").alias("writes"))
    return calls, results


@query("j11_call_result_match", "st", CALLS_SQL + "SELECT user_id, call_id, called, result, writes FROM calls FULL JOIN results USING (user_id, call_id)")
def _(v: Views) -> DataFrame:
    """Calls with the last result written for their id; results without a call are kept."""
    calls, results = _calls(v)
    return calls.join(results, ["user_id", "call_id"], "full")


@query("u4_calls_with_results", "st", CALLS_SQL + "SELECT user_id, call_id, called FROM calls SEMI JOIN results USING (user_id, call_id)")
def _(v: Views) -> DataFrame:
    calls, results = _calls(v)
    return calls.join(results, ["user_id", "call_id"], "left_semi")


@query("j12_conversation_messages", "m", "SELECT conv_id, list(role ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM m GROUP BY conv_id")
def _(v: Views) -> DataFrame:
    whole = ordered_children(v.m.select("conv_id").distinct(), v.m, "conv_id", "turn", columns=["role", "text"])
    chars = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.length(x.text))
    return whole.select("conv_id", F.col("items.role").alias("roles"), chars.alias("chars"))


@query("o1_multi_key_sort", "", "SELECT doc_id, lang, n_chars FROM documents ORDER BY lang DESC, n_chars DESC, doc_id LIMIT 50")
def _(v: Views) -> DataFrame:
    return top(v.table("documents").select("doc_id", "lang", "n_chars"), 50, F.desc("lang"), F.desc("n_chars"), F.asc("doc_id"))


@query("o2_offset_page", "u", "SELECT event_id, (SELECT count(*) FROM u WHERE endpoint = 'click') AS total FROM u WHERE endpoint = 'click' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def _(v: Views) -> DataFrame:
    return offset_page(v.u.where("endpoint = 'click'").select("event_id", "ts"), [F.desc("ts"), F.asc("event_id")], 2, 20).select("event_id", "total")


@query("o3_keyset_page", "u", "WITH a AS (SELECT event_id, ts FROM u WHERE ts < TIMESTAMP '2024-01-20 12:00:00' ORDER BY ts DESC, event_id LIMIT 26) SELECT event_id, (SELECT count(*) > 25 FROM a) AS has_more FROM (SELECT * FROM a ORDER BY ts DESC, event_id LIMIT 25)")
def _(v: Views) -> DataFrame:
    return keyset_page(v.u.select("event_id", "ts"), "ts", F.expr("timestamp_ntz'2024-01-20 12:00:00'"), 25, "event_id").select("event_id", "has_more")


@query("o5_recent_failures", "fb", f"SELECT id, strftime(ts, {STAMP}) AS ts FROM (SELECT * FROM fb WHERE NOT success ORDER BY ts DESC, id LIMIT 20)")
def _(v: Views) -> DataFrame:
    return top(v.fb.where(~F.col("success")).select("id", "ts"), 20, F.desc("ts"), F.asc("id")).select("id", stamp("ts").alias("ts"))


@query("o6_priority_sort", "model", """
SELECT vendor, model_id, row_number() OVER (PARTITION BY vendor ORDER BY CASE WHEN category = 'general' THEN 0 ELSE 1 END, multiplier, model_id) AS place FROM model""")
def _(v: Views) -> DataFrame:
    """Each vendor's models, general ones first."""
    from pyspark.sql import Window

    order = Window.partitionBy("vendor").orderBy((F.col("category") != "general").cast("int"), "multiplier", "model_id")
    return v.model.select("vendor", "model_id", F.row_number().over(order).cast("long").alias("place"))


@query("o7_seeded_sample", "", "SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) ORDER BY md5('seed' || doc_id) LIMIT 10")
def _(v: Views) -> DataFrame:
    """A pool of the best 5 n rows, of which n are drawn by a seeded hash."""
    pool = top(v.table("documents").select("doc_id", "n_chars"), 50, F.desc("n_chars"), F.asc("doc_id"))
    return top(pool, 10, F.md5(F.concat(F.lit("seed"), "doc_id"))).select("doc_id")


@query("o8_o9_sort_slice", "m", "SELECT conv_id, list(turn ORDER BY turn DESC)[1:3] AS newest, list(turn ORDER BY turn)[1:2] AS oldest FROM m GROUP BY conv_id")
def _(v: Views) -> DataFrame:
    turns = v.m.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    return turns.select("conv_id", F.slice(F.reverse("t"), 1, 3).alias("newest"), F.slice("t", 1, 2).alias("oldest"))


@query("u1_ordered_concat", "m", "SELECT 0 AS source, conv_id, turn FROM m WHERE role = 'system' UNION ALL SELECT 1, conv_id, turn FROM m WHERE role = 'user'")
def _(v: Views) -> DataFrame:
    pick = lambda n, role: v.m.where(F.col("role") == role).select(F.lit(n).alias("source"), "conv_id", "turn")
    return pick(0, "system").unionByName(pick(1, "user"))


@query("u5_flatten", "att", "SELECT l_orderkey AS id, pos, provider FROM att")
def _(v: Views) -> DataFrame:
    """Attempts are stored flat; an array of them is only made where one is asked for."""
    return v.att.select("id", "pos", "provider")
