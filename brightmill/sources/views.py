"""Views of the stored tables as the service's logs and dimensions, in Spark and as SQL.

Each view is declared twice, as a lazily built DataFrame and as a SQL common table expression with the same
rows, so that a query and its SQL start from the same data. All windows are relative to the fixed `AS_OF`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightmill.session import ship_package

AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.expr(f"timestamp_ntz'{AS_OF_TEXT}'")


def before(interval: str) -> Column:
    """`interval` before AS_OF, e.g. '7 days'."""
    return F.expr(f"timestamp_ntz'{AS_OF_TEXT}' - interval {interval}")


#: model_id, tier, cost of a million input and output tokens. Model 4 is left out on purpose.
PRICES = ((0, "free", 0.0, 0.0), (1, "pro", 0.5, 1.5), (2, "pro", 2.5, 10.0), (3, "business", 3.0, 15.0))
#: id, tier, credit multiplier, category, max tokens.
VIRTUAL_MODELS = (
    ("fast", "free", 0.5, "general", 4096), ("base", "free", 1.0, "general", 8192), ("pro", "pro", 3.0, "general", 16384),
    ("code", "pro", 5.0, "coding", 32768), ("thinking", "business", 5.0, "reasoning", 65536),
)
TIER_LIMITS = (("free", 20), ("pro", 60), ("pro_plus", 120), ("business", 200), ("enterprise", -1))
PLANS = (("p1", "Free", "chat", (0,), 1), ("p2", "Pro", "chat", (0, 1, 2), 2), ("p3", "Business Max", "chat", (1, 2, 3), 3), ("p4", "Enterprise", "api", (0, 1, 2, 3), 4))
FEATURES = (("f1", "Messages", "limits", 1, True), ("f2", "Uploads", "limits", 2, True), ("f3", "Voice", "media", 3, True), ("f4", "Legacy", "media", 4, False), ("f5", "Unused", "media", 5, True))
PLAN_FEATURES = (
    ("p1", "f1", True, 50, None), ("p1", "f2", False, 5, None), ("p2", "f1", True, 500, None), ("p2", "f2", True, 20, "Files"), ("p2", "f3", True, None, ""),
    ("p3", "f1", True, None, "Unlimited messages"), ("p3", "f2", True, 200, None), ("p3", "f4", True, None, None), ("p4", "f3", True, 60, None),
)
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "fbclid", "gclid")
#: Appended to texts by id, so that each branch of the text functions is met.
PHRASES = (
    "", "compare and evaluate the trade-offs step by step", "run `npm install` then fix the TypeError in app.ts", "calculate 12 + 30 and prove the theorem",
    "write a story and also summarize it", "search https://example.com/a for the latest price", "[TITLE]Short name[/TITLE] body", "<thinking>hidden</thinking>visible",
    "token_abcdefghijklmnopqrstuvwxyz", "token_abcdefghij", "OpenAI then anthropic, both failed together", "HTTP 429 too many requests", "insufficient balance",
    "invalid api key", "deadline exceeded", "not available in your country", "content filter", "él l été", "\U0001f600", "Dear {name}, about {topic} and {name}",
    "[BANNER x]y[/BANNER] kept [REACT:ok]", "<TITRE>Autre nom</TITRE> 1. one\n2. two",
)


def sql_text(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, tuple):
        return f"[{', '.join(map(sql_text, value))}]"
    return "'" + value.replace("'", "''") + "'"


def sql_values(rows: tuple, columns: str) -> str:
    """SELECT * of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql_text, r)) + ')' for r in rows)}) AS t({columns})"


_PHRASE = f"{sql_text(PHRASES)}[%s %% {len(PHRASES)} + 1]"

#: SQL of each view; a view may use those before it.
VIEW_SQL = {
    "u": """SELECT event_id, ts, user_id, event_type AS endpoint, value AS response_time, CAST(floor(value * 10) AS BIGINT) AS tokens_used,
        CASE WHEN event_type = 'purchase' THEN CAST(ceil(value / 100) AS BIGINT) ELSE 0 END AS credits_used,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "price": f"SELECT CAST(model_id AS BIGINT) AS model_id, tier, cost_in, cost_out FROM ({sql_values(PRICES, 'model_id, tier, cost_in, cost_out')})",
    "c": """SELECT u.*, u.k % 5 AS model_id, 'p' || (u.k % 3) AS provider, u.tokens_used - u.tokens_used // 4 AS input_tokens, u.tokens_used // 4 AS output_tokens,
        coalesce(p.tier, 'freemium') AS tier, u.k % 7 = 0 AS cached,
        CASE WHEN p.tier IS NULL OR p.tier = 'free' THEN 0.0::DOUBLE
          ELSE (u.tokens_used - u.tokens_used // 4) * p.cost_in::DOUBLE / 1e6 + (u.tokens_used // 4) * p.cost_out::DOUBLE / 1e6 END AS cost_usd
        FROM u LEFT JOIN price p ON p.model_id = u.k % 5""",
    "att": "SELECT l_orderkey, l_linenumber AS pos, l_suppkey AS provider, l_partkey AS model, l_returnflag AS reason, l_extendedprice AS latency FROM lineitem",
    "fb": """SELECT o_orderkey AS id, o_orderdate AS ts, o_orderpriority AS model_class, o_orderstatus = 'F' AS success, o_totalprice AS total_latency,
        coalesce(a.n, 0) AS n_attempts FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a ON a.l_orderkey = o_orderkey""",
    "st": "SELECT event_id, user_id, ts, event_type, value AS latency, event_type IN ('error', 'signup') AS failed FROM events",
    "m": "SELECT conv_id, turn, role, text FROM conversations",
    "dx": f"SELECT doc_id, lang, source, text || ' ' || {_PHRASE % 'doc_id'} AS text FROM documents",
    "mx": f"SELECT conv_id, turn, role, text || ' ' || {_PHRASE % '(conv_id + turn)'} AS text FROM conversations",
    "vm": sql_values(VIRTUAL_MODELS, "id, tier, multiplier, category, max_tokens"),
    "plan": sql_values(PLANS, "plan_id, name, product, model_ids, sort"),
    "feature": sql_values(FEATURES, "feature_id, label, category, sort, active"),
    "plan_feature": sql_values(PLAN_FEATURES, "plan_id, feature_id, enabled, limit_value, display_label"),
    "model": """SELECT p_partkey AS model_id, p_brand AS vendor, CASE WHEN p_size % 3 = 0 THEN 'general' ELSE lower(p_type) END AS category,
        CASE p_size % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'pro' ELSE 'business' END AS tier, (p_size % 5 + 1) / 2 AS multiplier,
        CASE WHEN p_size % 4 = 0 THEN 0.0::DOUBLE ELSE p_retailprice / 1000 END AS cost_in, p_retailprice * (p_size % 5 + 2) / 1000 AS cost_out FROM part""",
    "sub": """SELECT c_custkey AS user_id, 'p' || (c_custkey % 4 + 1) AS plan_id, c_mktsegment AS segment, CAST(floor(c_acctbal) AS BIGINT) AS balance,
        c_custkey % 3 <> 0 AS active FROM customer""",
}


def with_views(names: str, body: str) -> str:
    """`body` with the named views (and what they use) as common table expressions."""
    wanted = set(names.split())
    if "c" in wanted:
        wanted |= {"u", "price"}
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in VIEW_SQL if n in wanted]
    body = body.strip()
    if not parts:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{', '.join(parts)}, {body[len(start):]}"
    return f"WITH {', '.join(parts)} {body}"


def phrase(key: Column) -> Column:
    """Negative keys count from the end; there is no phrase 0, and none of a null (of which element_at makes the last one)."""
    number = (key % len(PHRASES) + 1).cast("int")
    return F.when(number != 0, F.element_at(F.array(*map(F.lit, PHRASES)), number))


class Views:
    """The views over the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        ship_package(self.spark)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def literal(self, rows: tuple, schema: str) -> DataFrame:
        return self.spark.createDataFrame([tuple(list(x) if isinstance(x, tuple) else x for x in r) for r in rows], schema)

    @cached_property
    def u(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            "event_id", "ts", "user_id", F.col("event_type").alias("endpoint"), F.col("value").alias("response_time"), F.floor(F.col("value") * 10).cast("long").alias("tokens_used"),
            F.when(F.col("event_type") == "purchase", F.ceil(F.col("value") / 100)).otherwise(0).cast("long").alias("credits_used"),
            F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        )

    @cached_property
    def price(self) -> DataFrame:
        return self.literal(PRICES, "model_id long, tier string, cost_in double, cost_out double")

    @cached_property
    def c(self) -> DataFrame:
        u = self.u.withColumns({
            "model_id": F.col("k") % 5, "provider": F.concat(F.lit("p"), F.col("k") % 3), "output_tokens": F.floor(F.col("tokens_used") / 4), "cached": F.col("k") % 7 == 0,
        }).withColumn("input_tokens", F.col("tokens_used") - F.col("output_tokens"))
        priced = u.join(F.broadcast(self.price), "model_id", "left")
        paid = F.col("input_tokens") * F.col("cost_in") / 1e6 + F.col("output_tokens") * F.col("cost_out") / 1e6
        cost = F.when(F.col("tier").isNull() | (F.col("tier") == "free"), 0.0).otherwise(paid)
        return priced.withColumns({"cost_usd": cost, "tier": F.coalesce("tier", F.lit("freemium"))}).drop("cost_in", "cost_out")

    @cached_property
    def att(self) -> DataFrame:
        """The attempts of fallback events, a row each."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("provider"), F.col("l_partkey").alias("model"), F.col("l_returnflag").alias("reason"),
            F.col("l_extendedprice").alias("latency"),
        )

    @cached_property
    def fallbacks(self) -> DataFrame:
        """Fallback events without their attempts."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("model_class"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("total_latency")
        )

    @cached_property
    def counted_fallbacks(self) -> DataFrame:
        """Fallback events with the number of their attempts."""
        n = self.att.groupBy("id").agg(F.count("*").alias("n_attempts"))
        return self.fallbacks.join(n, "id", "left").withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))

    @cached_property
    def fb(self) -> DataFrame:
        """Fallback events with the ordered array of their attempts."""
        attempt = F.struct("pos", "provider", "model", "reason", "latency")
        tries = self.att.groupBy("id").agg(F.sort_array(F.collect_list(attempt)).alias("attempts"))
        none = F.expr("cast(array() as array<struct<pos:int,provider:bigint,model:bigint,reason:string,latency:double>>)")
        return self.fallbacks.join(tries, "id", "left").withColumn("attempts", F.coalesce("attempts", none))

    @cached_property
    def st(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", "ts", "event_type", F.col("value").alias("latency"), F.col("event_type").isin("error", "signup").alias("failed"))

    @cached_property
    def m(self) -> DataFrame:
        return self.table("conversations").select("conv_id", "turn", "role", "text")

    @cached_property
    def dx(self) -> DataFrame:
        return self.table("documents").select("doc_id", "lang", "source", F.concat("text", F.lit(" "), phrase(F.col("doc_id"))).alias("text"))

    @cached_property
    def mx(self) -> DataFrame:
        return self.m.withColumn("text", F.concat("text", F.lit(" "), phrase(F.col("conv_id") + F.col("turn"))))

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def vm(self) -> DataFrame:
        return self.literal(VIRTUAL_MODELS, "id string, tier string, multiplier double, category string, max_tokens long")

    @cached_property
    def plan(self) -> DataFrame:
        return self.literal(PLANS, "plan_id string, name string, product string, model_ids array<long>, sort int")

    @cached_property
    def feature(self) -> DataFrame:
        return self.literal(FEATURES, "feature_id string, label string, category string, sort int, active boolean")

    @cached_property
    def plan_feature(self) -> DataFrame:
        return self.literal(PLAN_FEATURES, "plan_id string, feature_id string, enabled boolean, limit_value long, display_label string")

    @cached_property
    def model(self) -> DataFrame:
        """Models on offer with their prices."""
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("vendor"), F.when(size % 3 == 0, "general").otherwise(F.lower("p_type")).alias("category"),
            F.when(size % 4 == 0, "free").when(size % 4 == 3, "business").otherwise("pro").alias("tier"), ((size % 5 + 1) / 2).alias("multiplier"),
            F.when(size % 4 == 0, 0.0).otherwise(F.col("p_retailprice") / 1000).alias("cost_in"), (F.col("p_retailprice") * (size % 5 + 2) / 1000).alias("cost_out"),
        )

    @cached_property
    def sub(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"), F.concat(F.lit("p"), F.col("c_custkey") % 4 + 1).alias("plan_id"), F.col("c_mktsegment").alias("segment"),
            F.floor("c_acctbal").cast("long").alias("balance"), (F.col("c_custkey") % 3 != 0).alias("active"),
        )


class BatchViews(Views):
    """The views of the event log over one batch of it."""

    def __init__(self, spark: SparkSession, events: DataFrame):
        super().__init__(spark, "")
        self._events = events

    def table(self, name: str) -> DataFrame:
        if name != "events":
            raise KeyError(name)
        return self._events
