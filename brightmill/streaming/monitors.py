"""Monitors over streams. What each keeps has a fixed bound a key, and a batch that is repeated counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brightmill.functions import numeric as N
from brightmill.operators.aggregates import top
from brightmill.operators.state import LineBuffer, Watch
from brightmill.operators.stored import Store, bucket
from brightmill.operators.windows import kept_of
from brightmill.streaming.jobs import run_in_slices, run_parts, scratch
from brightmill.streaming.machines import machine_step, machine_store

CHUNKS = "conv_id long, ms long, event_id long, chunk binary"
ALERTS = "provider long, event_id long, ms long, alerts array<string>"


def lines_of_chunks(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """conv_id, line: the finished lines of byte streams whose chunks (CHUNKS, in order of ms and event_id) arrive in parts. Between
    batches only each stream's unfinished line is kept; one that no line end follows is dropped, as at the end of a connection."""
    store = machine_store(spark, scratch(spark, "lines"), ["conv_id"])

    def apply(batch: DataFrame, number: int) -> None:
        machine_step(store, number, batch, ["conv_id"], LineBuffer, lambda m, r: m.step(r["chunk"]), "conv_id long, lines array<string>")

    run_parts(spark, parts, CHUNKS, "chunks", lambda stream: stream.writeStream.foreachBatch(apply))
    return store.read("entries").select("conv_id", F.explode("lines").alias("line"))


def ring_step(ring: Store, log: Store, table: str, size: int, rows: str, order: list[str]) -> bool:
    """Takes into a ring of the last `size` rows (by `order`, which ends in a unique key) what another store's table has had
    since the ring was last changed. The ring's number is the version of that store, so a stop between the two writes loses nothing."""
    now, own = log.manifest(), ring.manifest()
    if own["writers"].get("ring", 0) >= now["version"]:
        return False
    newest = [F.desc(c) for c in order]
    found = top(log.added(table, log.manifest(own["writers"].get("ring", 0)), now).selectExpr(rows, *[c for c in order if c not in rows]), size, *newest)
    if "ring" in own["tables"]:
        found = top(ring.read("ring", base=own).unionByName(found), size, *newest)
    return ring.commit("ring", now["version"], replace={"ring": found}, drop={"ring": list(own["tables"].get("ring", {"parts": {}})["parts"])}, base=own)


def watch(spark: SparkSession, folder: str, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """All alerts of the event stream (event_id, ms, alert), and the ring of the last ones. Users stand for sessions, five
    neighbours for a provider's."""
    log = machine_store(spark, scratch(spark, "alerts"), ["provider"])
    ring = Store(spark, scratch(spark, "alert-ring"), {"ring": F.lit("last")})

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.select(
            F.expr("user_id div 5").alias("provider"), "user_id", F.unix_millis("ts").alias("ms"), "event_id", F.col("event_type").alias("action"),
            F.col("event_type").isin("error", "signup").alias("failed"), F.col("value").alias("duration"),
        )
        machine_step(log, number, rows, ["provider"], Watch, lambda m, r: m.step(r["user_id"], r["action"], r["failed"], r["duration"]), ALERTS)
        ring_step(ring, log, "entries", size, "explode(alerts) AS alert", ["ms", "event_id", "alert"])

    run_in_slices(spark, folder, "watch", lambda events: events.writeStream.foreachBatch(apply))
    return log.read("entries").select("event_id", "ms", F.explode("alerts").alias("alert")), ring.read("ring")


def keep_latest(store: Store, number: int, table: str, batch: DataFrame, keys: list[str]) -> bool:
    """Upserts the rows that a batch has changed, as a stream in update mode gives them. They are written aside first, since
    reading a batch takes its aggregation's state on each time."""
    base = store.manifest()
    if base["writers"].get("stream", -1) >= number:
        return False
    if table not in base["tables"]:
        return store.commit("stream", number, append={table: batch}, base=base)
    aside = f"{store.folder}/incoming/{table}"
    batch.write.mode("overwrite").parquet(aside)
    rows = store.spark.read.schema(batch.schema).parquet(aside)
    return store.upsert("stream", number, table, rows, keys, [c for c in batch.columns if c not in keys], [])


def run_updates(spark: SparkSession, folder: str, build, name: str, keys: list[str]) -> DataFrame:  # noqa: ANN001
    """A stream over the event log in update mode: each batch changes only the rows of the keys that it had; the table after the last one."""
    store = Store(spark, scratch(spark, name), {name: bucket(*keys)})
    run_in_slices(spark, folder, name, lambda events: build(events).writeStream.outputMode("update").foreachBatch(lambda batch, number: keep_latest(store, number, name, batch, keys)))
    return store.read(name)


def metric_values(buckets: tuple[float, ...]):  # noqa: ANN201
    """Counter, gauge (the last value), sum and cumulative buckets by label."""

    def build(events: DataFrame) -> DataFrame:
        below = [F.count_if(F.col("value") <= b).alias(f"le_{b:.0f}") for b in buckets]
        return events.groupBy("event_type").agg(F.count("*").alias("counter"), F.max_by("value", F.struct("ts", "event_id")).alias("gauge"), F.sum("value").alias("total"), *below)

    return build


def sample_step(store: Store, number: int, rows: DataFrame, keys: list[str], order: list[str], cap: int, keep: int) -> bool:
    """Takes a batch's observations into each key's samples, of which only the last `keep` stay whenever there are more than `cap`.

    How many stay follows from how many there have been, so a key needs its count and at most `cap` samples. A batch
    sends at most `cap` rows of a key from a task (a group limit); one that arrives later counts as later."""
    base = store.manifest()
    if base["writers"].get("stream", -1) >= number:
        return False
    rows = rows.withColumn("batch", F.lit(number).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in ("batch", *order)]))
    last, counts = rows.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank"), rows.groupBy(*keys).agg(F.count("*").alias("n"))
    if base["tables"]:
        last = store.read("samples", base=base).unionByName(last)
        counts = store.read("counts", base=base).unionByName(counts).groupBy(*keys).agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        ranked = last.withColumn("rank", rank).join(counts, keys)
        left = ranked.where(F.col("rank") <= kept_of(F.col("n"), cap, keep)).drop("rank", "n")
        drop = {t: list(x["parts"]) for t, x in base["tables"].items()}
        return store.commit("stream", number, replace={"samples": left, "counts": counts}, drop=drop, base=base)
    finally:
        counts.unpersist()


def run_samples(spark: SparkSession, folder: str, cap: int, keep: int) -> DataFrame:
    """event_type, value, ms, event_id: the samples of each event type after the last batch."""
    store = Store(spark, scratch(spark, "samples"), {"samples": bucket("event_type"), "counts": bucket("event_type")})

    def apply(batch: DataFrame, number: int) -> None:
        sample_step(store, number, batch.select("event_type", "value", F.unix_millis("ts").alias("ms"), "event_id"), ["event_type"], ["ms", "event_id"], cap, keep)

    run_in_slices(spark, folder, "samples", lambda events: events.writeStream.foreachBatch(apply))
    return store.read("samples")


def spend_levels(balances: DataFrame):  # noqa: ANN201
    """For each user and day the spend of that day against the mean of the seven before, with the level of alarm. Windows of eight days
    begin every day; rows without a user or a time, and such as come more than a day late, are in none. `balances` has user_id, balance."""

    def build(events: DataFrame) -> DataFrame:
        spends = events.where("user_id is not null").withWatermark("ts", "1 day").select("user_id", "ts", F.floor(F.col("value") * 10).cast("long").alias("spent"), F.window("ts", "8 days", "1 day").alias("days"))
        age = F.date_diff(F.col("days.end").cast("date"), F.col("ts").cast("date")) - 1
        of = lambda when: F.coalesce(F.sum(F.when(when, F.col("spent"))), F.lit(0))
        seen = F.bit_count(F.coalesce(F.bit_or(F.when(age > 0, F.expr("shiftleft(1, datediff(cast(days.end as date), cast(ts as date)) - 1)"))), F.lit(0)))
        sums = spends.groupBy("user_id", "days").agg(of(age == 0).alias("today"), (of(age > 0) / 7.0).alias("average"), seen.alias("seen"))
        rows = sums.join(balances, "user_id", "left").withColumn("days_left", N.days_remaining(F.coalesce("balance", F.lit(0)), F.col("average"), F.lit(100.0)))
        level = N.anomaly_level(F.col("today"), F.col("seen"), F.col("average"), F.col("days_left"))
        return rows.select("user_id", F.date_format(F.col("days.end") - F.expr("interval 1 day"), "yyyy-MM-dd").alias("day"), "today", F.round("average", 6).alias("average"), "days_left", level.alias("level"))

    return build
