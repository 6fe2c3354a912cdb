"""Structured Streaming jobs over the event log, which arrives in parts; each run goes to the end of what is there (availableNow)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from brightmill.operators.state import Breaker
from brightmill.session import shared_folder
from brightmill.streaming.machines import from_json, machine_step, machine_store, to_json

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return shared_folder(spark, f"{name}-{uuid.uuid4().hex}")


def event_slices(spark: SparkSession, folder: str, n: int = 4) -> list[DataFrame]:
    """The event log in n parts by event time, about as long as each other; rows without a time come first."""
    events = spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.select(F.percentile_approx(at, [i / n for i in range(1, n)], 1000)).first()[0] or []
    part = sum((F.coalesce((at >= b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))
    return [events.where(part == i) for i in range(len(bounds) + 1)]


def run_parts(spark: SparkSession, parts: list[DataFrame], schema: str, name: str, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Lets a log arrive in parts. After each the stream runs to the end of what is there, so all but the first run go on from
    the checkpoint of the one before."""
    inbox, log = scratch(spark, f"{name}-inbox"), scratch(spark, f"{name}-log")
    for part in parts:
        part.write.mode("append").parquet(inbox)
        start(spark.readStream.schema(schema).parquet(inbox)).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def run_in_slices(spark: SparkSession, folder: str, name: str, start: Callable[[DataFrame], DataStreamWriter], n: int = 4) -> None:
    """Lets the event log arrive in n parts."""
    run_parts(spark, event_slices(spark, folder, n), EVENTS, name, lambda stream: start(stream.withColumn("ts", F.col("ts").cast("timestamp"))))  # watermarks need an instant


def run_complete(spark: SparkSession, folder: str, build: Callable[[DataFrame], DataFrame], name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over the event log, which arrives in parts, and returns its last result: in complete mode the state after
    the last batch, in append mode all rows. A batch that is repeated replaces what it wrote before."""
    out, schemas = scratch(spark, name), []

    def start(events: DataFrame) -> DataStreamWriter:
        stream = build(events)
        schemas.append(stream.schema)

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/last" if mode == "complete" else f"{out}/{number}")

        return stream.writeStream.outputMode(mode).foreachBatch(keep)

    run_in_slices(spark, folder, name, start)
    return spark.read.schema(schemas[-1]).option("recursiveFileLookup", "true").parquet(out)


def hourly_rollup(events: DataFrame) -> DataFrame:
    """Successes and failures by type and hour, for events at most two hours late."""
    failed = F.col("event_type").isin("error", "signup")
    hours = events.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour"), "event_type")
    return hours.agg(F.count_if(~failed).alias("successes"), F.count_if(failed).alias("failures")).select(
        F.col("event_type").alias("method"), F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "successes", "failures"
    )


def metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("counter"), F.round(F.sum("value"), 6).alias("total"))


def first_deliveries(events: DataFrame) -> DataFrame:
    """Each (user, key) once, if repeated within 40 days."""
    keyed = events.select("ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return keyed.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["user_id", "k"]).select("user_id", "k")


def run_machine(spark: SparkSession, folder: str, name: str, keys: list[str], rows: Callable[[DataFrame], DataFrame], new: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """A state machine over the event log, which arrives in parts; all its results."""
    store = machine_store(spark, scratch(spark, name), keys)

    def apply(batch: DataFrame, number: int) -> None:
        machine_step(store, number, rows(batch), keys, new, step, schema)

    run_in_slices(spark, folder, name, lambda events: events.writeStream.foreachBatch(apply))
    return store.read("entries")


class BreakerProcessor(StatefulProcessor):
    """The circuit breaker with timers: it half-opens a minute of event time after the last failure, with or without an event.

    A key's rows of one micro-batch come in chunks, which are sorted one by one: the stream brings a key's chunks in order."""

    SCHEMA = "user_id long, event_id long, ms long, state string, streak int, by_timer boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "machine string")

    def _load(self) -> Breaker:
        return from_json(Breaker, self.machine.get()[0]) if self.machine.exists() else Breaker()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        breaker = self._load()
        for chunk in rows:
            chunk = chunk.sort_values(["ms", "event_id"])
            found = [breaker.step(int(ms), bool(failed), bool(limited)) for ms, failed, limited in zip(chunk["ms"], chunk["failed"], chunk["rate_limited"], strict=True)]
            yield pd.DataFrame({"user_id": key[0], "event_id": chunk["event_id"].to_numpy(), "ms": chunk["ms"].to_numpy(), "state": [f["state"] for f in found], "streak": [f["streak"] for f in found], "by_timer": False})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if breaker.state == "open":
            self.handle.registerTimer(breaker.last_failure + Breaker.WAIT_MS)
        self.machine.update((to_json(breaker),))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        breaker, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if breaker.read(now):
            self.machine.update((to_json(breaker),))
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [-1], "ms": [now], "state": [breaker.state], "streak": [breaker.streak], "by_timer": [True]})

    def close(self) -> None:
        pass


def breaker_with_timers(events: DataFrame) -> DataFrame:
    """A row for each event, and one (event_id -1) each time a circuit half-opens by itself."""
    failed = F.col("event_type").isin("error", "signup")
    rows = events.withWatermark("ts", "1 second").select("user_id", "event_id", "ts", F.unix_millis("ts").alias("ms"), failed.alias("failed"), (failed & (F.col("value") > 400)).alias("rate_limited"))
    return rows.groupBy("user_id").transformWithStateInPandas(BreakerProcessor(), BreakerProcessor.SCHEMA, "append", "eventtime")


def with_state_store(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Runs a job with the state store that state processors need, and restores the setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(name, before)
