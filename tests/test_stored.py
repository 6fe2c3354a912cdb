"""Stored tables: whole steps, repeats, failures and conflicts; machines over streams that are stopped and started again."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brightmill.operators.state import Breaker, Ledger
from brightmill.operators.stored import Conflict, Store, bucket, day, expire
from brightmill.streaming import jobs
from brightmill.streaming.machines import machine_step, machine_store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), {"a": F.col("k") % 3, "b": F.col("k") % 3})


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, x string")


def stored(store, table="a"):
    return sorted((r.k, r.x) for r in store.read(table).collect())


def test_steps_over_two_tables(spark, store):
    assert store.manifest()["version"] == 0 and store.parts("a") == []
    assert store.commit("w", 0, append={"a": rows(spark, (1, "p"), (2, "q"), (None, "n")), "b": rows(spark, (1, "z"))})
    assert store.commit("w", 1, append={"a": rows(spark, (4, "r"))}, drop={"b": ["1"]})
    assert not store.commit("w", 1, append={"a": rows(spark, (7, "again"))})
    assert not store.commit("w", 0, append={"a": rows(spark, (7, "older"))})
    assert sorted(store.read("a").collect(), key=repr) == sorted(rows(spark, (1, "p"), (2, "q"), (4, "r"), (None, "n")).collect(), key=repr)
    assert stored(store, "b") == [] and store.read("b").columns == ["k", "x"]
    assert store.commit("other", 1, replace={"a": rows(spark, (1, "new"))}, drop={"a": store.parts("a")})  # null's partition too
    assert stored(store) == [(1, "new")] and store.parts("a") == ["1"]


def test_only_wanted_partitions_are_read(spark, store):
    store.commit("w", 0, append={"a": rows(spark, *[(k, "x") for k in range(30)])})
    assert {f.split("store_part=")[1].split("/")[0] for f in store.read("a", ["2", "7"]).inputFiles()} == {"2"}
    assert store.read("a", []).count() == 0


def test_upsert_replaces_touched_partitions_only(spark, store):
    store.commit("w", 0, append={"a": rows(spark, *[(k, "old") for k in range(9)])})
    before = store.manifest()["tables"]["a"]["parts"]
    assert store.upsert("m", 0, "a", rows(spark, (1, "new"), (10, "new")), ["k"], ["x"], [])
    after = store.manifest()["tables"]["a"]["parts"]
    assert {p for p in after if after[p] != before[p]} == {"1"}
    assert stored(store) == sorted([(k, "new" if k == 1 else "old") for k in range(9)] + [(10, "new")])


def test_failed_write_leaves_the_old_version(spark, store):
    store.commit("w", 0, append={"a": rows(spark, (1, "p"))})
    broken = rows(spark, (1, "x")).withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.commit("w", 1, replace={"a": broken})
    with pytest.raises(ValueError, match="schema"):
        store.commit("w", 1, append={"a": spark.range(3).withColumnRenamed("id", "k")})
    assert stored(store) == [(1, "p")] and store.manifest()["version"] == 1
    assert store.commit("w", 1, append={"a": rows(spark, (2, "q"))})
    assert stored(store) == [(1, "p"), (2, "q")]


def test_second_writer_on_the_same_version_is_refused(spark, store):
    store.commit("w", 0, append={"a": rows(spark, (1, "p"))})
    base = store.manifest()
    assert store.commit("one", 0, append={"a": rows(spark, (2, "one"))})
    with pytest.raises(Conflict):
        store.commit("two", 0, replace={"a": store.read("a", base=base)}, base=base)
    assert stored(store) == [(1, "p"), (2, "one")]
    assert store.commit("two", 0, append={"a": rows(spark, (3, "two"))})


def test_vacuum_keeps_what_is_read(spark, store):
    store.commit("w", 0, append={"a": rows(spark, (1, "p"), (2, "q"))})
    for n in range(3):
        store.rewrite("r", n, "a", ["1"], lambda df: df.withColumn("x", F.concat("x", F.lit("+"))))
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert stored(store) == [(1, "p+++"), (2, "q")]
    assert len(store._names("data")) == 2 and len(store._names("manifests")) == 1


def test_expiry_by_day(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"log": day("ts")})
    log = spark.sql("SELECT id, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, int(id div 4)) AS ts FROM range(40)")
    store.commit("w", 0, append={"log": log})
    named = store.manifest()["tables"]["log"]["parts"]
    assert expire(store, "r", 0, "log", "2024-01-05", F.col("id") % 2 == 0)
    assert store.read("log").count() == 40 - 8
    assert expire(store, "r", 1, "log", "2024-01-05")
    left = store.manifest()["tables"]["log"]["parts"]
    assert sorted(left) == [f"2024-01-{d:02d}" for d in range(5, 11)] and all(left[p] == named[p] for p in left)


def events(spark, folder, values):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    df = spark.createDataFrame([(i, user, kind, float(value), ms) for i, (user, kind, value, ms) in enumerate(values)], "event_id long, user_id long, event_type string, value double, ms long")
    df.select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit(None).cast("string").alias("props")).select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(f"{folder}/events.parquet")


def test_ledger_survives_a_stop_on_either_side_of_a_commit(spark, tmp_path):
    """Killed before a batch's commit, and after it but before the stream notes it: each event counts once."""
    rng = random.Random(5)
    days = 86_400_000
    values = sorted(((rng.choice([1, 1, 1, 2, 3]), rng.choice(["deposit", "reserve", "finalize", "none"]), rng.randrange(60), rng.randrange(5 * days)) for _ in range(200)), key=lambda v: v[3])
    events(spark, str(tmp_path), values)
    expected, users = {}, {}
    for i, (user, kind, value, ms) in enumerate(values):
        expected[i] = users.setdefault(user, Ledger()).step(ms, kind, value)
    store, broken = machine_store(spark, str(tmp_path / "ledger"), ["user_id"]), []

    def apply(batch, number):
        if number == 1 and not broken:
            broken.append("before")
            raise RuntimeError("stopped before the commit")
        rows = batch.select("user_id", F.unix_millis("ts").alias("ms"), "event_id", F.col("event_type").alias("action"), F.col("value").cast("long").alias("amount"))
        done = machine_step(store, number, rows, ["user_id"], Ledger, lambda m, r: m.step(r["ms"], r["action"], r["amount"]), "event_id long, user_id long, free long, paid long, accepted boolean")
        if number == 2 and len(broken) == 1:
            broken.append("after")
            raise RuntimeError("stopped after the commit")
        assert done or number == 2

    inbox, log = str(tmp_path / "inbox"), str(tmp_path / "log")
    for part in jobs.event_slices(spark, str(tmp_path), 4):
        part.write.mode("append").parquet(inbox)
        for _ in range(2):
            stream = spark.readStream.schema(jobs.EVENTS).parquet(inbox).withColumn("ts", F.col("ts").cast("timestamp"))
            try:
                stream.writeStream.foreachBatch(apply).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
                break
            except Exception as error:  # noqa: BLE001
                assert "stopped" in str(error)
    assert broken == ["before", "after"] and store.manifest()["version"] == 4
    got = {r.event_id: {"free": r.free, "paid": r.paid, "accepted": r.accepted} for r in store.read("entries").collect()}
    assert got == expected
    assert store.read("states").count() == 3


def test_circuit_half_opens_without_an_event(spark, tmp_path):
    """User 1 fails five times and is heard of no more; user 2 moves the time on."""
    values = [(1, "error", 1, 1000 * i) for i in range(5)] + [(2, "view", 1, 10_000 + 20_000 * i) for i in range(12)]
    values += [(1, "view", 1, 300_000), (1, "view", 1, 301_000)]
    start = 10**9  # the watermark begins at 0, and what is not after it counts as late
    events(spark, str(tmp_path), [(u, kind, v, start + ms) for u, kind, v, ms in values])
    found = jobs.with_state_store(spark, lambda: jobs.run_complete(spark, str(tmp_path), jobs.breaker_with_timers, "timers", "append")).collect()
    own = [r for r in found if r.user_id == 1]
    assert [(r.ms - start, r.state) for r in own if r.by_timer] == [(4000 + Breaker.WAIT_MS, "half_open")]
    assert [r.state for r in sorted((r for r in own if not r.by_timer), key=lambda r: r.ms)] == ["closed"] * 4 + ["open", "half_open", "closed"]


def test_slices_are_the_whole_log(spark, tmp_path):
    events(spark, str(tmp_path), [(1, "view", i, 10**12 if i == 7 else i % 5) for i in range(40)])
    parts = [p.count() for p in jobs.event_slices(spark, str(tmp_path), 4)]
    assert sum(parts) == 40 and len(parts) >= 3


def test_bucket_layout(spark):
    assert spark.range(200).select(bucket("id", buckets=4).alias("b")).distinct().count() == 4
