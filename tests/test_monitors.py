"""Monitors over streams: bounded states, batches that come twice, lines cut inside characters; hooks, tools and prompt files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brightmill.operators.hooks import Hook, Tool, allowed, register, run_hooks
from brightmill.operators.state import LineBuffer, Watch
from brightmill.operators.stored import Store
from brightmill.sources.prompts import load_prompts
from brightmill.streaming.machines import from_json, to_json
from brightmill.streaming.monitors import keep_latest, ring_step, sample_step


def test_lines_do_not_depend_on_the_cuts():
    body = "data: é\U0001f600\n\n".encode() + b"data: \xff\n" + "tail ü".encode()
    for size in (1, 2, 3, 7, 100):
        buffer, lines = LineBuffer(), []
        for i in range(0, len(body), size):
            lines += buffer.step(body[i : i + size])["lines"]
            buffer = from_json(LineBuffer, to_json(buffer))  # as between batches
        assert lines == ["data: é\U0001f600", "", "data: �"] and bytes.fromhex(buffer.rest).decode() == "tail ü"
    assert LineBuffer().step(None) == {"lines": []} and LineBuffer().step(b"") == {"lines": []}


def test_watch_keeps_three_actions_and_finds_each_alert():
    watch = Watch()
    assert [watch.step(1, a, False, 1.0)["alerts"] for a in ("x", "x", "x", "x", "y", None, None, None)] == [[], [], ["infinite_loop"], ["infinite_loop"], [], [], [], []]
    watch = from_json(Watch, to_json(watch))
    assert watch.step(2, "z", True, None)["alerts"] == []  # one of two
    assert watch.step(3, "z", True, 500.0)["alerts"] == ["provider_cascade", "session_runaway"]
    assert watch.sessions[1] == [[None] * 3, False]


@pytest.fixture
def alerts(spark):
    return lambda *ids: spark.createDataFrame([(i, i % 3, [f"a{i}"] * (i % 2 + 1)) for i in ids], "event_id long, k long, alerts array<string>")


def test_ring_takes_each_row_once_whatever_step_is_repeated(spark, tmp_path, alerts):
    log, ring = Store(spark, str(tmp_path / "log"), {"entries": F.col("k")}), Store(spark, str(tmp_path / "ring"), {"ring": F.lit("last")})
    step = lambda: ring_step(ring, log, "entries", 5, "explode(alerts) AS alert", ["event_id", "alert"])
    log.commit("s", 0, append={"entries": alerts(1, 2)})
    log.commit("s", 1, append={"entries": alerts(3)})  # stopped before the ring had the first
    assert step() and not step()
    assert sorted(r.event_id for r in ring.read("ring").collect()) == [1, 1, 2, 3, 3]
    log.commit("s", 2, append={"entries": alerts(4, 0)})
    assert step() and sorted(r.event_id for r in ring.read("ring").collect()) == [1, 2, 3, 3, 4]
    assert log.added("entries", log.manifest(2)).count() == 2 and log.added("entries", log.manifest()).count() == 0


def test_samples_equal_a_list_that_is_trimmed(spark, tmp_path):
    rng, cap, keep = random.Random(1), 7, 3
    store, expected = Store(spark, str(tmp_path), {"samples": F.lit(0), "counts": F.lit(0)}), {}
    number = 0
    for size in (0, 3, 20, 1, 5):
        rows = [(rng.choice("aab"), number * 100 + i) for i in range(size)]
        for key, value in rows:
            own = expected.setdefault(key, [])
            own.append(value)
            if len(own) > cap:
                del own[:-keep]
        df = spark.createDataFrame(rows, "key string, value long")
        assert sample_step(store, number, df, ["key"], ["value"], cap, keep)
        assert not sample_step(store, number, df, ["key"], ["value"], cap, keep)
        number += 1
    got = {}
    for r in store.read("samples").orderBy("value").collect():
        got.setdefault(r.key, []).append(r.value)
    assert got == expected


def test_updates_change_only_their_keys_and_count_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": F.col("k") % 2})
    rows = lambda *v: spark.createDataFrame(list(v), "k long, n long")
    assert keep_latest(store, 0, "t", rows((1, 1), (2, 1)), ["k"])
    assert keep_latest(store, 1, "t", rows((1, 5), (3, 1)), ["k"]) and not keep_latest(store, 1, "t", rows((1, 9)), ["k"])
    assert sorted(map(tuple, store.read("t").collect())) == [(1, 5), (2, 1), (3, 1)]


def test_hooks_run_by_priority_and_a_refused_one_is_left_out(spark):
    add = lambda x: lambda df: df.withColumn("s", F.concat("s", F.lit(x)))
    hooks = [Hook("c", add("c")), Hook("bad", lambda df: df.select("absent"), 0), Hook("d", add("d")), Hook("a", add("a"), 1), Hook("z", add("z"), 101)]
    assert run_hooks(spark.sql("SELECT '' AS s"), hooks).first().s == "acdz"
    assert run_hooks(spark.sql("SELECT 1 AS s"), []).first().s == 1
    with pytest.raises(ZeroDivisionError):  # an error of the hook's own code isn't hidden
        run_hooks(spark.range(1), [Hook("e", lambda df: df.limit(1 // 0))])


def test_tools_by_plan_and_capabilities(spark):
    tools = register([Tool("a"), Tool("b", "pro"), Tool("c", "business", ("x", "y")), Tool("off", enabled=False), Tool("f", factory=True), Tool("a", None, ("x",))])
    rows = spark.createDataFrame([(0, "free", []), (1, "pro", ["x"]), (2, "business", ["y", "x"]), (3, "unknown", None), (4, None, ["x"])], "i long, plan string, has array<string>")
    got = rows.select("i", allowed(tools, F.col("plan"), F.col("has")).alias("t"), allowed(tools, F.col("plan"), F.col("has"), factory=True).alias("f")).orderBy("i").collect()
    assert [r.t for r in got] == [[], ["a", "b"], ["a", "b", "c"], [], ["a"]] and all(r.f == ["f"] for r in got)
    assert rows.select(allowed({}, F.col("plan"), F.col("has")).alias("t")).first().t == []


def test_prompts_come_from_the_first_folder_that_has_them(spark, tmp_path):
    for folder, files in (("one", {"p.md": "first\nline", "other.txt": "no"}), ("two", {"p.md": "second", "q.md": "", "r.md": "r\r\nr"})):
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / name).write_bytes(text.encode())
    wanted = spark.createDataFrame([("p",), ("p",), ("q",), ("r",), ("other",), (None,)], "name string")
    got = load_prompts(wanted, [str(tmp_path / d) for d in ("absent", "one", "two")]).collect()
    assert sorted((r.name or "", r.text) for r in got) == [("", ""), ("other", ""), ("p", "first\nline"), ("p", "first\nline"), ("q", ""), ("r", "r\r\nr")]
    assert load_prompts(wanted, [str(tmp_path / "absent")]).where("text <> ''").count() == 0
