"""State machines: golden transitions, replay against a plain loop, and stream against batch."""

from __future__ import annotations

import random
from collections import defaultdict

from brightmill.operators.state import Breaker, KeyRing, Ledger, Limiter
from brightmill.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_breaker_thresholds():
    b = Breaker()
    states = [b.step(t, True, False)["state"] for t in range(5)]
    assert states == ["closed"] * 4 + ["open"]
    assert b.step(30_000, False, False)["state"] == "open"
    assert b.step(61_000, False, False)["state"] == "half_open"
    assert b.step(61_001, False, False)["state"] == "closed"


def test_half_open_failure_opens_again():
    b = Breaker()
    for t in range(5):
        b.step(t, True, False)
    b.step(61_000, False, False)
    assert b.step(61_001, True, True)["state"] == "open"


def test_rate_limits_dont_open():
    b = Breaker()
    assert {b.step(t, True, True)["state"] for t in range(20)} == {"closed"}


def test_limiter_against_a_list():
    rng = random.Random(1)
    now, kept, machine = 0, [], Limiter(3, 100)
    for _ in range(500):
        now += rng.choice([0, 1, 20, 60])
        kept = [t for t in kept if t > now - 100]
        allowed = len(kept) < 3
        kept = kept + [now] if allowed else [t for t in kept if t != now]
        assert machine.step(now)["allowed"] == allowed


def test_key_ring_and_ledger():
    ring = KeyRing(most=2)
    assert ring.step(1, True, False) == {"priority": 2, "cooldown_ms": 60_000, "archived": False}
    assert ring.step(1, False, False)["priority"] == 1
    assert ring.step(1, True, False)["archived"]
    assert ring.step(2, True, True) == {"priority": 3, "cooldown_ms": 60_000, "archived": False}  # key 1 is archived: behind 2 itself
    assert ring.step(2, True, True, reset=5000)["cooldown_ms"] == 5000
    assert ring.step(2, True, True, retry_after=7, reset=5000)["cooldown_ms"] == 7
    assert ring.step(2, True, False, timed_out=True)["cooldown_ms"] == 0
    assert ring.step(2, True, False)["archived"]  # its rate limits don't count
    assert ring.step(2, True, False)["priority"] == 1000  # none is left
    ledger = Ledger(free=10, refill=10)
    assert ledger.step(0, "reserve", 8) == {"free": 2, "paid": 0, "accepted": True}
    assert ledger.step(1, "finalize", 3)["free"] == 7
    assert not ledger.step(2, "reserve", 8)["accepted"]
    assert ledger.step(3, "finalize", 50) == {"free": 0, "paid": 0, "accepted": True}


def test_limiter_stream_equals_batch_and_a_plain_loop(spark):
    queries = registry.queries()
    batch = {r.event_id: r.allowed for r in queries["t1_rate_limiter"](spark, FOLDER).collect()}
    stream = {r.event_id: r.allowed for r in queries["t1_rate_limiter_stream"](spark, FOLDER).collect()}
    assert batch == stream
    events = sorted((r.ts, r.event_id, r.user_id) for r in spark.read.parquet(f"{FOLDER}/events.parquet").collect())
    machines = defaultdict(lambda: Limiter(2, 86_400_000))
    expected = {e: machines[u].step(int(ts.timestamp() * 1000))["allowed"] for ts, e, u in events}
    assert sum(expected.values()) == sum(batch.values())


def test_links_and_search_results(spark):
    from brightmill.sources.html import links_of, search_results_of

    page = '<a href="/x#a">One</a><a href="http://a.com/x/">Two</a><a href="http://b.com/">Out</a><a href="mailto:z">M</a><a href="/">Self</a>'
    assert links_of(page, "http://a.com/") == [{"text": "One", "url": "http://a.com/x"}]
    html = '<tr><td><a class="result-link" href="/l/?uddg=http%3A%2F%2Fa.com">T</a></td></tr><tr><td class="result-snippet">S</td></tr><tr class="result-sponsored"><td><a class="result-link" href="http://ad">Ad</a></td></tr>'
    assert search_results_of(html) == [{"title": "T", "url": "http://a.com", "snippet": "S"}]
    assert links_of(None, None) == []


def test_merges(spark):
    from brightmill.operators.merge import insert_if_absent, upsert

    old, new = spark.createDataFrame([(1, "a", 1)], "k long, x string, y long"), spark.createDataFrame([(1, "b", 2), (2, "c", 3)], "k long, x string, y long")
    assert sorted(map(tuple, insert_if_absent(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "c", 3)]
    assert sorted(map(tuple, upsert(old, new, ["k"], ["x"], ["y"]).collect())) == [(1, "b", 1, "modified"), (2, "c", 3, "inserted")]
