"""Event-driven state machines: one step function each, replayed in event order.

`replay` keeps one key's state at a time: rows are partitioned by key, sorted, and stepped through as a stream
of batches, so a key of any length needs no more memory than its state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame


def replay(df: DataFrame, keys: list[str], order: list[str], new_state: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """One output row for each row, from `step(state, row)`."""
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != current:
                    current, state = key, new_state()
                result = {**row, **step(state, row)}
                for n in names:
                    out[n].append(result[n])
            yield pa.RecordBatch.from_pydict(out, arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return sorted_rows.mapInArrow(run, schema)


@dataclass
class Limiter:
    """Sliding-window limiter: only accepted requests occupy the window."""

    limit: int
    window_ms: int = 60_000
    accepted: deque = field(default_factory=deque)

    def step(self, now: int) -> dict:
        while self.accepted and self.accepted[0] <= now - self.window_ms:
            self.accepted.popleft()
        if self.limit < 0:
            return {"allowed": True, "used": 0, "reset_s": 0}
        allowed = len(self.accepted) < self.limit
        if allowed:
            self.accepted.append(now)
        else:  # a rejected request takes its own entry back, and with it all of the same millisecond
            while self.accepted and self.accepted[-1] == now:
                self.accepted.pop()
        oldest = self.accepted[0] if self.accepted else now
        return {"allowed": allowed, "used": len(self.accepted), "reset_s": max(-(-(oldest + self.window_ms - now) // 1000), 1)}


@dataclass
class Breaker:
    """Circuit breaker with its health: opens at 5 failures in a row, half-opens 60 s after the last failure when
    it is next read, closes at 2 successes; failures by rate limit don't count in the row."""

    WAIT_MS: ClassVar[int] = 60_000

    state: str = "closed"
    streak: int = 0
    successes: int = 0
    total: int = 0
    good: int = 0
    last_failure: int = 0

    def read(self, now: int) -> bool:
        """Half-opens an open circuit whose wait is over; whether it did."""
        due = self.state == "open" and now - self.last_failure >= self.WAIT_MS
        if due:
            self.state, self.successes = "half_open", 0
        return due

    def step(self, now: int, failed: bool, rate_limited: bool) -> dict:
        self.read(now)
        self.total += 1
        if failed:
            self.last_failure = now
            if not rate_limited:
                self.streak += 1
            if self.state == "half_open" or (self.state == "closed" and self.streak >= 5):
                self.state = "open"
        else:
            self.good += 1
            self.streak = 0
            if self.state == "half_open":
                self.successes += 1
                if self.successes >= 2:
                    self.state = "closed"
        rate = 100.0 * self.good / self.total
        return {"state": self.state, "streak": self.streak, "rate": rate, "healthy": rate >= 50 if self.total >= 10 else self.state != "open"}


@dataclass
class KeyRing:
    """Rotation of a provider's keys: a failing key goes behind the last one that isn't archived (or behind 999, if
    there is none with a priority above 0), a success brings it back; a key is archived at `most` failures. Rate limits
    count as neither failures nor a streak. A time-out needs no wait; else the wait is what the provider asks for, after a
    rate limit the key's own reset or 60 s, and after other failures doubles with the streak."""

    most: int = 25
    keys: dict[int, list] = field(default_factory=dict)  # key -> [priority, original, streak, failures, archived]

    def step(self, key: int, failed: bool, rate_limited: bool, timed_out: bool = False, retry_after: int = 0, reset: int = 0) -> dict:
        own = self.keys.setdefault(key, [key, key, 0, 0, False])
        wait = 0
        if failed:
            own[0] = (max((k[0] for k in self.keys.values() if not k[4]), default=0) or 999) + 1
            own[2] += not rate_limited
            own[3] += not rate_limited
            own[4] = own[4] or own[3] >= self.most
            if not timed_out:
                wait = retry_after if retry_after > 0 else (reset or 60_000) if rate_limited else min(30_000 * 2 ** min(own[2], 10), 300_000)
        else:
            own[0], own[2] = own[1], 0
        return {"priority": own[0], "cooldown_ms": wait, "archived": own[4]}


@dataclass
class Ledger:
    """Credits of a user: free ones are spent first and refilled after a day, a surplus goes back to the free ones."""

    free: int = 100
    paid: int = 0
    refill: int = 100
    refreshed: int | None = None
    held: int = 0

    def step(self, now: int, action: str, amount: int) -> dict:
        if self.refreshed is None or now - self.refreshed >= 86_400_000:
            self.free, self.refreshed = self.refill, now
        accepted = True
        if action == "deposit":
            self.paid += amount
        elif action == "reserve":
            accepted = self.free + self.paid >= amount
            if accepted:
                self._charge(amount)
                self.held = amount
        elif action == "finalize":
            extra, self.held = amount - self.held, 0
            if extra < 0:
                self.free -= extra
            elif self.free + self.paid >= extra:
                self._charge(extra)
            else:
                self.free = self.paid = 0
        return {"free": self.free, "paid": self.paid, "accepted": accepted}

    def _charge(self, amount: int) -> None:
        from_free = min(self.free, amount)
        self.free -= from_free
        self.paid -= amount - from_free


@dataclass
class LineBuffer:
    """Lines of a byte stream that is cut anywhere: the last, unfinished line waits for the next chunk (as hex digits)."""

    rest: str = ""

    def step(self, chunk: bytes | None) -> dict:
        *lines, rest = (bytes.fromhex(self.rest) + (chunk or b"")).split(b"\n")
        self.rest = rest.hex()
        return {"lines": [line.decode("utf-8", "replace") for line in lines]}


@dataclass
class Watch:
    """What is watched of a provider's sessions: each one's last three actions, and whether its last call failed.

    Alerts: an action that is the third in a row of its session (null actions never are), more than half of the known sessions failed,
    a call that ran longer than expected."""

    most: float = 450
    sessions: dict[int, list] = field(default_factory=dict)  # session -> [actions, failed]

    def step(self, session: int, action: str | None, failed: bool, duration: float | None) -> dict:
        own = self.sessions.setdefault(session, [[], False])
        own[0], own[1] = [*own[0], action][-3:], bool(failed)
        loop = action is not None and own[0] == [action] * 3
        cascade = 2 * sum(s[1] for s in self.sessions.values()) > len(self.sessions)
        runaway = duration is not None and duration > self.most
        return {"alerts": [name for name, on in (("infinite_loop", loop), ("provider_cascade", cascade), ("session_runaway", runaway)) if on]}
