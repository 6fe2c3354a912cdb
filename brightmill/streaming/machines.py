"""State machines over the event stream, one step a micro-batch, exactly once.

Each micro-batch is replayed from the stored state of its keys, sorted and spilled by Spark, so no key's rows are held in
memory. Its results and the new states become part of the store in one commit under the batch's number: a batch that is
repeated after a crash, before or after that commit, counts once. Events of a batch are taken in their own order; one that
arrives in a later batch than younger events of its key is taken when it arrives.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightmill.operators.merge import upsert
from brightmill.operators.state import KeyRing, Limiter, Watch
from brightmill.operators.stored import Store, bucket


def to_json(machine: object) -> str:
    fields = asdict(machine)
    return json.dumps({k: list(v) if isinstance(v, deque) else v for k, v in fields.items()})


def from_json(kind: type, text: str) -> object:
    fields = json.loads(text)
    if kind is Limiter:
        fields["accepted"] = deque(fields["accepted"])
    if kind is KeyRing:
        fields["keys"] = {int(k): v for k, v in fields["keys"].items()}
    if kind is Watch:
        fields["sessions"] = {int(k): v for k, v in fields["sessions"].items()}
    return kind(**fields)


def replay_from(rows: DataFrame, keys: list[str], order: list[str], new: Callable[[], object], step: Callable[[object, dict], dict], schema: str) -> DataFrame:
    """One output row for each row, from `step(machine, row)`, beginning with the machine in the row's `machine` (null: a new one);
    `machine` is that after the key's last row, and null in its other rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    whole = f"{schema}, machine string"
    arrow = to_arrow_schema(_parse_datatype_string(whole))
    names, kind = arrow.names, type(new())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine, last = None, None, None
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if machine is None or key != current:
                    if last is not None:
                        last["machine"] = to_json(machine)
                    current, machine = key, from_json(kind, row["machine"]) if row["machine"] else new()
                last = {**row, **step(machine, row), "machine": None}
                out.append(last)
            if len(out) > 1:  # the last row waits, as its key may end with it
                yield pa.RecordBatch.from_pydict({n: [r[n] for r in out[:-1]] for n in names}, arrow)
                out = out[-1:]
        if last is not None:
            last["machine"] = to_json(machine)
            yield pa.RecordBatch.from_pydict({n: [r[n] for r in out] for n in names}, arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, whole)


def machine_store(spark, folder: str, keys: list[str]) -> Store:  # noqa: ANN001
    layout = bucket(*keys)
    return Store(spark, folder, {"states": layout, "entries": layout})


def machine_step(store: Store, number: int, rows: DataFrame, keys: list[str], new: Callable[[], object], step: Callable[[object, dict], dict], schema: str, writer: str = "stream") -> bool:
    """Takes the keys of `rows` (keys, ms, event_id and what `step` reads) on, and commits results and states as step `number`."""
    base = store.manifest()
    if base["writers"].get(writer, -1) >= number:
        return False
    rows = rows.persist()
    try:
        parts = store.touched("states", rows)
        if "states" in base["tables"]:
            old = store.read("states", parts, base)
        else:
            old = rows.select(*keys, F.lit(None).cast("string").alias("machine")).limit(0)
        entries = replay_from(rows.join(old, keys, "left"), keys, ["ms", "event_id"], new, step, schema).persist()
        try:
            states = upsert(old, entries.where("machine is not null").select(*keys, "machine"), keys, ["machine"], []).select(*keys, "machine")
            return store.commit(writer, number, append={"entries": entries.drop("machine")}, replace={"states": states}, drop={"states": parts}, base=base)
        finally:
            entries.unpersist()
    finally:
        rows.unpersist()
