"""What running streams report, as a stored table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from brightmill.operators.stored import Store

PROGRESS = "query_id string, run_id string, batch long, input_rows long, duration_ms long, late_rows long"


class ProgressObserver(StreamingQueryListener):
    """Appends a row for each micro-batch of the session's streams to the table `progress`; one that is reported twice counts once."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.store = spark, Store(spark, folder, {"progress": F.col("query_id")})
        self._ended, self._change = set(), threading.Condition()

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        row = (str(p.id), str(p.runId), p.batchId, p.numInputRows, p.batchDuration, late)
        self.store.commit(f"query-{p.id}", p.batchId, append={"progress": self.spark.createDataFrame([row], PROGRESS)})

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait(self, runs: int, seconds: float = 60) -> None:
        """Reports come after the batches: waits until so many runs have ended, and so all before was reported."""
        with self._change:
            if not self._change.wait_for(lambda: len(self._ended) >= runs, seconds):
                raise TimeoutError(f"{len(self._ended)} of {runs} runs reported")

    def rows(self) -> DataFrame:
        return self.store.read("progress")
