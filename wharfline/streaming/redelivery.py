"""Intake with redelivery as keyed streaming state.

The state of a content (partner, SHA-256) is what became of it and, while it waits for another try, the content itself and the tries made. A file whose content is
new is handled at once; if that fails, a timer brings it back, twice at most, then it is given up. Files whose content is known are duplicates,
whether it was handled, waits or was given up. Each file comes out once, as DONE, DUPLICATE or ERROR; :func:`settle` then moves it to ``.done`` or ``.error`` beside it.

State is part of the stream's checkpoint: a restart in the middle of a batch handles the batch again from the state before it, so tries are neither lost nor counted twice. The handler
therefore has to stand being called again with the same file. Tries need a RocksDB state store (:func:`configure`) and a trigger that goes on, as timers fire with batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

OUTCOMES = "partner_id string, sha256 string, file_id string, outcome string, tries int, detail string"
#: Further tries of a file that fails, and the pause before each.
REDELIVERIES, PAUSE_MS = 2, 1000


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Redelivery(StatefulProcessor):
    """``handle(file_name, content)`` returns what is to be told of a file, or raises."""

    def __init__(self, handle: Callable[[str, bytes], str], redeliveries: int = REDELIVERIES, pause_ms: int = PAUSE_MS):
        self.handle, self.redeliveries, self.pause_ms = handle, redeliveries, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle
        self.known = handle.getValueState("known", "outcome string")
        self.waiting = handle.getValueState("waiting", "file_id string, file_name string, content binary, tries int")

    def _out(self, key: tuple, file_id: str, outcome: str, tries: int, detail: str | None) -> pd.DataFrame:
        return pd.DataFrame({"partner_id": [key[0]], "sha256": [key[1]], "file_id": [file_id], "outcome": [outcome], "tries": [tries], "detail": [detail]})

    def _try(self, key: tuple, file_id: str, name: str, content: bytes, tries: int, now: int) -> Iterator[pd.DataFrame]:
        try:
            said, outcome = self.handle(name, content), "DONE"
        except Exception as e:  # whatever the handler raises is a failed try
            said, outcome = f"{type(e).__name__}: {e}", "ERROR"
        if outcome == "ERROR" and tries <= self.redeliveries:
            self.known.update(("WAITING",))
            self.waiting.update((file_id, name, content, tries))
            self.store.registerTimer(now + self.pause_ms)
            return
        self.known.update((outcome,))
        self.waiting.clear()
        yield self._out(key, file_id, outcome, tries, said)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        files = pd.concat(list(rows)).sort_values(["received_at", "file_id"])
        for f in files.itertuples():
            if self.known.exists():
                yield self._out(key, f.file_id, "DUPLICATE", 0, self.known.get()[0])
            else:
                yield from self._try(key, f.file_id, f.file_name, bytes(f.content), 1, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            file_id, name, content, tries = self.waiting.get()
            yield from self._try(key, file_id, name, bytes(content), tries + 1, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def outcomes(files: DataFrame, handle: Callable[[str, bytes], str], redeliveries: int = REDELIVERIES, pause_ms: int = PAUSE_MS) -> DataFrame:
    """One row for each file of a stream (file_id, file_name, partner_id, received_at, content), once it is settled."""
    keyed = files.withColumn("sha256", F.sha2("content", 256)).select("partner_id", "sha256", "file_id", "file_name", "received_at", "content")
    return keyed.groupBy("partner_id", "sha256").transformWithStateInPandas(Redelivery(handle, redeliveries, pause_ms), OUTCOMES, "Append", "ProcessingTime")


def settle(batch: DataFrame, number: int) -> None:
    """Move the files of a batch of outcomes to ``.done`` (handled or known) or ``.error`` beside them; files that were moved before are left."""
    spark = batch.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    for r in batch.select("file_id", "outcome").toLocalIterator():  # the files of one batch
        at = path(spark._jvm.java.net.URI(r["file_id"]))
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        folder = path(at.getParent(), ".error" if r["outcome"] == "ERROR" else ".done")
        if system.exists(at):
            system.mkdirs(folder)
            system.rename(at, path(folder, at.getName()))
