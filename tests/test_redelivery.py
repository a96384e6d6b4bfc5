"""Files that fail: tried again twice, each told once, across a restart."""

import time
from pathlib import Path

import pandas as pd

from wharfline.streaming import intake, redelivery


def test_files_are_tried_three_times(spark, tmp_path):
    inbox, tally = tmp_path / "in" / "acme", tmp_path / "tally"
    inbox.mkdir(parents=True)
    tally.mkdir()
    (inbox / "good.csv").write_text("a")
    (inbox / "same.csv").write_text("a")
    (inbox / "late.csv").write_text("late")  # fails until something else is there
    (inbox / "never.csv").write_text("never")
    other = str(tally / "there")

    def handle(name, content):
        if content == b"never" or (content == b"late" and not Path(other).exists()):
            raise ValueError("not yet")
        return f"{len(content)} bytes"

    seen = {}  # a batch that is stopped in the middle is told again

    def each(batch, number):
        for r in batch.collect():
            seen.setdefault(r["file_id"].rpartition("/")[2], set()).add((r["outcome"], r["tries"], r["detail"]))
        redelivery.settle(batch, number)

    def run(until):
        files = intake.inbox(spark, str(tmp_path / "in"))
        q = redelivery.outcomes(files, handle, pause_ms=200).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        end = time.time() + 90
        while time.time() < end and not until() and q.exception() is None:
            time.sleep(0.2)
        q.stop()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    redelivery.configure(spark)
    try:
        run(lambda: len(seen) >= 2)  # stopped in the middle of a batch, while two files wait
        Path(other).write_text("")
        run(lambda: (inbox / ".error" / "never.csv").exists() and (inbox / ".done" / "late.csv").exists())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {o for n in ("good.csv", "same.csv") for o in seen[n]} == {("DONE", 1, "1 bytes"), ("DUPLICATE", 0, "DONE")} and len(seen["good.csv"]) == len(seen["same.csv"]) == 1
    assert seen["never.csv"] == {("ERROR", 3, "ValueError: not yet")}
    assert [(o, d) for o, t, d in seen["late.csv"] if 1 <= t <= 3] == [("DONE", "4 bytes")]
    assert {p.name for p in (inbox / ".done").iterdir()} >= {"good.csv", "same.csv", "late.csv"} and (inbox / ".error" / "never.csv").exists() and not (inbox / "late.csv").exists()


def test_a_file_that_fails_twice_and_then_works():
    """The processor by itself, with its store and its timers in memory."""
    calls = []

    def handle(name, content):
        calls.append(name)
        if len(calls) < 3:
            raise OSError("down")
        return "done"

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Store:
        def __init__(self):
            self.timers = []

        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def getCurrentProcessingTimeInMs(self):
            return 5

    store, key = Store(), ("P", "s")
    p = redelivery.Redelivery(handle, pause_ms=100)
    p.init(store)
    file = pd.DataFrame({"file_id": ["f"], "file_name": ["n"], "received_at": [1], "content": [b"c"]})
    rows = lambda frames: [tuple(r) for f in frames for r in f[["file_id", "outcome", "tries", "detail"]].itertuples(index=False)]
    assert rows(p.handleInputRows(key, iter([file]), Now())) == [] and store.timers == [105]
    assert rows(p.handleInputRows(key, iter([file.assign(file_id="g")]), Now())) == [("g", "DUPLICATE", 0, "WAITING")]
    assert rows(p.handleExpiredTimer(key, Now(), None)) == [] and len(store.timers) == 2
    assert rows(p.handleExpiredTimer(key, Now(), None)) == [("f", "DONE", 3, "done")]
    assert rows(p.handleExpiredTimer(key, Now(), None)) == [] and len(calls) == 3
    assert rows(p.handleInputRows(key, iter([file.assign(file_id="h")]), Now())) == [("h", "DUPLICATE", 0, "DONE")]
