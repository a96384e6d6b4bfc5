"""Delivery: claiming due records, idempotency keys, retries with backoff, a circuit breaker, open quantities."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import recount_touched

MAX_ATTEMPTS, BATCH, POSTPONE_S = 5, 50, 5


def deliverable(records: DataFrame) -> DataFrame:
    return records.where(F.col("status").isin("VALID", "WARNING"))


def claim(outbox: DataFrame, now: Column, limit: int = BATCH) -> DataFrame:
    """Due records, oldest first; a batch is a feature of the outbox, so the limit stays."""
    due = deliverable(outbox).where(F.col("next_attempt_at") <= now)
    return due.orderBy("next_attempt_at", "record_id").limit(limit)


def idempotency_key(pairs: Column) -> Column:
    """Of a delivery's ``id:business key`` pairs, in the order in which its records were claimed."""
    return F.sha2(F.array_join(pairs, ","), 256)


def backoff_seconds(attempts: Column) -> Column:
    return F.least(F.lit(60), F.pow(F.lit(2), attempts)).cast("long")


def after_failure(outbox: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Attempts up by one for the records of ``failed``; dead at MAX_ATTEMPTS, else due again after a growing pause."""
    marked = outbox.join(failed.select("record_id").distinct().withColumn("_hit", F.lit(True)), "record_id", "left")
    n = F.col("attempts") + F.when(F.col("_hit"), 1).otherwise(0)
    dead = F.col("_hit") & (n >= MAX_ATTEMPTS)
    later = now + F.make_dt_interval(secs=backoff_seconds(n).cast("decimal(18,6)"))
    return marked.withColumns({
        "attempts": n,
        "status": F.when(dead, "DEAD_LETTER").otherwise(F.col("status")),
        "next_attempt_at": F.when(dead, None).when(F.col("_hit"), later).otherwise(F.col("next_attempt_at")),
    }).drop("_hit")


def after_success(outbox: DataFrame, done: DataFrame) -> DataFrame:
    marked = outbox.join(done.select("record_id").distinct().withColumn("_hit", F.lit(True)), "record_id", "left")
    return marked.withColumn("status", F.when(F.col("_hit"), "DELIVERED").otherwise(F.col("status"))).drop("_hit")


def postpone(outbox: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """With the circuit open: due again a little later, no attempt spent."""
    marked = outbox.join(held.select("record_id").distinct().withColumn("_hit", F.lit(True)), "record_id", "left")
    later = now + F.make_dt_interval(secs=F.lit(POSTPONE_S))
    return marked.withColumn("next_attempt_at", F.when(F.col("_hit"), later).otherwise(F.col("next_attempt_at"))).drop("_hit")


def remember_delivered(keys: DataFrame, delivered: DataFrame) -> DataFrame:
    """New (dataset, key) pairs only; orders go to ordered-lines, the rest to invoiced-lines."""
    name = F.when(F.col("schema") == "order-line", "ordered-lines").otherwise("invoiced-lines")
    fresh = delivered.where("business_key is not null").groupBy(name.alias("dataset"), F.col("business_key").alias("key")).agg(F.min("record_id").alias("record_id"))
    return keys.select("dataset", "key", "record_id").unionByName(fresh.join(keys, ["dataset", "key"], "left_anti"))


def consume_open_quantity(po_lines: DataFrame, delivered: DataFrame) -> DataFrame:
    """Order lines with the quantities of delivered invoice lines added to what is invoiced."""
    used = delivered.where("quantity is not null").groupBy("poNumber", "sku").agg(F.sum("quantity").alias("_used"))
    total = (F.col("invoicedQty") + F.coalesce("_used", F.lit(0))).cast(po_lines.schema["invoicedQty"].dataType)
    return po_lines.join(used, ["poNumber", "sku"], "left").withColumn("invoicedQty", total).drop("_used")


class CircuitOpen(RuntimeError):
    """The breaker lets no call through."""


@dataclass
class CircuitBreaker:
    """Opens when half of the last calls failed; one trial call after a pause decides."""

    clock: Callable[[], float]
    window: int = 6
    least: int = 3
    failure_rate: float = 0.5
    open_seconds: float = 15
    state: str = "CLOSED"
    opened_at: float = 0.0
    calls: deque[bool] = field(default_factory=deque)

    def call(self, f: Callable[[], object]) -> object:
        if self.state == "OPEN":
            if self.clock() - self.opened_at < self.open_seconds:
                raise CircuitOpen
            self.state = "HALF_OPEN"
        try:
            out = f()
        except Exception:
            self._record(False)
            raise
        self._record(True)
        return out

    def _record(self, ok: bool) -> None:
        if self.state == "HALF_OPEN":
            self.calls.clear()
            self.state = "CLOSED" if ok else "OPEN"
            self.opened_at = self.clock()
            return
        self.calls.append(ok)
        while len(self.calls) > self.window:
            self.calls.popleft()
        if len(self.calls) >= self.least and self.calls.count(False) >= self.failure_rate * len(self.calls):
            self.state, self.opened_at = "OPEN", self.clock()
            self.calls.clear()


def deliver(batch: DataFrame, send: Callable[[str, list[str], str], None], breaker: CircuitBreaker) -> tuple[list, list, list]:
    """(delivered, failed, postponed) record ids of one claimed batch, at most BATCH rows.

    One call ``send(schema, payloads, key)`` for each schema, in the order of the claim; a repeated delivery has the same key.
    """
    done, failed, held = [], [], []
    rows: dict[str, list] = {}
    for r in batch.select("schema", "record_id", "business_key", "payload").collect():  # a claimed batch
        rows.setdefault(r["schema"], []).append(r)
    for schema, rs in rows.items():
        ids = [r["record_id"] for r in rs]
        pairs = ",".join(f"{r['record_id']}:{'null' if r['business_key'] is None else r['business_key']}" for r in rs)
        key = hashlib.sha256(pairs.encode()).hexdigest()
        try:
            breaker.call(lambda: send(schema, [r["payload"] for r in rs], key))
            done += ids
        except CircuitOpen:
            held += ids
        except Exception:  # whatever the receiver raises is a failed attempt
            failed += ids
    return done, failed, held


def deliver_due(
    outbox: DataFrame, keys: DataFrame, po_lines: DataFrame, now: Column, send: Callable[[str, list[str], str], None], breaker: CircuitBreaker, limit: int = BATCH
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(outbox, delivered keys, order lines, number delivered) after one batch: claim, send, mark, remember, consume; failures retried or dead."""
    done, failed, held = deliver(claim(outbox, now, limit), send, breaker)
    kind = outbox.schema["record_id"].dataType.simpleString()
    ids = lambda some: outbox.sparkSession.createDataFrame([(i,) for i in some], f"record_id {kind}")  # noqa: E731  a batch at most
    sent = outbox.join(ids(done), "record_id", "left_semi")
    keys = remember_delivered(keys, sent)
    po_lines = consume_open_quantity(po_lines, sent.where("schema = 'invoice-line'"))
    return postpone(after_failure(after_success(outbox, ids(done)), ids(failed), now), ids(held), now), keys, po_lines, len(done)


def deliver_jobs(
    outbox: DataFrame, keys: DataFrame, po_lines: DataFrame, jobs_table: DataFrame, now: Column, send: Callable[[str, list[str], str], None], breaker: CircuitBreaker, limit: int = BATCH
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(outbox, delivered keys, order lines, jobs, events) after one batch, as :func:`deliver_due`; jobs with a record of the batch are counted anew, and an event tells what became of each record."""
    batch = claim(outbox, now, limit).select("record_id", "status").collect()  # a batch at most
    after, keys, po_lines, _ = deliver_due(outbox, keys, po_lines, now, send, breaker, limit)
    kind = outbox.schema["record_id"].dataType.simpleString()
    touched = outbox.sparkSession.createDataFrame([(r["record_id"], r["status"]) for r in batch], f"record_id {kind}, was string")
    said = F.when(F.col("status") == "DELIVERED", "DELIVERED").when(F.col("status") == "DEAD_LETTER", "DEAD_LETTER").otherwise("RETRY")
    events = after.join(touched, "record_id").select("record_id", "job_id", said.alias("event"), now.alias("at"))
    return after, keys, po_lines, recount_touched(jobs_table, after, touched), events
