"""An outbox that several deliverers share: records in buckets, a bucket at a time leased to one of them.

A bucket's records are a table of their own, in versions numbered by the lease under which they were written; the highest version that is whole counts. A lease is a small file that
only one deliverer can create (``leases/bucket=7/fence=12``), with the time at which it ends; its number is the fence. Whoever holds the highest fence of
a bucket may send its records and write its next version. A deliverer that was overtaken (its lease ended, another took the bucket) finds a higher fence
before it sends or writes and stops; should it write all the same, its version is lower than the other's lease and does not count.
A transition writes one bucket, never the outbox.

Deliveries carry the idempotency key of their batch, as in :mod:`.outbox`: a deliverer that dies between sending and writing leaves its bucket to the next
one, who sends the same batch under the same key but another fence.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import outbox


class Fenced(RuntimeError):
    """The bucket was leased to another deliverer meanwhile."""


@dataclass(frozen=True)
class Lease:
    bucket: int
    fence: int
    until: datetime.datetime


class SharedOutbox:
    """Records (record_id, ...) below ``path`` in any store that Spark writes and in which a file is created by one at most."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        top = self._path("")
        self.system = top.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self, folder: str, name: str) -> list[int]:
        """The numbers n of the entries ``name=n`` of a folder, rising."""
        at = self._path(folder)
        found = [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []
        return sorted(int(f.removeprefix(f"{name}=")) for f in found if f.startswith(f"{name}="))

    def _version(self, bucket: int) -> int | None:
        whole = [v for v in self._numbers(f"records/bucket={bucket}", "version") if self.system.exists(self._path(f"records/bucket={bucket}/version={v}/_SUCCESS"))]
        return max(whole, default=None)

    def put(self, records: DataFrame) -> None:
        """Begin with these records, one write for all buckets."""
        at = F.pmod(F.xxhash64(F.col("record_id").cast("string")), F.lit(self.buckets))
        records.withColumn("bucket", at).withColumn("version", F.lit(0)).write.partitionBy("bucket", "version").parquet(f"{self.path}/records")
        for b in self._numbers("records", "bucket"):
            self.system.create(self._path(f"records/bucket={b}/version=0/_SUCCESS"), True).close()

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The records as they are now, of all buckets or some."""
        some = self._numbers("records", "bucket") if buckets is None else buckets
        return self.spark.read.parquet(*[f"{self.path}/records/bucket={b}/version={self._version(b)}" for b in some])

    def lease(self, now: datetime.datetime, seconds: int = 60) -> Lease | None:
        """A bucket that nobody holds, leased to the caller; None where all are held."""
        for bucket in self._numbers("records", "bucket"):
            last = max(self._numbers(f"leases/bucket={bucket}", "fence"), default=0)
            if last and self._until(bucket, last) > now:
                continue
            until = now + datetime.timedelta(seconds=seconds)
            if self._create(f"leases/bucket={bucket}/fence={last + 1}", until.isoformat()):
                return Lease(bucket, last + 1, until)
        return None

    def _create(self, name: str, text: str) -> bool:
        """Whether the file could be created, which only one caller can."""
        free = self._path(name)
        if self.system.exists(free):
            return False
        try:
            stream = self.system.create(free, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _until(self, bucket: int, fence: int) -> datetime.datetime:
        path = self._path(f"leases/bucket={bucket}/fence={fence}")
        stream = self.system.open(path)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        if text:
            return datetime.datetime.fromisoformat(text)
        made = datetime.datetime.fromtimestamp(self.system.getFileStatus(path).getModificationTime() / 1000)
        return made + datetime.timedelta(seconds=60)  # being written, or its writer died just then

    def holds(self, lease: Lease) -> bool:
        return max(self._numbers(f"leases/bucket={lease.bucket}", "fence"), default=0) == lease.fence

    def settle(self, lease: Lease, records: DataFrame) -> None:
        """Write the bucket's next version; only the bucket is written."""
        if not self.holds(lease):
            raise Fenced(f"bucket {lease.bucket} has a later lease than {lease.fence}")
        records.write.mode("overwrite").parquet(f"{self.path}/records/bucket={lease.bucket}/version={lease.fence}")

    def release(self, lease: Lease) -> None:
        """End the lease early: the bucket is free for the next lease, whose fence is higher."""
        if self.holds(lease):
            self._create(f"leases/bucket={lease.bucket}/fence={lease.fence + 1}", datetime.datetime.min.isoformat())


def deliver_bucket(
    box: SharedOutbox, lease: Lease, now: datetime.datetime, send: Callable[[str, list[str], str], None], breaker: outbox.CircuitBreaker, limit: int = outbox.BATCH
) -> tuple[list, list, list]:
    """(delivered, failed, postponed) ids of one batch of a leased bucket: claimed, sent and marked, under the lease alone."""
    if not box.holds(lease):
        raise Fenced(f"bucket {lease.bucket} has a later lease than {lease.fence}")
    records = box.read([lease.bucket])

    def fenced(schema: str, payloads: list[str], key: str) -> None:
        if not box.holds(lease):
            raise Fenced(f"bucket {lease.bucket} has a later lease than {lease.fence}")
        send(schema, payloads, key)

    at = F.lit(now)
    done, failed, held = outbox.deliver(outbox.claim(records, at, limit), fenced, breaker)
    kind = records.schema["record_id"].dataType.simpleString()
    ids = lambda some: box.spark.createDataFrame([(i,) for i in some], f"record_id {kind}")  # noqa: E731  a batch at most
    after = outbox.postpone(outbox.after_failure(outbox.after_success(records, ids(done)), ids(failed), at), ids(held), at)
    box.settle(lease, after)
    return done, failed, held
