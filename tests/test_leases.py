"""Several deliverers of one outbox."""

import datetime
from concurrent.futures import ThreadPoolExecutor

import pytest

from wharfline.operators import leases, outbox

NOW = datetime.datetime(2026, 1, 1, 12)


def _box(spark, path, n=24, buckets=3):
    rows = [(i, "invoice-line", f"K{i}", f"p{i}", "VALID" if i % 6 else "ERROR", NOW, 0) for i in range(n)]
    box = leases.SharedOutbox(spark, str(path), buckets)
    box.put(spark.createDataFrame(rows, "record_id long, schema string, business_key string, payload string, status string, next_attempt_at timestamp, attempts int"))
    return box


def _files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_two_deliverers_never_send_a_record_twice(spark, tmp_path):
    box, sent = _box(spark, tmp_path / "box"), []

    def work(name):
        own = leases.SharedOutbox(spark, str(tmp_path / "box"), 3)
        while (lease := own.lease(NOW)) is not None:
            leases.deliver_bucket(own, lease, NOW, lambda s, payloads, k, lease=lease: sent.extend((p, lease.bucket, lease.fence) for p in payloads), outbox.CircuitBreaker(lambda: 0.0))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(work, "abc"))
    assert sorted(p for p, _, _ in sent) == sorted(f"p{i}" for i in range(24) if i % 6) and len({(b, f) for _, b, f in sent}) == 3
    assert {r["record_id"]: r["status"] for r in box.read().collect()} == {i: "DELIVERED" if i % 6 else "ERROR" for i in range(24)}
    assert box.lease(NOW) is None and box.lease(NOW + datetime.timedelta(minutes=2)).fence == 2


def test_an_overtaken_deliverer_stops(spark, tmp_path):
    box, sent = _box(spark, tmp_path / "box", buckets=1), []
    slow = box.lease(NOW, 10)
    later = NOW + datetime.timedelta(seconds=11)
    fast = box.lease(later, 10)
    assert (slow.fence, fast.fence) == (1, 2) and not box.holds(slow)
    with pytest.raises(leases.Fenced):
        leases.deliver_bucket(box, slow, NOW, lambda *a: sent.append(a), outbox.CircuitBreaker(lambda: 0.0))
    with pytest.raises(leases.Fenced):
        box.settle(slow, box.read([0]))
    stale = box.read([0])
    leases.deliver_bucket(box, fast, later, lambda *a: sent.append(a), outbox.CircuitBreaker(lambda: 0.0))
    stale.write.parquet(str(tmp_path / "box/records/bucket=0/version=1"))  # written all the same, it does not count
    assert len(sent) == 1 and box.read().where("status = 'DELIVERED'").count() == 20
    box.release(fast)
    assert box.lease(later).fence == 4


def test_a_lost_write_is_sent_again_under_the_same_key(spark, tmp_path):
    box, keys = _box(spark, tmp_path / "box", buckets=1), []
    first = box.lease(NOW, 5)
    outbox.deliver(outbox.claim(box.read([first.bucket]), leases.F.lit(NOW)), lambda s, p, k: keys.append(k), outbox.CircuitBreaker(lambda: 0.0))  # sent, and then the deliverer died
    second = box.lease(NOW + datetime.timedelta(seconds=6))
    leases.deliver_bucket(box, second, NOW, lambda s, p, k: keys.append(k), outbox.CircuitBreaker(lambda: 0.0))
    assert keys[0] == keys[1] and second.fence == 2


def test_a_transition_writes_one_bucket(spark, tmp_path):
    box = _box(spark, tmp_path / "box")
    before = _files(tmp_path / "box")
    lease = box.lease(NOW)
    done, failed, held = leases.deliver_bucket(box, lease, NOW, lambda *a: (_ for _ in ()).throw(OSError("down")), outbox.CircuitBreaker(lambda: 0.0))
    fresh = _files(tmp_path / "box") - before
    assert failed and not done and not held and fresh and all(f.startswith(f"records/bucket={lease.bucket}/version={lease.fence}/") for f in fresh)
    assert {(r["status"], r["attempts"]) for r in box.read([lease.bucket]).where("status <> 'ERROR'").collect()} == {("VALID", 1)}
    assert box.read().count() == 24
