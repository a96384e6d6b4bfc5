"""Acknowledgment numbers, transitions with their audit and counts, suggestions of many files."""

import datetime

from pyspark.sql import functions as F
from test_engine import CSV, SCHEMA, X12

from wharfline.operators import edi, jobs, outbox, suggest
from wharfline.plans import model
from wharfline.sources import reader

NOW = datetime.datetime(2026, 9, 22, 9, 30)
KIND = "array<struct<rule:string,field:string,severity:string,message:string>>"


def test_control_numbers_leave_no_gap(spark):
    texts = [(f"f{i:03d}", X12.format(9 if i % 3 else 7)) for i in range(40)] + [("f900", "no interchange"), ("f901", None)]
    files = spark.createDataFrame(texts, "file_id string, text string").repartition(7)
    first = edi.acknowledge_files(files.where("file_id < 'f025'"), None, NOW)
    rows = first.orderBy("file_id").collect()
    assert [r["interchange"] for r in rows] == list(range(1000, 1025)) and [r["group_control"] for r in rows] == list(range(500, 525))
    acks = spark.createDataFrame(rows[:20], edi.ACKS)  # five got lost; the batch is tried again with all files
    again = {r["file_id"]: r for r in edi.acknowledge_files(files, acks, NOW).collect()}
    assert sorted(r["interchange"] for r in again.values()) == list(range(1000, 1040))
    assert all(again[r["file_id"]] == r for r in rows[:20])
    assert again["f007"]["ack"] == edi.acknowledge(edi.parse(texts[7][1]), 1007, 507, NOW) and "AK5*R*4~" in again["f003"]["ack"]
    assert edi.acknowledge_files(files.limit(0), None, NOW).count() == 0


def _store(spark):
    violated = [("R", "f", "ERROR", "m")]
    rows = [(i, i // 10, ["VALID", "ERROR", "DEAD_LETTER", "WARNING"][i % 4], violated if i % 4 in (1, 2) else [("W", "f", "WARNING", "m")] if i % 4 == 3 else []) for i in range(40)]
    records = spark.createDataFrame(rows, f"record_id long, job_id long, status string, violations {KIND}")
    table = jobs.recount(records.select("job_id").distinct().withColumn("name", F.lit("n")), records)
    return records, table, spark.createDataFrame([], "audit_id string, record_id long, action string, actor string, at timestamp, detail string")


def _counts(records, table):
    want = {r["job_id"]: tuple(r[c] for c in ("total", "errors", "warnings", "valid")) for r in jobs.recount(records.select("job_id").distinct(), records).collect()}
    assert {r["job_id"]: tuple(r[c] for c in ("total", "errors", "warnings", "valid")) for r in table.collect()} == want


def test_transitions_write_audit_and_counts(spark):
    records, table, audit = _store(spark)
    held = spark.createDataFrame([(1,), (2,), (13,)], "record_id long")
    records, table, audit = jobs.transition(records, table, audit, jobs.dismiss(records.join(held, "record_id", "left_semi"), held), held, "DISMISS", "ann", NOW)
    assert records.count() == 40 and {r["record_id"] for r in records.where("status = 'DISMISSED'").collect()} == {1, 2, 13}
    _counts(records, table)
    dead = spark.createDataFrame([(6,), (22,)], "record_id long")
    records, table, audit = jobs.transition(records, table, audit, jobs.replay(records.join(dead, "record_id", "left_semi"), dead), dead, "REPLAY", "bob", NOW)
    assert {r["status"] for r in records.where("record_id in (6, 22)").collect()} == {"WARNING"}
    _counts(records, table)
    assert sorted((r["record_id"], r["action"], r["actor"]) for r in audit.collect()) == [(1, "DISMISS", "ann"), (2, "DISMISS", "ann"), (6, "REPLAY", "bob"), (13, "DISMISS", "ann"), (22, "REPLAY", "bob")]
    assert [r["action"] for r in jobs.audit_trail(audit, 6).collect()] == ["REPLAY"]


def test_delivery_counts_jobs_and_tells_events(spark):
    rows = [(i, i // 3, "invoice-line" if i % 2 else "order-line", f"K{i}", "{}", "VALID", NOW, 4 if i == 2 else 0, "P", "s", 1, []) for i in range(9)]
    box = spark.createDataFrame(rows, f"record_id long, job_id long, schema string, business_key string, payload string, status string, next_attempt_at timestamp, attempts int, poNumber string, sku string, quantity int, violations {KIND}")
    table = jobs.recount(box.select("job_id").distinct(), box)
    keys, po = spark.createDataFrame([], "dataset string, key string, record_id long"), spark.createDataFrame([("P", "s", 10)], "poNumber string, sku string, invoicedQty int")

    def send(schema, payloads, key):
        if schema == "order-line":
            raise OSError("down")

    after, keys, po, table, events = outbox.deliver_jobs(box, keys, po, table, F.lit(NOW), send, outbox.CircuitBreaker(lambda: 0.0), limit=4)
    assert {r["record_id"]: r["event"] for r in events.collect()} == {0: "RETRY", 1: "DELIVERED", 2: "DEAD_LETTER", 3: "DELIVERED"}
    _counts(after, table)
    assert {r["job_id"]: r["errors"] for r in table.collect()} == {0: 1, 1: 0, 2: 0} and keys.count() == 2 and po.first()["invoicedQty"] == 12


def test_suggestions_of_many_files_equal_those_of_each(spark):
    other = CSV.replace(b"Item Code", b"Material").replace(b"Inv No", b"Bill Number")
    files = spark.createDataFrame([(f"f{i}", "a.csv", bytearray([CSV, other][i % 2])) for i in range(12)], "file_id string, file_name string, content binary").repartition(4)
    profiled, meta = suggest.profile(reader.read_files(files, model.ReaderOptions(), "CSV")), reader.read_meta(files, model.ReaderOptions(), "CSV")
    out = suggest.suggest_files(profiled, meta, SCHEMA).collect()
    columns = {r["file_id"]: list(r["columns"]) for r in meta.collect()}
    for i in range(2):
        report = suggest.suggest(SCHEMA, suggest.collect_profiles(profiled.where(F.col("file_id") == f"f{i}"), columns[f"f{i}"]))
        for j in range(i, 12, 2):
            own = {r["target"]: r for r in out if r["file_id"] == f"f{j}"}
            assert {t: (list(r["sources"]), r["confidence"], r["transform"], list(r["unused"])) for t, r in own.items()} == {s.target: (s.sources, s.confidence, s.transform, report.unused) for s in report.suggestions}


def test_first_content_is_joined_back(spark):
    rows = [("P", f"f{i}", f"n{i}", NOW + datetime.timedelta(seconds=-i), bytearray(b"same" if i < 5 else b"other%d" % (i % 2))) for i in range(9)]
    files = spark.createDataFrame(rows, "partner_id string, file_id string, file_name string, received_at timestamp, content binary")
    fresh = jobs.receive(files, spark.createDataFrame([], "partner_id string, sha256 string"))
    assert {(r["file_id"], bytes(r["content"])) for r in fresh.collect()} == {("f4", b"same"), ("f8", b"other0"), ("f7", b"other1")}
    assert jobs.receive(files, fresh.select("partner_id", "sha256")).count() == 0
