"""Readers and rules without a window over a file: ranges, arrays of segments, keys that occur again."""

import datetime
import random

from pyspark.sql import functions as F
from test_engine import X12

from wharfline.operators import edi, mapping, rules
from wharfline.operators.reference import Reference
from wharfline.plans import model
from wharfline.sources import parsers, reader


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_headers_are_carried_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(reader, "RANGE", 4)
    o = model.ReaderOptions(detail="D", trailer="T", layouts={
        "H": (model.Layout("INV", 2, 6),), "HX": (model.Layout("CODE", 3, 4),), "D": (model.Layout("PART", 2, 5), model.Layout("QTY", 7, 3)), "T": (model.Layout("RECORD_COUNT", 2, 4),),
    })
    rng, rows, want = random.Random(4), [], {}
    for f in ("a", "b", "c"):
        lines = [rng.choice([f"H{i:06d}", f"HX{i:04d}", *[f"D{f}{i:04d}{i % 7:3d}"] * 5, "", "?", "T0003"]) for i in range(60)]
        rows += [(f, i, s) for i, s in enumerate(lines, 1)]
        want[f] = parsers.read_fixed("\n".join(lines).encode(), o).records
    out = reader.fixed_width(spark.createDataFrame(rows, "file_id string, line long, text string").repartition(5), o)
    for f, records in want.items():
        assert [(r["line"], r["fields"]) for r in out.where(F.col("file_id") == f).orderBy("line").collect()] == records
    assert all("_range" in line for line in _plan(out).splitlines() if "Window [" in line)


def _interchange(*transactions, ge=None):
    n = len(transactions)
    return "~\n".join([X12.split("~")[0], "GS*IN*SUP*US*20260922*0930*77*X*004010", *transactions, f"GE*{n}*{ge or 77}", "IEA*1*000000077", ""])


def _invoice(control, lines, declared=None, kind="810"):
    body = [f"BIG*20260922*I{control}", *[f"IT1*{i}*5*EA*2.5**VP*S{i}" for i in range(1, lines + 1)], f"CTT*{lines}"]
    return "~\n".join([f"ST*{kind}*{control}", *body, f"SE*{declared or len(body) + 2}*{control}"])


def test_two_readers_of_an_interchange_agree(spark):
    texts = {
        "whole": _interchange(_invoice("0001", 3), _invoice("0002", 1)), "half": _interchange(_invoice("0001", 2, declared=99), _invoice("0002", 2)),
        "none": _interchange(_invoice("0001", 2, kind="999")), "group": _interchange(_invoice("0001", 1), ge=5), "empty": _interchange(), "not one": "ST*810*0001~",
    }
    files = spark.createDataFrame(list(texts.items()), "file_id string, text string")
    want = {f: [(line, fields) for line, fields in edi.records(edi.parse(t)).records] for f, t in texts.items() if f != "not one"}
    for out in (edi.transactions(files), edi.flattened(edi.segments(files)), edi.flattened(edi.segment_arrays(files))):
        got = {}
        for r in out.orderBy("file_id", "line").collect():
            got.setdefault(r["file_id"], []).append((r["line"], r["fields"]))
        assert got == {f: rows for f, rows in want.items() if rows}
        assert "Window" not in _plan(out)
    assert [(r["tx_no"], r["loop_no"]) for r in edi.transactions(files).where("file_id = 'half'").orderBy("line").collect()] == [(2, 1), (2, 2)]
    for segs in (edi.segments(files), edi.segment_arrays(files)):
        counts = {(r["file_id"], r["tx_no"]): (r["tx_type"], r["n_segments"], r["declared"]) for r in edi.envelope_counts(segs).collect()}
        assert counts[("half", 1)] == ("810", 6, 99) and counts[("none", 1)] == ("999", 6, 6) and counts[("whole", 2)] == ("810", 5, 5) and len(counts) == 6
        assert "Window" not in _plan(edi.envelope_counts(segs))
    assert _plan(edi.transactions(files)).count("Exchange") == 0


def test_files_share_frames(spark):
    docs = spark.createDataFrame([(f"f{i}", f"f{i}.csv", bytearray(b"Item No,Name,Qty\n1,x,2\n2,y,3\n")) for i in range(4000)], "file_id string, file_name string, content binary").coalesce(1)
    rows = reader.read_files(docs, model.ReaderOptions())
    assert rows.count() == 8000 and rows.select("file_id").distinct().count() == 4000 and {r["seq"] for r in rows.select("seq").distinct().collect()} == {0, 1}
    big, error = reader._parse("a.csv", b"x" * (reader.LARGEST + 1), model.ReaderOptions(), "CSV")[1:]
    assert big.records == [] and "use the readers of large files" in error


def test_unique_sends_only_keys_that_occur_again(spark):
    schema = model.load_schema({"name": "s", "fields": [{"name": "a"}, {"name": "b"}]})
    picked = model.load_rules({"rules": [{"id": "U", "type": "unique", "fields": ["a", "b"]}, {"id": "W", "type": "when", "field": "b", "in": ["x"], "then": [{"id": "V", "type": "unique", "fields": ["a"]}]}]})
    rng = random.Random(1)
    rows = [(f"f{rng.randrange(3)}" if rng.random() < 0.9 else None, i, i + 2, rng.choice(["k", "K", *map(str, range(300))]), rng.choice(["x", "y", "", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "file_id string, seq long, line long, a string, b string").withColumn("issues", mapping.none_yet())
    out = rules.validate(df, picked, schema, Reference(), datetime.date(2026, 1, 1))
    got = {(r["seq"], r["v"]["rule"], r["v"]["message"]) for r in rules.violations(out, "seq").collect()}
    want, first = set(), {}
    for f, seq, line, a, b in rows:
        for rule, key in (("U", (a.upper(), b.upper()) if b else None), ("V", a.upper() if b == "x" else None)):
            if key is not None and first.setdefault((rule, f, key), line) != line:
                want.add((seq, rule, f"duplicate of line {first[rule, f, key]} ({'a + b' if rule == 'U' else 'a'})"))
    assert got == want and want
    assert "Window" not in _plan(out)
