import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from wharfline.operators import edi, outbox, pipeline, suggest
from wharfline.operators.reference import Reference, keyed
from wharfline.plans import model
from wharfline.plans.transforms import Context
from wharfline.sources import parsers, reader

CSV = (
    b"\xef\xbb\xbfMill works,,,,,\r\nGSTIN: 27AAPFU0939F1ZV,,,,,\r\nInv No.,Inv Dt,Item Code,Qty (Nos),Rate (Rs),Amt (Rs)\r\n"
    b'A-1,03/09/2026,P1,10,"1,000.00","10,000.00"\r\nA-1,03/09/2026,P1,10,"1,000.00","10,000.00"\r\nA-2,31/02/2026,P2,5,20,101\r\n"A-3 ""x""",04/09/2026,P9,1,1,1\r\n,,,,,\r\nTotal,,,,,"20,102"\r\n'
)
SCHEMA = model.load_schema({"name": "invoice-line", "businessKey": ["invoiceNumber", "sku"], "fields": [
    {"name": "invoiceNumber", "label": "Invoice number", "required": True}, {"name": "invoiceDate", "type": "DATE", "label": "Invoice date"}, {"name": "sku", "label": "SKU", "aliases": ["item code"]},
    {"name": "quantity", "type": "DECIMAL", "label": "Quantity"}, {"name": "unitPrice", "type": "DECIMAL", "label": "Unit price", "aliases": ["rate"]}, {"name": "lineAmount", "type": "DECIMAL", "label": "Line amount", "aliases": ["amount"]},
    {"name": "currency"}, {"name": "usd", "type": "DECIMAL", "derived": True}]})
SPEC = model.load_spec({"partnerId": "MILL", "schema": "invoice-line", "format": "CSV", "fields": [
    {"target": "invoiceNumber", "source": "inv no"}, {"target": "invoiceDate", "source": "Inv Dt", "transform": "date('dd/MM/yyyy')"}, {"target": "sku", "source": "Item Code"},
    {"target": "quantity", "source": "Qty (Nos)", "transform": "number"}, {"target": "unitPrice", "source": "Rate (Rs)", "transform": "amount"}, {"target": "lineAmount", "source": "Amt (Rs)", "transform": "amount"},
    {"target": "currency", "const": "INR"}], "enrich": [{"convert": {"amount": "lineAmount", "currency": "currency", "target": "usd"}}]})
RULES = model.load_rules({"rules": [
    {"id": "D", "type": "required", "field": "invoiceDate"}, {"id": "U", "type": "unique", "fields": ["invoiceNumber", "sku"]},
    {"id": "M", "type": "arithmetic", "field": "lineAmount", "left": "quantity", "op": "*", "right": "unitPrice", "tolerance": 0.5},
    {"id": "R", "type": "reference", "dataset": "catalog", "key": "{sku}", "checks": [{"type": "withinPct", "field": "unitPrice", "refField": "price", "label": "price", "warnPct": 2, "errorPct": 5}]}]})


def _files(spark, name, data):
    return spark.createDataFrame([("f1", name, bytearray(data))], "file_id string, file_name string, content binary")


def test_csv_to_outcomes(spark):
    records = reader.read_files(_files(spark, "a.csv", CSV), SPEC.reader, "CSV")
    rows = spark.createDataFrame([("P1", Decimal("980")), ("p2", Decimal("20"))], "sku string, price decimal(18,6)")
    fx = spark.createDataFrame([("INR", Decimal("0.01"))], "currency string, rate decimal(18,8)")
    reference = Reference({"catalog": keyed(rows, "{sku}"), "fx": keyed(fx, "{currency}")})
    out = pipeline.run(records, SPEC, SCHEMA, RULES, reference, Context({}), datetime.date(2026, 9, 24))
    got = out.orderBy("seq").collect()
    assert [r["line"] for r in got] == [4, 5, 6, 7]
    assert [r["status"] for r in got] == ["WARNING", "ERROR", "ERROR", "ERROR"]
    messages = [[(v["rule"], v["message"]) for v in r["violations"]] for r in got]
    assert messages[0] == [("R", "unitPrice 1000 is 2.04% above price 980")]
    assert messages[1][0] == ("U", "duplicate of line 4 (invoiceNumber + sku)")
    assert messages[2] == [
        ("MAPPING", "Invoice date: '31/02/2026' does not match date format dd/MM/yyyy"), ("D", "invoiceDate is missing"), ("M", "lineAmount 101 does not equal quantity * unitPrice = 100"),
    ]
    assert messages[3] == [("R", "P9 not found in catalog")] and got[3]["invoiceNumber"] == 'A-3 "x"'
    assert got[0]["usd"] == Decimal("100.000000") and got[0]["lineage"]["usd"] == ["lineAmount", "fx.INR"] and got[0]["lineage"]["invoiceNumber"] == ["Inv No"]
    total = pipeline.file_summary(out).first()
    assert (total["total"], total["valid"], total["warnings"], total["errors"]) == (4, 0, 1, 3)


def test_headers():
    rows = [["Register"], ["", "Invoice", "", "GST (Rs)", ""], ["Sr No", "No.", "Date", "CGST", "SGST"], ["1", "A1", "01/02/2026", "10", "10"], ["2", "A2", "02/02/2026", "10", "10"]]
    p = parsers.tabular(list(enumerate(rows, 1)))
    assert p.columns == ["Sr No", "Invoice No", "Invoice Date", "GST (Rs) CGST", "GST (Rs) SGST"] and len(p.records) == 2
    assert parsers.column_names(None, ["a", "A", ""]) == ["a", "A (2)", "column_3"]
    assert parsers.read("x", b"", model.ReaderOptions(), "CSV").records == []


def test_trees_and_sniffing():
    j = parsers.read("a.json", b'{"h": {"n": 1.50}, "lines": [{"q": 2, "t": [1, null]}], "z": true}', model.ReaderOptions(record_element="lines"))
    assert j.records == [(1, {"h/n": "1.50", "z": "true", "q": "2", "t[1]": "1", "t[2]": ""})]
    x = parsers.read("a.xml", b'<a:D xmlns:a="u"><H id="7"><N>n</N></H><L k="1"><P><Q>3</Q><Q>4</Q></P><E/></L></a:D>', model.ReaderOptions(record_element="L"))
    assert x.records[0][1] == {"H/@id": "7", "H/N": "n", "@k": "1", "P/Q": "3", "P/Q[2]": "4", "E": ""}
    assert [parsers.sniff(*a) for a in [("a", b"PK\x03\x04"), ("a", b"ISA*"), ("a", b" <a"), ("a.json", b"x"), ("a", b"a,b\n1,2"), ("a", b" ")]] == ["XLSX", "X12", "XML", "JSON", "CSV", "UNKNOWN"]
    assert parsers.sniff_delimiter(["Title", "a;b;c", '"x;y";2;3']) == ";"


def test_fixed_width_native_and_plain(spark):
    lines = ["H  INV1", "D  1A", "D  2B", "H  INV2", "D  1C", "T  3"]
    o = model.ReaderOptions(detail="D", trailer="T", layouts={"H": (model.Layout("INV", 2, 6),), "D": (model.Layout("LINE", 2, 3), model.Layout("PART", 5, 3)), "T": (model.Layout("RECORD_COUNT", 2, 3),)})
    p = parsers.read_fixed("\r\n".join(lines).encode(), o)
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate(lines, 1)], "file_id string, line long, text string")
    native = [(r["line"], r["fields"]) for r in reader.fixed_width(df, o).orderBy("line").collect()]
    assert native == p.records and p.totals == {"lineCount": "3"} and reader.trailer_totals(df, o).first()["declared"] == "3"


X12 = "ISA*00*          *00*          *ZZ*SUPPLYR        *ZZ*US             *260922*0930*U*00401*000000077*0*P*>~GS*IN*SUP*US*20260922*0930*77*X*004010~ST*810*0001~BIG*20260922*I1~REF*PO*9~IT1*1*5*EA*2.5**VP*S1~PID*F****Bolt~IT1*2*1*EA*3**VP*S2~TDS*1550~CTT*2~SE*{}*0001~GE*1*77~IEA*1*000000077~"


def test_x12(spark):
    good, bad = edi.parse(X12.format(9)), edi.parse(X12.format(7))
    assert good.valid and [r[1]["IT1.VP"] for r in edi.records(good).records] == ["S1", "S2"]
    assert edi.records(good).records[0][1]["REF.PO.02"] == "9" and edi.records(good).records[0][1]["PID05"] == "Bolt" and edi.records(good).totals == {"lineCount": "2"}
    assert bad.groups[0].transactions[0].issues == [("4", "SE01 declares 7 segments but 9 were received", 11)] and edi.records(bad).records == []
    ack = edi.acknowledge(bad, 1000, 500, datetime.datetime(2026, 9, 22, 9, 30))
    assert "AK5*R*4~" in ack and "AK9*R*1*1*0~" in ack and len(ack.split("\n")[0]) == 106 and "IEA*1*000001000~" in ack
    df = spark.createDataFrame([("f", X12.format(9))], "file_id string, text string")
    assert edi.envelope_counts(edi.segments(df)).first()["n_segments"] == 9
    assert {r["fields"]["IT101"]: r["fields"]["BIG02"] for r in edi.flattened(edi.segments(df), "IT1").collect()} == {"1": "I1", "2": "I1"}


def test_suggestions(spark):
    records = reader.read_files(_files(spark, "a.csv", CSV), SPEC.reader, "CSV")
    columns = ["Inv No", "Inv Dt", "Item Code", "Qty (Nos)", "Rate (Rs)", "Amt (Rs)"]
    report = suggest.suggest(SCHEMA, suggest.collect_profiles(suggest.profile(records), columns))
    assert {s.target: s.sources for s in report.suggestions if s.sources} == {"invoiceNumber": ["Inv No"], "invoiceDate": ["Inv Dt"], "sku": ["Item Code"], "quantity": ["Qty (Nos)"], "unitPrice": ["Rate (Rs)"], "lineAmount": ["Amt (Rs)"]}


def test_breaker_and_retry(spark):
    now = [0.0]
    b = outbox.CircuitBreaker(lambda: now[0])

    def fail():
        raise OSError

    for _ in range(3):
        try:
            b.call(fail)
        except OSError:
            pass
    assert b.state == "OPEN"
    try:
        b.call(lambda: 1)
        raise AssertionError
    except outbox.CircuitOpen:
        pass
    now[0] = 16
    assert b.call(lambda: 1) == 1 and b.state == "CLOSED"
    at = F.lit("2026-01-01").cast("timestamp")
    box = spark.range(2).select(F.col("id").alias("record_id"), F.lit("VALID").alias("status"), (F.col("id") * 4).cast("int").alias("attempts"), at.alias("next_attempt_at"))
    out = {r["record_id"]: (r["status"], r["attempts"], r["next_attempt_at"]) for r in outbox.after_failure(box, box, at).collect()}
    assert out[0] == ("VALID", 1, datetime.datetime(2026, 1, 1, 0, 0, 2)) and out[1] == ("DEAD_LETTER", 5, None)


def test_streaming_intake(spark, tmp_path):
    from wharfline.streaming import intake

    for i, name in enumerate(["a.csv", "b.csv"]):
        (tmp_path / "in" / "mill").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "mill" / name).write_bytes(CSV)
    seen = []
    for _ in range(2):
        q = intake.run(intake.inbox(spark, str(tmp_path / "in")), str(tmp_path / "jobs"), lambda df, n: seen.extend((r["partner_id"], r["file_name"]) for r in df.collect()), str(tmp_path / "ck"))
        q.awaitTermination()
    assert len(seen) == 1 and seen[0][0] == "MILL"
