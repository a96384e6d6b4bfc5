import datetime
import hashlib
import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wharfline import __main__ as cli
from wharfline.functions import amounts, dates, text
from wharfline.operators import jobs, outbox, suggest
from wharfline.operators.reference import Reference, keyed
from wharfline.plans import layout, model
from wharfline.sources import parsers

SCHEMA = {
    "name": "bill", "label": "Bill", "businessKey": ["no", "lineNo"],
    "fields": [
        {"name": "no", "required": True, "label": "Number", "aliases": ["Bill No"]}, {"name": "lineNo", "type": "INTEGER", "required": True, "label": "Line"}, {"name": "sku", "required": True, "label": "SKU", "aliases": ["Item Code"]},
        {"name": "quantity", "type": "DECIMAL", "required": True, "label": "Quantity", "kinds": ["DECIMAL", "INTEGER"]}, {"name": "amount", "type": "DECIMAL", "label": "Amount", "kinds": ["AMOUNT"]}, {"name": "day", "type": "DATE", "label": "Day"},
    ],
}
SPEC = {
    "partnerId": "ACME", "schema": "bill", "format": "UNKNOWN",
    "fields": [
        {"target": "no", "source": "Bill No"}, {"target": "lineNo", "source": "Ln"}, {"target": "sku", "source": "Item Code", "transform": "trim | upper"}, {"target": "quantity", "source": "Qty", "transform": "number"},
        {"target": "amount", "source": "Amt", "transform": "amount"}, {"target": "day", "source": "Bill Dt", "transform": "date('dd/MM/yyyy')"},
    ],
}
RULES = {"rules": [
    {"id": "QTY", "type": "range", "field": "quantity", "min": 1, "max": 90}, {"id": "DUP", "type": "unique", "fields": ["no", "lineNo"]},
    {"id": "SKU", "type": "reference", "dataset": "catalog", "key": "{sku}", "message": "unknown item", "severity": "WARNING"},
]}
ROWS = [["Bill No", "Bill Dt", "Ln", "Item Code", "Qty", "Amt"], ["B-1", "05/11/2026", "1", "a-7", "3", "1,250.50"], ["B-1", "05/11/2026", "2", "a-9", "120", "99"], ["B-1", "05/11/2026", "2", "zz", "4", "12,3x"]]


def workbook(rows):
    """A small workbook: a banner, a blank row, then the rows, with shared strings, inline numbers and a date style."""
    strings = list(dict.fromkeys(c for r in rows for c in r))
    cell = lambda ref, v: f'<c r="{ref}" t="s"><v>{strings.index(v)}</v></c>'
    body = '<row r="1"><c r="A1" t="inlineStr"><is><t>Monthly register of bills</t></is></c></row>'
    for n, row in enumerate(rows, 3):
        body += f'<row r="{n}">' + "".join(cell(f"{chr(65 + i)}{n}", v) for i, v in enumerate(row)) + "</row>"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Bills" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture(scope="module")
def config(tmp_path_factory):
    root = tmp_path_factory.mktemp("config")
    docs = {"schemas/bill": SCHEMA, "specs/ACME": SPEC, "rules/bill": RULES, "lookups": {}, "reference/reference-data": {"catalog": [{"sku": "A-7", "price": 4}, {"sku": "A-9", "price": 5.5}]}}
    for name, doc in docs.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / f"{name}.json").write_text(json.dumps(doc))
    inbox = root / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("ACME bills\n\n" + "\n".join(",".join(f'"{c}"' for c in r) for r in ROWS) + "\n,,,,,\nTotal,,,,127,\n")
    (inbox / "b.xlsx").write_bytes(workbook(ROWS))
    return root


def test_workbook_rows():
    parsed = parsers.read("b.xlsx", workbook(ROWS), model.ReaderOptions(), "XLSX")
    assert parsed.columns == ROWS[0] and [list(r.values()) for _, r in parsed.records] == ROWS[1:] and [n for n, _ in parsed.records] == [4, 5, 6]


def test_process_command(spark, config, capsys, tmp_path):
    assert cli.main(["process", "--config", str(config), "--partner", "ACME", "--today", "2026-11-20", "--json", str(tmp_path / "out"), str(config / "inbox")], spark) == 0
    said = capsys.readouterr().out
    assert said.count("quantity 120 is outside 1 to 90") == 2 and said.count("'12,3x' is not a valid amount") == 2 and said.count("duplicate of line") == 2 and said.count("unknown item (ZZ)") == 2
    assert sum(line.endswith("  3  1  0  2") for line in said.splitlines()) == 2
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(rows) == 6 and {r["values"]["sku"] for r in rows} == {"A-7", "A-9", "ZZ"} and {r["values"].get("amount") for r in rows} == {1250.5, 99.0, None}


def test_suggest_command(spark, config, capsys):
    assert cli.main(["suggest", "--config", str(config), "--schema", "bill", str(config / "inbox" / "a.csv")], spark) == 0
    said = capsys.readouterr().out
    assert "format CSV" in said and "sku" in said and "Item Code" in said.split("unused")[0]


def test_fix(spark):
    schema, spec, rules = model.load_schema(SCHEMA), model.load_spec(SPEC), model.load_rules({"rules": RULES["rules"][:1]})
    made = spark.createDataFrame([(i, "f", i, "B", i, i, "A-7", Decimal(100 + i), None, None) for i in range(5)], "record_id long, file_id string, seq long, no string, line long, lineNo long, sku string, quantity decimal(18,6), amount decimal(18,6), day date")
    held = made.withColumns({"lineage": F.create_map(F.lit("quantity"), F.array(F.lit("Qty")), F.lit("sku"), F.array(F.lit("Item"))), "violations": F.array().cast("array<struct<rule:string,field:string,severity:string,message:string>>"), "status": F.lit("ERROR"), "issues": F.array().cast("array<struct<rule:string,field:string,severity:string,message:string>>")})
    edits = spark.createDataFrame([(0, "quantity", "5"), (1, "quantity", "abc"), (2, "quantity", " "), (3, "sku", "b-1"), (0, "day", "2026-01-02")], "record_id long, field string, value string")
    out = {r["record_id"]: r for r in jobs.fix(held, edits, spec, schema, rules, Reference(), datetime.date(2026, 1, 1), "ann").collect()}
    assert set(out) == {0, 1, 2, 3} and out[0]["status"] == "VALID" and out[0]["quantity"] == 5 and out[0]["day"] == datetime.date(2026, 1, 2)
    assert out[1]["status"] == "ERROR" and out[1]["quantity"] is None and out[1]["violations"][0]["message"] == "Quantity: 'abc' is not a valid amount"
    assert out[2]["quantity"] is None and out[3]["sku"] == "b-1" and out[3]["status"] == "ERROR"
    assert out[0]["lineage"] == {"quantity": ["edited by ann"], "day": ["edited by ann"], "sku": ["Item"]} and out[3]["lineage"]["quantity"] == ["Qty"]
    with pytest.raises(model.ConfigError):
        jobs.fix(held, spark.createDataFrame([(0, "colour", "red")], "record_id long, field string, value string"), spec, schema, rules, Reference(), datetime.date(2026, 1, 1))


def test_dismiss_and_replay(spark):
    kind = "array<struct<rule:string,field:string,severity:string,message:string>>"
    df = spark.createDataFrame([(1, "VALID", []), (2, "DEAD_LETTER", []), (3, "DEAD_LETTER", [("R", "f", "ERROR", "m")]), (4, "ERROR", [])], f"record_id long, status string, violations {kind}")
    ids = spark.range(1, 4).select(F.col("id").alias("record_id"))
    assert {r["record_id"]: r["status"] for r in jobs.dismiss(df, ids).collect()} == {1: "DISMISSED", 2: "DISMISSED", 3: "DISMISSED", 4: "ERROR"}
    assert {r["record_id"]: r["status"] for r in jobs.replay(df, ids).collect()} == {1: "VALID", 2: "VALID", 3: "WARNING", 4: "ERROR"}


def test_delivery(spark):
    now = datetime.datetime(2026, 1, 1)
    late = now - datetime.timedelta(hours=1)
    rows = [
        (1, "invoice-line", "K1", "{}", "VALID", now, 0, "P", "s", Decimal(3)), (2, "invoice-line", None, "{}", "WARNING", late, 0, "P", "s", Decimal(4)), (3, "order-line", "K3", "{}", "VALID", late, 4, None, None, None),
        (4, "invoice-line", "K4", "{}", "ERROR", late, 0, "P", "s", Decimal(9)), (5, "invoice-line", "K5", "{}", "VALID", now + datetime.timedelta(days=1), 0, "P", "s", Decimal(9)),
    ]
    box = spark.createDataFrame(rows, "record_id long, schema string, business_key string, payload string, status string, next_attempt_at timestamp, attempts int, poNumber string, sku string, quantity decimal(18,3)")
    keys = spark.createDataFrame([], "dataset string, key string, record_id long")
    po = spark.createDataFrame([("P", "s", Decimal(10))], "poNumber string, sku string, invoicedQty decimal(18,3)")
    calls = []

    def send(schema, payloads, key):
        calls.append((schema, len(payloads), key))
        if schema == "order-line":
            raise OSError("down")

    out, known, po, n = outbox.deliver_due(box, keys, po, F.lit(now), send, outbox.CircuitBreaker(lambda: 0.0))
    assert n == 2 and calls[0] == ("invoice-line", 2, hashlib.sha256(b"2:null,1:K1").hexdigest()) and calls[1][0] == "order-line"
    got = {r["record_id"]: (r["status"], r["attempts"]) for r in out.collect()}
    assert got == {1: ("DELIVERED", 0), 2: ("DELIVERED", 0), 3: ("DEAD_LETTER", 5), 4: ("ERROR", 0), 5: ("VALID", 0)}
    assert [(r["dataset"], r["key"], r["record_id"]) for r in known.collect()] == [("invoiced-lines", "K1", 1)] and po.first()["invoicedQty"] == 17


def test_last_row_of_a_key_counts(spark):
    rows = spark.createDataFrame([("A", "1"), ("a ", "2"), ("B", "3")], "sku string, price string").coalesce(1)
    assert {r["ref_key"]: r["row"]["price"] for r in keyed(rows, "{sku}").collect()} == {"A": "2", "B": "3"}


def test_fast_paths_change_no_value(spark):
    cells = ["12", "1,234.56", "$1,234.56", "-5.5", "₹9", "-$7.25", "1,5", "1.234,56", " 7 ", "1,.5", "(5.00)", "5-", "1,234", "x", "", "5 L", "999999999999", "9999999999999.5", "٣"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {cells[r["i"]]: (r["v"], r["e"]) for r in df.select("i", amounts.amount(F.col("c")).alias("p")).select("i", "p.v", "p.e").collect()}
    want = {"12": "12", "1,234.56": "1234.56", "$1,234.56": "1234.56", "-5.5": "-5.5", "₹9": "9", "-$7.25": "-7.25", "1,5": "1.5", "1.234,56": "1234.56", " 7 ": "7", "1,.5": "1.5", "(5.00)": "-5", "5-": "-5", "1,234": "1234", "5 L": "500000", "999999999999": "999999999999"}
    assert all(got[c][0] == Decimal(v) and got[c][1] is None for c, v in want.items()) and got["x"][1] and got[""] == (None, None) and got["9999999999999.5"][1]
    days = spark.createDataFrame([("05/11/2026",), ("5/11/2026",), ("46286",), ("2026-09-19T00:00:00-05:00",), (" 05/11/2026 ",), ("31/02/2026",)], "d string")
    assert [str(r[0]) for r in days.select(dates.date(F.col("d"), ["dd/MM/yyyy"])["v"]).collect()] == ["2026-11-05", "None", "2026-09-21", "2026-09-19", "2026-11-05", "None"]
    edges = spark.createDataFrame([(c,) for c in ("\u3000a ", "\x1cb\t", "\u00a0c\u00a0", "d")], "c string")
    assert [r[0] for r in edges.select(text.strip(F.col("c"))).collect()] == ["a", "b", "\u00a0c\u00a0", "d"]
    assert [r[0] for r in spark.createDataFrame([(Decimal("100.000000"),), (Decimal("0.000000"),), (Decimal("1.230000"),)], "c decimal(18,6)").select(text.plain(F.col("c"))).collect()] == ["100", "0", "1.23"]


def test_advisor_sees_no_tax_number():
    assert suggest._masked("27AAPFU0939F1ZV due 12") == "[GSTIN] due 99"


def test_small_inputs_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spread = layout.spread(spark.read.parquet(str(tmp_path / "one")))
    assert spread.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread.count() == 100
    many = spark.range(0, 100, 1, 64)
    assert layout.spread(many) is many
