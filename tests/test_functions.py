import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wharfline.functions import amounts, codes, dates, text
from wharfline.plans.model import ConfigError
from wharfline.plans.transforms import Context, Value, apply_transform, compile_transform


def _each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s")).alias("x")).collect()]


def test_amounts(spark):
    cases = {
        "$1,234.50": "1234.50", "₹1,23,456.00": "123456.00", "Rs. 4,500/-": "4500", "12.5 L": "1250000", "1.2 Cr": "12000000", "(1,200.00)": "-1200.00",
        "1,200.00 CR": "-1200.00", "1.234,56": "1234.56", "210.00 USD": "210.00", "12,34": "12.34", "1,234": "1234", "-5": "-5", "5-": "-5", " ": None,
    }
    assert _each(spark, list(cases), lambda c: amounts.parse_amount(c)[0]) == [None if v is None else Decimal(v).quantize(Decimal("0.000001")) for v in cases.values()]
    assert _each(spark, ["12,3x", "", None], lambda c: amounts.parse_amount(c)[1]) == ["'12,3x' is not a valid amount", None, None]


def test_dates(spark):
    day = datetime.date
    assert _each(spark, ["03/09/2026", "31/02/2026"], lambda c: dates.parse_date(c, ["dd/MM/yyyy"])[0]) == [day(2026, 9, 3), None]
    assert _each(spark, ["03/09/2026"], lambda c: dates.parse_date(c, ["MM/dd/yyyy"])[0]) == [day(2026, 3, 9)]
    assert _each(spark, ["2026-09-19T00:00:00-05:00", "46286", "15-SEP-26"], lambda c: dates.parse_date(c)[0]) == [day(2026, 9, 19), day(2026, 9, 21), day(2026, 9, 15)]
    assert _each(spark, ["x"], lambda c: dates.parse_date(c, ["dd/MM/yyyy", "yyyyMMdd"])[1]) == ["'x' does not match date format dd/MM/yyyy or yyyyMMdd"]


def test_inferred_patterns(spark):
    df = spark.createDataFrame([("a", "03/04/2026"), ("a", "25/04/2026"), ("b", "46286"), ("b", None)], "k string, v string")
    found = {r["k"]: r["patterns"] for r in dates.infer_patterns(df, "v", ["k"]).collect()}
    assert found == {"a": ["dd/MM/yyyy", "d/M/yyyy"], "b": ["iso"]}


def test_gstin_and_words(spark):
    assert _each(spark, ["27AAPFU0939F1ZV", "27AAPFU0939F1ZX", "nope"], codes.gstin_valid) == [True, False, False]
    assert _each(spark, [" yes", "0", "maybe"], lambda c: codes.yes_no(c)[0]) == [True, False, None]
    assert round(codes.jaro_winkler("abcdef", "abxyzw"), 4) == 0.6444


def test_text(spark):
    assert _each(spark, ["HEX  BOLT M8X40 ZINC", "bolt of the sea"], text.title) == ["Hex Bolt M8X40 Zinc", "Bolt of the Sea"]
    assert _each(spark, [" N/A ", "--", " x "], text.clean) == [None, None, "x"]
    assert _each(spark, ["Invoice  No.:", "invoiceID", "Inv  No."], text.normalize_key) == ["invoice no", "invoice id", "inv no"]
    assert _each(spark, ["1.500000", "10.000000", "100", "0.120000"], text.plain) == ["1.5", "10", "100", "0.12"]


def test_transforms(spark):
    context = Context({"uom": {"PCS": "EA"}})
    run = lambda e: lambda c: apply_transform(e, Value(c), context).source
    assert _each(spark, [" pcs "], run("trim | upper | lookup(uom)"))[0]["v"] == "EA"
    assert _each(spark, ["zz"], run("lookup(uom)"))[0]["e"] == "'zz' is not a known value in 'uom'"
    assert _each(spark, ["a1-b2"], run("replace('[^0-9]', '')")) == ["12"]
    assert _each(spark, ["00000021800"], run("implied(4)"))[0]["v"] == Decimal("2.180000")
    assert _each(spark, ["a,b"], run("split(',', 1) | prefix('x|')")) == ["x|b"]
    assert _each(spark, ["5"], run("div(0)"))[0]["e"] == "/ by zero"


def test_transform_errors():
    with pytest.raises(ConfigError, match="unknown transform 'nope'"):
        compile_transform("trim | nope")
    with pytest.raises(ConfigError, match="needs argument"):
        compile_transform("left")
