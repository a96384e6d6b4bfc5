"""Queries over the driver's tables, one or more for each operator, with SQL twins.

Line items serve as invoice lines of their suppliers' files, orders as purchase orders, parts as the catalogue,
suppliers as partners, events as jobs' records. Every query reads its whole tables.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import amounts, codes, dates, text
from .operators import edi, jobs, mapping, outbox, pipeline, rules, suggest
from .operators.enrich import enrich
from .operators.reference import Reference, keyed
from .plans import model
from .plans.layout import kept, spread, work_folder
from .plans.transforms import Context, Value, apply_transform
from .ship import ship
from .sources import parsers, reader, splits

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


#: Mapping and rules make generated methods longer than the 8000 bytes that the JVM compiles; beyond this limit Spark splits them instead of having them interpreted.
METHODS = ("spark.sql.codegen.hugeMethodLimit", "8000")


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        if spark.conf.get(METHODS[0], None) is None:
            spark.conf.set(*METHODS)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {n: _shipped(f) for n, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DEC = "decimal(18,6)"
TODAY = datetime.date(2001, 6, 30)
FX = [("USD", Decimal("1")), ("INR", Decimal("0.0114")), ("EUR", Decimal("1.08")), ("GBP", Decimal("1.27"))]


# ---- amounts

def _amount(spark: SparkSession, sf_dir: str, written) -> DataFrame:
    li = spread(_t(spark, sf_dir, "lineitem")).withColumn("_s", written(F.col("l_extendedprice").cast("decimal(18,2)")))
    value, error = amounts.parse_amount(F.col("_s"))
    return li.select("l_orderkey", "l_linenumber", value.cast("double").alias("value"), error.alias("error"))


_AMOUNT_SQL = "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS error FROM lineitem"


@query(_AMOUNT_SQL)
def amount_us(spark, sf_dir):
    return _amount(spark, sf_dir, lambda d: F.concat(F.lit("$"), F.format_number(d, 2)))


@query(_AMOUNT_SQL)
def amount_inr_grouping(spark, sf_dir):
    lakh = lambda d: F.regexp_replace(F.split(d.cast("string"), r"\.")[0], r"(\d)(?=(?:\d{2})*\d{3}$)", "$1,")
    return _amount(spark, sf_dir, lambda d: F.concat(F.lit("Rs. "), lakh(d), F.lit("."), F.split(d.cast("string"), r"\.")[1]))


@query(_AMOUNT_SQL)
def amount_european(spark, sf_dir):
    return _amount(spark, sf_dir, lambda d: F.concat(F.translate(F.format_number(d, 2), ",.", ".,"), F.lit(" EUR")))


@query("""SELECT p_partkey, CAST(p_size * CASE p_partkey % 4 WHEN 0 THEN 100000 WHEN 1 THEN 10000000 WHEN 2 THEN 1000 ELSE 1000000 END AS DOUBLE) AS value FROM part""")
def amount_scale_suffix(spark, sf_dir):
    unit = F.element_at(F.array(F.lit(" L"), F.lit(" Cr"), F.lit("K"), F.lit(" MN")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", amounts.parse_amount(F.concat(F.col("p_size").cast("string"), unit))[0].cast("double").alias("value"))


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS value FROM customer")
def amount_credit_paren(spark, sf_dir):
    d = F.col("c_acctbal").cast("decimal(18,2)")
    size = F.format_number(F.abs(d), 2)
    marked = F.when(d >= 0, size).when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("("), size, F.lit(")"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.translate(size, ",", ""), F.lit("-"))).otherwise(F.concat(F.lit("-"), size))
    return _t(spark, sf_dir, "customer").select("c_custkey", amounts.parse_amount(marked)[0].cast("double").alias("value"))


@query("SELECT p_partkey, '''' || trim(p_name) || ''' is not a valid amount' AS error FROM part")
def amount_invalid(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", amounts.parse_amount(F.col("p_name"))[1].alias("error"))


# ---- dates

_PATTERNS = ["dd/MM/yyyy", "MM-dd-yyyy", "dd-MMM-yyyy", "yyyyMMdd", "MMM d, yyyy"]


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_patterns(spark, sf_dir):
    out = F.lit(None).cast("date")
    for i, p in enumerate(_PATTERNS):
        out = F.when(F.col("o_orderkey") % len(_PATTERNS) == i, dates.parse_date(F.date_format("o_orderdate", p), [p])[0]).otherwise(out)
    return _t(spark, sf_dir, "orders").select("o_orderkey", out.cast("string").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_excel_serial(spark, sf_dir):
    serial = F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date")).cast("string")
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(serial)[0].cast("string").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_iso_offset(spark, sf_dir):
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:30:00-05:00"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(stamp)[0].cast("string").alias("day"))


_ODD_DAY = "lpad(CAST(25 + l_linenumber AS VARCHAR), 2, '0') || '/' || lpad(CAST(l_orderkey % 14 AS VARCHAR), 2, '0') || '/2023'"


@query(f"""SELECT l_orderkey, l_linenumber, strftime(try_strptime(s, '%d/%m/%Y'), '%Y-%m-%d') AS day,
  CASE WHEN try_strptime(s, '%d/%m/%Y') IS NULL THEN '''' || s || ''' does not match date format dd/MM/yyyy' END AS error FROM (SELECT *, {_ODD_DAY} AS s FROM lineitem)""")
def date_strict_reject(spark, sf_dir):
    s = F.concat(F.lpad((25 + F.col("l_linenumber")).cast("string"), 2, "0"), F.lit("/"), F.lpad((F.col("l_orderkey") % 14).cast("string"), 2, "0"), F.lit("/2023"))
    value, error = dates.parse_date(s, ["dd/MM/yyyy"])
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.cast("string").alias("day"), error.alias("error"))


@query()
def date_pattern_inference(spark, sf_dir):
    shown = F.lit(None).cast("string")
    for i, p in enumerate(_PATTERNS):
        shown = F.when(F.col("o_custkey") % len(_PATTERNS) == i, F.date_format("o_orderdate", p)).otherwise(shown)
    df = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % len(_PATTERNS)).alias("layout"), shown.alias("value"))
    return dates.infer_patterns(df, "value", ["layout"]).select("layout", F.array_join("patterns", ",").alias("patterns"))


# ---- the transform language, one query for each function

_CONTEXT = Context({"uom": {"PCS": "EA", "NOS": "EA", "KGS": "KG", "BOXES": "BOX"}, "segment": {"BUILDING": "B", "AUTOMOBILE": "A"}})
_D = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS {})".format
#: (query, table, key, input, transform, SQL)
_TRANSFORMS = [
    ("fn_trim", "part", "p_partkey", lambda: F.concat(F.lit(" \t"), F.col("p_name"), F.lit("  ")), "trim", "trim(p_name)"),
    ("fn_upper", "part", "p_partkey", lambda: F.col("p_name"), "upper", "upper(p_name)"),
    ("fn_lower", "part", "p_partkey", lambda: F.col("p_type"), "lower", "lower(p_type)"),
    ("fn_collapse", "part", "p_partkey", lambda: F.regexp_replace("p_name", " ", "  \n "), "collapse", r"trim(regexp_replace(p_name, '\s+', ' ', 'g'))"),
    ("fn_title", "part", "p_partkey", lambda: F.concat(F.upper("p_name"), F.lit(" OF M8X40")), "title",
     "list_aggregate(list_transform(string_split(lower(trim(p_name)), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || ' of M8X40'"),
    ("fn_digits", "part", "p_partkey", lambda: F.col("p_brand"), "digits", r"regexp_replace(p_brand, '\D', '', 'g')"),
    ("fn_alnum", "part", "p_partkey", lambda: F.col("p_brand"), "alnum", "regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')"),
    ("fn_nullif", "customer", "c_custkey", lambda: F.col("c_mktsegment"), "nullif(building, MACHINERY)", "CASE WHEN upper(c_mktsegment) IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END"),
    ("fn_default", "customer", "c_custkey", lambda: F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("  "), "default('none, yet')", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none, yet' END"),
    ("fn_prefix", "part", "p_partkey", lambda: F.col("p_brand"), "prefix('P|')", "'P|' || p_brand"),
    ("fn_suffix", "part", "p_partkey", lambda: F.col("p_brand"), "suffix(\"-x\")", "p_brand || '-x'"),
    ("fn_replace", "part", "p_partkey", lambda: F.col("p_brand"), "replace('([A-Za-z]+)#', '$1_')", r"regexp_replace(p_brand, '([A-Za-z]+)#', '\1_', 'g')"),
    ("fn_extract", "part", "p_partkey", lambda: F.col("p_brand"), r"extract('#(1\d)')", r"CASE WHEN regexp_matches(p_brand, '#(1\d)') THEN regexp_extract(p_brand, '#(1\d)', 1) END"),
    ("fn_left", "part", "p_partkey", lambda: F.col("p_name"), "left(4)", "left(p_name, 4)"),
    ("fn_right", "part", "p_partkey", lambda: F.col("p_name"), "right(5)", "right(p_name, 5)"),
    ("fn_split", "part", "p_partkey", lambda: F.col("p_type"), "split(' ', -1)", "string_split(p_type, ' ')[-1]"),
    ("fn_round", "customer", "c_custkey", lambda: F.col("c_acctbal").cast("decimal(18,2)").cast("string"), "number | round(1)", "CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE)"),
    ("fn_mul", "customer", "c_custkey", lambda: F.col("c_acctbal").cast("decimal(18,2)").cast("string"), "amount | mul(3)", "CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 3 AS DOUBLE)"),
    ("fn_div", "customer", "c_custkey", lambda: F.col("c_acctbal").cast("decimal(18,2)").cast("string"), "amount | div(8)", "CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 0.125 AS DOUBLE)"),
    ("fn_implied", "orders", "o_orderkey", lambda: F.lpad((F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("long").cast("string"), 12, "0"), "implied(2)", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)"),
    ("fn_currency", "customer", "c_custkey", lambda: F.element_at(F.array(F.lit("Rs."), F.lit("us$"), F.lit("chf"), F.lit("€")), (F.col("c_custkey") % 4 + 1).cast("int")), "currency", "['INR', 'USD', 'CHF', 'EUR'][c_custkey % 4 + 1]"),
    ("fn_lookup", "customer", "c_custkey", lambda: F.lower("c_mktsegment"), "lookup(segment, *)", "CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'AUTOMOBILE' THEN 'A' ELSE lower(c_mktsegment) END"),
    ("fn_bool", "customer", "c_custkey", lambda: F.element_at(F.array(F.lit(" yes"), F.lit("n"), F.lit("0"), F.lit("T")), (F.col("c_custkey") % 4 + 1).cast("int")), "bool", "[true, false, false, true][c_custkey % 4 + 1]"),
]


def _transform_query(table: str, key: str, source, expression: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = apply_transform(expression, Value(source()), _CONTEXT)
        shown = v.column.cast("double") if v.kind == "decimal" else v.column
        return _t(spark, sf_dir, table).select(key, shown.alias("value"))

    return run


for _name, _table, _key, _source, _expression, _sql in _TRANSFORMS:
    query(f"SELECT {_key}, {_sql} AS value FROM {_table}", _name)(_transform_query(_table, _key, _source, _expression))


@query("SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9#]+', ' ', 'g')) AS value FROM part")
def normalize_key(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.normalize_key(F.upper("p_brand")).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_name END AS value FROM customer")
def clean_null_tokens(spark, sf_dir):
    s = F.element_at(F.array(F.lit(" n/a "), F.lit("--"), F.lit("null"), F.concat(F.lit(" "), "c_name", F.lit(" "))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.clean(s).alias("value"))


@query("SELECT p_partkey, p_name AS value FROM part")
def header_clean(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.clean_header(F.concat(F.lit("  "), "p_name", F.lit(" .: "))).alias("value"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b', '[GSTIN]', 'g'), '[0-9]', '9', 'g')) AS masked_sha FROM documents")
def mask_pii(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.sha256(text.mask_pii(F.col("text"))).alias("masked_sha"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256_content(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.sha256(F.col("text")).alias("sha"))


_GST14 = "lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || 'AAP' || chr(CAST(65 + c_custkey % 26 AS INTEGER)) || 'U' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'F1Z'"


@query(f"""WITH g AS (SELECT c_custkey, {_GST14} AS g FROM customer),
p AS (SELECT c_custkey, g, list_transform(range(1, 15), lambda i: (instr('{codes.CHARSET}', g[i]) - 1) * CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END) AS ps FROM g)
SELECT c_custkey, g, ('{codes.CHARSET}')[CAST((36 - list_sum(list_transform(ps, lambda x: x // 36 + x % 36)) % 36) % 36 AS INTEGER) + 1] AS check_char FROM p""")
def gstin_check_char(spark, sf_dir):
    g = F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lit("AAP"), F.char(65 + F.col("c_custkey") % 26), F.lit("U"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F1Z"))
    return _t(spark, sf_dir, "customer").select("c_custkey", g.alias("g"), codes.gstin_check_char(g).alias("check_char"))


@query("SELECT s_suppkey, jaro_winkler_similarity(s_name, reverse(s_name)) AS score FROM supplier")
def jaro_winkler(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    return s.select("s_suppkey", codes.jaro_winkler_column(F.col("s_name"), F.reverse("s_name")).alias("score"))


# ---- invoice lines: mapping, enrichment, rules

SCHEMA = model.load_schema({
    "name": "invoice-line", "label": "Invoice line", "businessKey": ["supplierId", "invoiceNumber", "lineNumber"],
    "fields": [
        {"name": "supplierId", "required": True, "label": "Supplier"}, {"name": "invoiceNumber", "required": True, "label": "Invoice number", "aliases": ["Inv No"]},
        {"name": "invoiceDate", "type": "DATE", "required": True, "label": "Invoice date"}, {"name": "lineNumber", "type": "INTEGER", "required": True, "label": "Line number"},
        {"name": "sku", "required": True, "label": "SKU", "aliases": ["Item Code"]}, {"name": "description", "label": "Description"},
        {"name": "quantity", "type": "DECIMAL", "required": True, "label": "Quantity", "kinds": ["DECIMAL", "INTEGER"]}, {"name": "unitPrice", "type": "DECIMAL", "label": "Unit price", "kinds": ["AMOUNT"]},
        {"name": "lineAmount", "type": "DECIMAL", "required": True, "label": "Line amount", "kinds": ["AMOUNT"]}, {"name": "taxAmount", "type": "DECIMAL", "label": "Tax amount", "kinds": ["AMOUNT"]},
        {"name": "currency", "required": True, "label": "Currency", "kinds": ["CURRENCY"]}, {"name": "returnFlag", "label": "Return flag"},
        {"name": "lineAmountUsd", "type": "DECIMAL", "label": "Line amount USD", "derived": True},
    ],
})
SPEC = model.load_spec({
    "partnerId": "DRIVER", "schema": "invoice-line", "format": "CSV",
    "fields": [
        {"target": "supplierId", "source": "Vendor"}, {"target": "invoiceNumber", "source": "inv no"}, {"target": "invoiceDate", "source": "Inv Dt", "transform": "date('dd/MM/yyyy')"},
        {"target": "lineNumber", "source": "Line"}, {"target": "sku", "source": "Item Code", "transform": "trim | upper"},
        {"target": "description", "sources": ["Flag", "Status"], "join": "/"}, {"target": "quantity", "source": "Qty", "transform": "number"},
        {"target": "lineAmount", "source": "Amt", "transform": "amount"}, {"target": "taxAmount", "sources": ["CGST", "SGST"], "join": "+"},
        {"target": "currency", "source": "Ccy", "transform": "currency"}, {"target": "returnFlag", "const": " fixed ", "transform": "trim"},
    ],
    "enrich": [
        {"compute": {"target": "unitPrice", "left": "lineAmount", "op": "/", "right": "quantity"}},
        {"lookup": {"dataset": "catalog", "key": "{sku}", "copy": {"description": "description"}}},
        {"convert": {"amount": "lineAmount", "currency": "currency", "target": "lineAmountUsd", "base": "USD"}},
    ],
})
RULES = model.load_rules({"rules": [
    {"id": "REQ", "type": "required", "field": "taxAmount", "severity": "WARNING"},
    {"id": "SKU", "type": "matches", "field": "sku", "regex": "[0-9]{1,3}", "message": "SKU must be short", "severity": "WARNING"},
    {"id": "QTY", "type": "range", "field": "quantity", "min": 2, "max": 48},
    {"id": "DATE", "type": "datewindow", "field": "invoiceDate", "maxPastDays": 2000, "maxFutureDays": 5, "severity": "WARNING"},
    {"id": "CCY", "type": "oneof", "field": "currency", "allowed": ["usd", "inr", "eur"]},
    {"id": "DUP", "type": "unique", "fields": ["invoiceNumber", "lineNumber"]},
    {"id": "MATH", "type": "arithmetic", "field": "lineAmount", "left": "quantity", "op": "*", "right": "unitPrice", "tolerance": 0.05, "tolerancePct": 0.0001},
    {"id": "PRICE", "type": "reference", "dataset": "catalog", "key": "{sku}", "message": "not in the catalogue",
     "checks": [{"type": "withinPct", "field": "unitPrice", "refField": "listPrice", "label": "list price", "warnPct": 50, "errorPct": 150},
                {"type": "atMost", "field": "quantity", "refField": "orderedQty", "minus": "invoicedQty", "tolerancePct": 5, "severity": "WARNING"},
                {"type": "equals", "field": "description", "refField": "description", "label": "name", "severity": "WARNING"}]},
    {"id": "KNOWN", "type": "reference", "dataset": "invoiced-lines", "key": "{invoiceNumber}|{lineNumber}", "mustExist": False, "message": "already invoiced", "severity": "WARNING"},
    {"id": "WHEN", "type": "when", "field": "currency", "in": ["INR"], "then": [{"id": "INRMAX", "type": "range", "field": "lineAmount", "max": 50000}]},
]})


def invoice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a table of raw text, with cells as columns, one file for each supplier; the order within a file is by part."""
    li = spread(_t(spark, sf_dir, "lineitem"))
    money = lambda c: F.format_number(F.col(c).cast("decimal(18,2)"), 2)
    tax = (F.col("l_tax").cast("decimal(18,2)") * 50).cast("string")
    fields = {
        "Vendor": F.concat(F.lit(" S"), F.col("l_suppkey").cast("string")), "Inv  No.": F.col("l_orderkey").cast("string"), "Inv Dt": F.date_format("l_shipdate", "dd/MM/yyyy"),
        "Line": F.when(F.col("l_orderkey") % 50 == 0, F.concat(F.col("l_linenumber").cast("string"), F.lit(".5"))).otherwise(F.col("l_linenumber").cast("string")),
        "Item Code": F.when(F.col("l_orderkey") % 40 == 7, "N/A").otherwise(F.col("l_partkey").cast("string")), "Flag": F.when(F.col("l_returnflag") == "N", "-").otherwise(F.col("l_returnflag")), "Status": F.col("l_linestatus"),
        "Qty": F.col("l_quantity").cast("int").cast("string"), "Amt": money("l_extendedprice"), "CGST": F.when(F.col("l_linenumber") == 1, "NA").otherwise(tax), "SGST": F.when(F.col("l_linenumber") < 3, "").otherwise(tax),
        "Ccy": F.element_at(F.array(F.lit("US$"), F.lit("Rs"), F.lit("gbp"), F.lit("jpy")), (F.col("l_orderkey") % 4 + 1).cast("int")),
    }
    return li.select(F.col("l_suppkey").cast("string").alias("file_id"), F.col("l_partkey").alias("seq"), F.col("l_linenumber").cast("long").alias("line"), *[v.alias(mapping.CELL + k) for k, v in fields.items()])


COLUMNS = ["Vendor", "Inv  No.", "Inv Dt", "Line", "Item Code", "Flag", "Status", "Qty", "Amt", "CGST", "SGST", "Ccy"]


def invoice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`invoice_table` as records with a map of cells."""
    pairs = F.create_map(*[x for k in COLUMNS for x in (F.lit(k), F.col(f"`{mapping.CELL}{k}`"))])
    return invoice_table(spark, sf_dir).select("file_id", "seq", "line", pairs.alias("fields"), F.array(*[F.lit(k) for k in COLUMNS]).alias("columns"))


def invoice_reference(spark: SparkSession, sf_dir: str) -> Reference:
    part = _t(spark, sf_dir, "part").where("p_partkey % 10 <> 3").select(
        F.col("p_partkey").cast("string").alias("sku"), F.col("p_name").alias("description"), F.col("p_retailprice").cast(DEC).alias("listPrice"),
        F.lit(40).cast(DEC).alias("orderedQty"), (F.col("p_size") % 7).cast(DEC).alias("invoicedQty"),
    )
    seen = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("invoiceNumber"), F.lit("1").alias("lineNumber"))
    # a literal table has a size that Spark knows; rows of an RDD have none, so records would be sorted and merged by their few currencies
    fx = spark.sql("SELECT currency, CAST(rate AS DECIMAL(18,8)) AS rate FROM VALUES " + ", ".join(f"('{c}', {r})" for c, r in FX) + " AS t(currency, rate)")
    return Reference({"catalog": keyed(part, "{sku}"), "invoiced-lines": keyed(seen, "{invoiceNumber}|{lineNumber}"), "fx": keyed(fx, "{currency}")})


def mapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_records(invoice_table(spark, sf_dir), SPEC, SCHEMA, _CONTEXT, COLUMNS)


def enriched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(mapped_lines(spark, sf_dir), SPEC.enrich, SCHEMA, invoice_reference(spark, sf_dir))


def outcomes(spark: SparkSession, sf_dir: str, only: tuple[str, ...] = ()) -> DataFrame:
    picked = [r for r in RULES if not only or r.id in only]
    return pipeline.run(invoice_table(spark, sf_dir), SPEC, SCHEMA, picked, invoice_reference(spark, sf_dir), _CONTEXT, TODAY, COLUMNS)


def _plain(x: str) -> str:
    return f"(CASE WHEN contains(CAST({x} AS VARCHAR), '.') THEN rtrim(rtrim(CAST({x} AS VARCHAR), '0'), '.') ELSE CAST({x} AS VARCHAR) END)"


#: The invoice lines as typed values, written once more in SQL.
_M = """m AS (SELECT CAST(l_suppkey AS VARCHAR) AS file_id, l_partkey AS seq, CAST(l_linenumber AS BIGINT) AS line, 'S' || l_suppkey AS supplierId, CAST(l_orderkey AS VARCHAR) AS invoiceNumber,
 CAST(l_shipdate AS DATE) AS invoiceDate, CASE WHEN l_orderkey % 50 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS lineNumber, CASE WHEN l_orderkey % 40 <> 7 THEN CAST(l_partkey AS VARCHAR) END AS sku,
 CASE WHEN l_returnflag = 'N' THEN l_linestatus ELSE l_returnflag || '/' || l_linestatus END AS description, CAST(CAST(l_quantity AS INTEGER) AS DECIMAL(18,6)) AS quantity,
 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,6)) AS lineAmount,
 CAST(CAST(l_tax AS DECIMAL(18,2)) * 50 * CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber < 3 THEN 1 ELSE 2 END AS DECIMAL(18,6)) AS taxAmount,
 ['USD', 'INR', 'GBP', 'JPY'][l_orderkey % 4 + 1] AS currency, l_orderkey, l_linenumber FROM lineitem)"""
_E = _M + """, c AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name, CAST(p_retailprice AS DECIMAL(18,6)) AS listPrice, CAST(40 - p_size % 7 AS DECIMAL(18,6)) AS open FROM part WHERE p_partkey % 10 <> 3),
 e AS (SELECT m.*, c.p_name, c.listPrice, c.open, c.sku IS NOT NULL AS found, CAST(CAST((2 * CAST(lineAmount * 100 AS BIGINT) + CAST(quantity AS BIGINT)) // (2 * CAST(quantity AS BIGINT)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,6)) AS unitPrice,
 CASE currency WHEN 'USD' THEN lineAmount WHEN 'INR' THEN CAST(round(lineAmount * 0.0114, 2) AS DECIMAL(18,6)) WHEN 'GBP' THEN CAST(round(lineAmount * 1.27, 2) AS DECIMAL(18,6)) END AS lineAmountUsd
 FROM m LEFT JOIN c ON m.sku = c.sku)"""


@query(f"WITH {_M} SELECT invoiceNumber, line, description FROM m")
def map_concat(spark, sf_dir):
    return mapped_lines(spark, sf_dir).select("invoiceNumber", "line", "description")


@query(f"WITH {_M} SELECT invoiceNumber, line, CAST(taxAmount AS DOUBLE) AS tax FROM m")
def map_sum_join(spark, sf_dir):
    return mapped_lines(spark, sf_dir).select("invoiceNumber", "line", F.col("taxAmount").cast("double").alias("tax"))


@query(f"WITH {_M} SELECT invoiceNumber, line, 'fixed' AS flag, 'const' AS source FROM m")
def map_constant(spark, sf_dir):
    return mapped_lines(spark, sf_dir).select("invoiceNumber", "line", F.col("returnFlag").alias("flag"), F.array_join(F.col("lineage")["returnFlag"], ",").alias("source"))


@query(f"WITH {_M} SELECT invoiceNumber, line, 'CGST,SGST' AS tax_from, 'Inv  No.' AS number_from FROM m")
def map_lineage(spark, sf_dir):
    return mapped_lines(spark, sf_dir).select("invoiceNumber", "line", F.array_join(F.col("lineage")["taxAmount"], ",").alias("tax_from"), F.array_join(F.col("lineage")["invoiceNumber"], ",").alias("number_from"))


@query(f"WITH {_M} SELECT invoiceNumber, line, 'MAPPING' AS rule, 'lineNumber' AS field, 'Line number: ''' || l_linenumber || '.5'' is not a whole number' AS message FROM m WHERE l_orderkey % 50 = 0")
def coercion_errors(spark, sf_dir):
    return rules.violations(mapped_lines(spark, sf_dir), "invoiceNumber", "line", of="issues").select("invoiceNumber", "line", "v.rule", "v.field", "v.message")


@query(f"WITH {_M} SELECT l_orderkey, supplierId || '|' || invoiceNumber || '|' || lineNumber AS business_key FROM m")
def business_key(spark, sf_dir):
    return mapped_lines(spark, sf_dir).select(F.col("invoiceNumber").cast("long").alias("l_orderkey"), mapping.business_key(SCHEMA).alias("business_key"))


@query(f"WITH {_M} SELECT invoiceNumber, line, 'q=' || {_plain('quantity')} || '/' || sku AS key FROM m")
def key_template_null(spark, sf_dir):
    return mapped_lines(spark, sf_dir).select("invoiceNumber", "line", mapping.render("q={quantity}/{sku}", SCHEMA).alias("key"))


@query(f"WITH {_E} SELECT invoiceNumber, line, CASE WHEN l_orderkey % 3 > 0 THEN description WHEN found THEN p_name END AS kept, l_orderkey % 3 = 0 AND found AS taken FROM e")
def enrich_lookup_onlyifblank(spark, sf_dir):
    third = F.col("invoiceNumber").cast("long") % 3 == 0
    blank = mapped_lines(spark, sf_dir).withColumn("description", F.when(third & (F.col("line") % 2 == 0), " ").when(~third, F.col("description")))
    out = enrich(blank, (model.Lookup("catalog", "{sku}", {"description": "description"}, True),), SCHEMA, invoice_reference(spark, sf_dir))
    return out.select("invoiceNumber", "line", F.when(F.trim("description") != "", F.col("description")).alias("kept"), (F.array_join(F.col("lineage")["description"], ",") == "catalog.description").alias("taken"))


@query(f"WITH {_E} SELECT invoiceNumber, line, CASE WHEN found THEN p_name ELSE description END AS description, CASE WHEN found THEN 'catalog.description' END AS source FROM e")
def enrich_lookup_overwrite(spark, sf_dir):
    step = model.Lookup("catalog", "{sku}", {"description": "description"}, False)
    out = enrich(mapped_lines(spark, sf_dir), (step,), SCHEMA, invoice_reference(spark, sf_dir))
    traced = F.array_join(F.col("lineage")["description"], ",")
    return out.select("invoiceNumber", "line", "description", F.when(traced == "catalog.description", traced).alias("source"))


@query(f"""WITH {_E} SELECT invoiceNumber, line, CAST(lineAmountUsd AS DOUBLE) AS usd, CASE WHEN currency = 'JPY' THEN 'no FX rate for JPY to USD' END AS issue FROM e""")
def enrich_convert_fx(spark, sf_dir):
    fx = F.filter("issues", lambda i: i["rule"] == "FX_RATE")
    return enriched_lines(spark, sf_dir).select("invoiceNumber", "line", F.col("lineAmountUsd").cast("double").alias("usd"), F.get(fx, F.lit(0))["message"].alias("issue"))


@query(f"WITH {_M} SELECT invoiceNumber, line, CAST(CAST(lineAmount AS DECIMAL(18,2)) * CAST(quantity AS INTEGER) AS DOUBLE) AS made FROM m")
def enrich_compute(spark, sf_dir):
    step = model.Compute("unitPrice", "lineAmount", "*", "quantity")
    out = enrich(mapped_lines(spark, sf_dir), (step,), SCHEMA, Reference())
    return out.select("invoiceNumber", "line", F.col("unitPrice").cast("double").alias("made"))


def _violations(*ids: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.violations(outcomes(spark, sf_dir, ids), "invoiceNumber", "line").where(F.col("v.rule").isin(*ids, "INRMAX"))
        return found.select("invoiceNumber", "line", "v.rule", "v.field", "v.severity", "v.message")

    return run


def _rule(name: str, rule: str, field: str, severity: str, message: str, where: str, ids: tuple[str, ...] = ()) -> None:
    sql = f"WITH {_E} SELECT invoiceNumber, line, '{rule}' AS rule, '{field}' AS field, {severity} AS severity, {message} AS message FROM e WHERE {where}"
    query(sql, name)(_violations(*(ids or (rule,))))


_rule("rule_required", "REQ", "taxAmount", "'WARNING'", "'taxAmount is missing'", "taxAmount IS NULL")
_rule("rule_matches", "SKU", "sku", "'WARNING'", "'SKU must be short (got ''' || sku || ''')'", "length(sku) > 3")
_rule("rule_range", "QTY", "quantity", "'ERROR'", f"'quantity ' || {_plain('quantity')} || ' is outside 2 to 48'", "quantity < 2 OR quantity > 48")
_rule("rule_date_window", "DATE", "invoiceDate", "'WARNING'",
      "CASE WHEN invoiceDate > DATE '2001-07-05' THEN 'invoiceDate ' || invoiceDate || ' is in the future' ELSE 'invoiceDate ' || invoiceDate || ' is more than 2000 days old' END",
      "invoiceDate > DATE '2001-07-05' OR invoiceDate < DATE '2001-06-30' - INTERVAL 2000 DAY")
_rule("rule_one_of", "CCY", "currency", "'ERROR'", "'currency ''' || currency || ''' is not one of usd, inr, eur'", "currency NOT IN ('USD', 'INR', 'EUR')")
_rule("rule_arithmetic", "MATH", "lineAmount", "'ERROR'",
      f"'lineAmount ' || {_plain('lineAmount')} || ' does not equal quantity * unitPrice = ' || {_plain('round(quantity * unitPrice, 2)')}",
      "abs(lineAmount - quantity * unitPrice) > greatest(0.05, round(quantity * unitPrice * 0.000001, 6))")
_rule("rule_when", "INRMAX", "lineAmount", "'ERROR'", f"'lineAmount ' || {_plain('lineAmount')} || ' is outside ∞ to 50000'", "currency = 'INR' AND lineAmount > 50000", ("WHEN",))


@query(f"""WITH {_M}, f AS (SELECT file_id, invoiceNumber, lineNumber, min(seq) AS s, arg_min(line, seq * 100 + line) AS first FROM m WHERE lineNumber IS NOT NULL GROUP BY ALL)
SELECT m.invoiceNumber, m.line, 'DUP' AS rule, 'invoiceNumber' AS field, 'ERROR' AS severity, 'duplicate of line ' || first || ' (invoiceNumber + lineNumber)' AS message
FROM m JOIN f USING (file_id, invoiceNumber, lineNumber) WHERE seq > s""")
def rule_unique(spark, sf_dir):
    return _violations("DUP")(spark, sf_dir)


_OFF = "CAST(round(abs(CAST(unitPrice AS DOUBLE) - CAST(listPrice AS DOUBLE)) * 100 / CAST(listPrice AS DOUBLE), 2) AS DECIMAL(18,6))"


@query(f"""WITH {_E}, o AS (SELECT *, {_OFF} AS off FROM e WHERE found)
SELECT invoiceNumber, line, CASE WHEN off > 150 THEN 'ERROR' WHEN off > 50 THEN 'WARNING' END AS band, count(*) AS n FROM o GROUP BY ALL""")
def price_variance_bands(spark, sf_dir):
    of = lambda field: F.filter("violations", lambda v: (v["rule"] == "PRICE") & (v["field"] == field))
    row = outcomes(spark, sf_dir, ("PRICE",)).select("invoiceNumber", "line", F.get(of("unitPrice"), F.lit(0))["severity"].alias("band"), (F.col("sku").isNotNull() & (F.size(of("sku")) == 0)).alias("known"))
    # counted, not filtered first: a filter would be pushed below the rules, which would then be worked out twice
    return row.groupBy("invoiceNumber", "line", "band").agg(F.count_if("known").alias("n")).where("n > 0")


@query(f"""WITH {_E} SELECT invoiceNumber, line, 'quantity ' || {_plain('quantity')} || ' exceeds catalog open quantity ' || {_plain('open')} || ' (+5% tolerance)' AS message
FROM e WHERE found AND quantity > round(open * 1.05, 6)""")
def open_quantity_atmost(spark, sf_dir):
    found = rules.violations(outcomes(spark, sf_dir, ("PRICE",)), "invoiceNumber", "line").where("v.rule = 'PRICE' and v.field = 'quantity'")
    return found.select("invoiceNumber", "line", "v.message")


@query(f"""WITH {_E} SELECT invoiceNumber, line, 'description ''' || description || ''' does not match name ''' || p_name || '''' AS message FROM e WHERE found AND upper(description) <> upper(p_name)""")
def rule_reference_equals(spark, sf_dir):
    found = rules.violations(outcomes(spark, sf_dir, ("PRICE",)), "invoiceNumber", "line").where("v.rule = 'PRICE' and v.field = 'description'")
    return found.select("invoiceNumber", "line", "v.message")


@query(f"WITH {_E} SELECT invoiceNumber, line, 'not in the catalogue (' || sku || ')' AS message FROM e WHERE sku IS NOT NULL AND NOT found")
def po_missing_anti(spark, sf_dir):
    found = rules.violations(outcomes(spark, sf_dir, ("PRICE",)), "invoiceNumber", "line").where("v.rule = 'PRICE' and v.field = 'sku'")
    return found.select("invoiceNumber", "line", "v.message")


@query(f"""WITH {_E} SELECT invoiceNumber, line, 'already invoiced (' || invoiceNumber || '|' || lineNumber || ')' AS message FROM e
WHERE lineNumber = 1 AND EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderkey AS VARCHAR) = invoiceNumber AND o_orderstatus = 'F')""")
def already_invoiced_semi(spark, sf_dir):
    found = rules.violations(outcomes(spark, sf_dir, ("KNOWN",)), "invoiceNumber", "line").where("v.rule = 'KNOWN'")
    return found.select("invoiceNumber", "line", "v.message")


@query(f"""WITH b AS (SELECT c_custkey, {_GST14} AS b FROM customer),
p AS (SELECT c_custkey, b, list_transform(range(1, 15), lambda i: (instr('{codes.CHARSET}', b[i]) - 1) * CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END) AS ps FROM b),
c AS (SELECT c_custkey, b, ('{codes.CHARSET}')[CAST((36 - list_sum(list_transform(ps, lambda x: x // 36 + x % 36)) % 36) % 36 AS INTEGER) + 1] AS digit FROM p),
g AS (SELECT c_custkey, b || CASE c_custkey % 3 WHEN 0 THEN digit WHEN 1 THEN '#' ELSE CASE WHEN digit = 'A' THEN 'B' ELSE 'A' END END AS g FROM c)
SELECT c_custkey, 'GSTIN ' || chr(39) || g || chr(39) || ' is invalid (' || CASE c_custkey % 3 WHEN 1 THEN 'wrong format' ELSE 'check digit does not match' END || ')' AS message FROM g WHERE c_custkey % 3 > 0""")
def rule_gstin(spark, sf_dir):
    schema = model.load_schema({"name": "party", "fields": [{"name": "gstin"}]})
    g = F.concat(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"), F.lit("AAP"), F.char(65 + F.col("c_custkey") % 26), F.lit("U"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("F1Z"))
    digit, kind = codes.gstin_check_char(g), F.col("c_custkey") % 3
    last = F.when(kind == 0, digit).when(kind == 1, "#").otherwise(F.when(digit == "A", "B").otherwise("A"))
    rows = _t(spark, sf_dir, "customer").select(F.lit("f").alias("file_id"), F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("line"), F.concat(g, last).alias("gstin"), mapping.none_yet().alias("issues"))
    out = rules.validate(rows, model.load_rules({"rules": [{"id": "G", "type": "gstin", "field": "gstin"}]}), schema, Reference(), TODAY)
    return rules.violations(out, F.col("line").alias("c_custkey")).select("c_custkey", "v.message")


_STATUS = f"""{_E}, s AS (SELECT *, CASE WHEN l_orderkey % 50 = 0 OR quantity < 2 OR quantity > 48 OR currency NOT IN ('USD', 'INR', 'EUR') THEN 'ERROR'
 WHEN taxAmount IS NULL OR length(sku) > 3 THEN 'WARNING' ELSE 'VALID' END AS status FROM e)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir, ("REQ", "SKU", "QTY", "CCY"))


@query(f"WITH {_STATUS} SELECT invoiceNumber, line, status, count(*) AS n FROM s GROUP BY ALL")
def status_rollup(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("invoiceNumber", "line", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_STATUS} SELECT file_id, count(*) AS total, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'WARNING') AS warnings,
 count(*) FILTER (status = 'ERROR') AS errors, count(*) FILTER (status = 'ERROR') / count(*) AS error_rate FROM s GROUP BY file_id""")
def file_summary(spark, sf_dir):
    return pipeline.file_summary(_judged(spark, sf_dir))


#: The deviation from the list price in hundredths of a percent, rounded half up in whole numbers.
_EXACT_OFF = "CAST((20000 * CAST(abs(unitPrice - listPrice) * 100 AS BIGINT) + CAST(listPrice * 100 AS BIGINT)) // (2 * CAST(listPrice * 100 AS BIGINT)) AS DECIMAL(18,0)) * 0.01"


def _all_rules_sql() -> str:
    """Every violation of a run with the whole rule set: the twins of the single rules, side by side."""
    named = lambda name, rule, field, severity: f"SELECT invoiceNumber, line, '{rule}' AS rule, '{field}' AS field, '{severity}' AS severity, message FROM ({_SQL[name]})"
    whole = [f"SELECT invoiceNumber, line, rule, field, severity, message FROM ({_SQL[n]})" for n in ("rule_required", "rule_matches", "rule_range", "rule_date_window", "rule_one_of", "rule_arithmetic", "rule_when", "rule_unique")]
    bands = f"""WITH {_E}, o AS (SELECT *, CAST({_EXACT_OFF} AS DECIMAL(18,6)) AS off FROM e WHERE found)
SELECT invoiceNumber, line, 'PRICE' AS rule, 'unitPrice' AS field, CASE WHEN off > 150 THEN 'ERROR' ELSE 'WARNING' END AS severity,
 'unitPrice ' || {_plain('unitPrice')} || ' is ' || {_plain('off')} || '% ' || CASE WHEN unitPrice > listPrice THEN 'above' ELSE 'below' END || ' list price ' || {_plain('listPrice')} AS message FROM o WHERE off > 50"""
    other = [
        named("coercion_errors", "MAPPING", "lineNumber", "ERROR"), named("po_missing_anti", "PRICE", "sku", "ERROR"), named("open_quantity_atmost", "PRICE", "quantity", "WARNING"),
        named("rule_reference_equals", "PRICE", "description", "WARNING"), named("already_invoiced_semi", "KNOWN", "invoiceNumber", "WARNING"), f"SELECT * FROM ({bands})",
        f"SELECT invoiceNumber, line, 'FX_RATE' AS rule, 'lineAmountUsd' AS field, 'WARNING' AS severity, issue AS message FROM ({_SQL['enrich_convert_fx']}) WHERE issue IS NOT NULL",
    ]
    return " UNION ALL ".join(whole + other)


@query(_all_rules_sql())
def all_rules(spark, sf_dir):
    """Mapping, enrichment and all ten rules in one plan: every violation."""
    return rules.violations(outcomes(spark, sf_dir), "invoiceNumber", "line").select("invoiceNumber", "line", "v.rule", "v.field", "v.severity", "v.message")


@query(f"""WITH {_E}, f AS (SELECT file_id, invoiceNumber, lineNumber, min(seq) AS s FROM m WHERE lineNumber IS NOT NULL GROUP BY ALL),
j AS (SELECT e.*, f.s < e.seq AS dup, CASE WHEN found THEN {_EXACT_OFF} END AS off, o_orderkey IS NOT NULL AND lineNumber = 1 AS known
 FROM e LEFT JOIN f USING (file_id, invoiceNumber, lineNumber) LEFT JOIN orders ON e.l_orderkey = o_orderkey AND o_orderstatus = 'F'),
s AS (SELECT file_id, l_orderkey % 50 = 0 OR coalesce(quantity < 2 OR quantity > 48, false) OR coalesce(currency NOT IN ('USD', 'INR', 'EUR'), false) OR coalesce(dup, false) OR (sku IS NOT NULL AND NOT found) OR coalesce(off > 150, false)
 OR coalesce(abs(lineAmount - quantity * unitPrice) > greatest(0.05, round(quantity * unitPrice * 0.000001, 6)), false) OR coalesce(currency = 'INR' AND lineAmount > 50000, false) AS bad,
 taxAmount IS NULL OR coalesce(length(sku) > 3, false) OR coalesce(invoiceDate > DATE '2001-07-05' OR invoiceDate < DATE '2001-06-30' - INTERVAL 2000 DAY, false) OR currency = 'JPY' OR coalesce(off > 50, false)
 OR coalesce(found AND quantity > round(open * 1.05, 6), false) OR coalesce(found AND upper(description) <> upper(p_name), false) OR coalesce(known, false) AS warned FROM j)
SELECT file_id, count(*) AS total, count(*) FILTER (NOT bad AND NOT warned) AS valid, count(*) FILTER (NOT bad AND warned) AS warnings, count(*) FILTER (bad) AS errors, count(*) FILTER (bad) / count(*) AS error_rate FROM s GROUP BY file_id""")
def all_rules_summary(spark, sf_dir):
    """The totals of each file after mapping, enrichment and all ten rules."""
    return pipeline.file_summary(outcomes(spark, sf_dir))


@query("""WITH n AS (SELECT CAST(l_suppkey AS VARCHAR) AS file_id, count(*) AS total, l_suppkey AS k FROM lineitem GROUP BY l_suppkey)
SELECT file_id, 'CONTROL_TOTAL' AS rule, 'WARNING' AS severity, CASE WHEN k % 3 = 2 THEN 'file declares ''many'' line items, which is not a number' ELSE 'file declares ' || total + 1 || ' line items but ' || total || ' were read' END AS message
FROM n WHERE k % 3 > 0""")
def control_totals(spark, sf_dir):
    summary = invoice_records(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("total"))
    k = F.col("file_id").cast("long") % 3
    declared = summary.select("file_id", F.when(k == 2, "many").otherwise((F.col("total") + k).cast("string")).alias("declared"))
    return pipeline.control_totals(summary, declared)


@query("""WITH n AS (SELECT o_custkey % 500 AS job, count(*) FILTER (o_orderstatus = 'F') AS errors, count(*) FILTER (o_orderstatus <> 'P') AS total FROM orders GROUP BY 1)
SELECT job, CASE WHEN total = 0 THEN CASE WHEN job % 2 = 0 THEN 'REJECTED' ELSE 'FAILED' END WHEN errors = 0 THEN 'COMPLETED' ELSE 'NEEDS_REVIEW' END AS status FROM n""")
def job_status(spark, sf_dir):
    n = _t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 500).alias("job")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("errors"), F.count_if(F.col("o_orderstatus") != "P").alias("total"))
    return n.select("job", pipeline.job_status(F.col("total"), F.col("errors"), F.col("job") % 2 == 0).alias("status"))


@query(f"""WITH {_STATUS} SELECT file_id, invoiceNumber, line, sum(CAST(quantity AS DOUBLE)) AS quantity FROM s WHERE status IN ('VALID', 'WARNING') GROUP BY ALL""")
def deliverable_split(spark, sf_dir):
    return outbox.deliverable(_judged(spark, sf_dir)).groupBy("file_id", "invoiceNumber", "line").agg(F.sum(F.col("quantity").cast("double")).alias("quantity"))


_WARNED = "CASE WHEN taxAmount IS NULL THEN 1 ELSE 0 END + CASE WHEN length(sku) > 3 THEN 1 ELSE 0 END + CASE WHEN currency = 'JPY' THEN 1 ELSE 0 END"
_FAILED = "CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END + CASE WHEN quantity < 2 OR quantity > 48 THEN 1 ELSE 0 END + CASE WHEN currency NOT IN ('USD', 'INR', 'EUR') THEN 1 ELSE 0 END"


@query(f"""WITH {_STATUS} SELECT line, status, invoiceNumber AS invoice, strftime(invoiceDate, '%Y-%m-%d') AS day, CAST(lineAmount AS DOUBLE) AS amount, 'CGST' AS tax_from, {_WARNED} + {_FAILED} AS n_violations FROM s""")
def export_json(spark, sf_dir):
    # each document is read once, with a schema of what is asked for; a path for each value would read it again
    shape = "line long, status string, values struct<invoiceNumber: string, invoiceDate: string, lineAmount: double>, lineage struct<taxAmount: array<string>>, violations array<string>"
    return pipeline.export_json(_judged(spark, sf_dir), SCHEMA).select(F.from_json("json", shape).alias("d")).select(
        "d.line", "d.status", F.col("d.values.invoiceNumber").alias("invoice"), F.col("d.values.invoiceDate").alias("day"),
        F.col("d.values.lineAmount").alias("amount"), F.get("d.lineage.taxAmount", F.lit(0)).alias("tax_from"), F.size("d.violations").alias("n_violations"),
    )


@query(f"""WITH {_STATUS} SELECT file_id || '-' || invoiceNumber || '-' || line AS record_id, supplierId AS partner, CAST(quantity AS DOUBLE) AS quantity, {_WARNED} AS n_warnings FROM s""")
def delivered_payload(spark, sf_dir):
    keyed_rows = _judged(spark, sf_dir).withColumn("record_id", F.concat_ws("-", "file_id", "invoiceNumber", "line")).withColumn("partner_id", F.col("supplierId"))
    payload = keyed_rows.select(pipeline.delivered_payload(keyed_rows, SCHEMA).alias("payload"))
    part = lambda path: F.get_json_object("payload", path)
    return payload.select(part("$._recordId").alias("record_id"), part("$._partner").alias("partner"), part("$.quantity").cast("double").alias("quantity"), F.json_array_length(part("$._warnings")).alias("n_warnings"))


@query(f"""WITH {_STATUS} SELECT invoiceNumber, line, CASE WHEN line % 2 = 0 THEN CAST(quantity + 1 AS DOUBLE) END AS quantity,
 CASE WHEN line % 2 = 1 OR quantity + 1 > 48 THEN 'ERROR' WHEN currency = 'JPY' THEN 'WARNING' ELSE 'VALID' END AS status,
 CASE WHEN line % 2 = 1 THEN 'Quantity: ' || chr(39) || 'abc' || chr(39) || ' is not a valid amount' END AS message, 'edited by ann' AS edited
FROM s WHERE status = 'ERROR' AND quantity < 2""")
def exception_fix(spark, sf_dir):
    # kept: records and edits meet by an id that depends on how the rows lie, so both have to come from one working out of it
    held = kept(_judged(spark, sf_dir).where("status = 'ERROR' and quantity < 2").withColumn("record_id", F.monotonically_increasing_id()))
    value = F.when(F.col("line") % 2 == 1, "abc").otherwise((F.col("quantity") + 1).cast("string"))
    edits = held.select("record_id", F.lit("quantity").alias("field"), value.alias("value"))
    out = jobs.fix(held, edits, SPEC, SCHEMA, [r for r in RULES if r.id == "QTY"], invoice_reference(spark, sf_dir), TODAY, "ann")
    wrong = F.get(F.filter("violations", lambda v: v["rule"] == "MAPPING"), F.lit(0))["message"]
    return out.select("invoiceNumber", "line", F.col("quantity").cast("double").alias("quantity"), "status", wrong.alias("message"), F.array_join(F.col("lineage")["quantity"], ",").alias("edited"))


# ---- the store's relational queries

def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored records: a job for each user, held and dead records by the value."""
    e = _t(spark, sf_dir, "events")
    status = F.when(F.col("value") < 20, "ERROR").when(F.col("value") < 30, "DEAD_LETTER").when(F.col("value") < 60, "WARNING").otherwise("VALID")
    warned = F.when(F.col("event_id") % 3 == 0, F.array(mapping.violation("R", "f", "WARNING", F.lit("w")))).otherwise(mapping.none_yet())
    return e.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("partner_id"), status.alias("status"), warned.alias("violations"), F.col("ts").alias("next_attempt_at"), (F.col("event_id") % 6).cast("int").alias("attempts"), F.col("event_id").alias("line"))


_R = """r AS (SELECT event_id AS record_id, user_id AS job_id, event_type AS partner_id, CASE WHEN value < 20 THEN 'ERROR' WHEN value < 30 THEN 'DEAD_LETTER' WHEN value < 60 THEN 'WARNING' ELSE 'VALID' END AS status,
 event_id % 3 = 0 AS warned, ts AS next_attempt_at, CAST(event_id % 6 AS INTEGER) AS attempts FROM events)"""


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def three_way_join(spark, sf_dir):
    li, o, c = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "l_quantity")


@query(f"WITH {_R} SELECT status, count(*) AS n FROM r GROUP BY status")
def counts_by_status(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, s_name, count(DISTINCT l_orderkey) AS files, count(l_orderkey) AS records, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0)::BIGINT AS errors
FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""")
def partner_stats(spark, sf_dir):
    s, li = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "lineitem")
    per = li.groupBy("l_suppkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("records"), F.sum("bad").alias("errors"))
    return s.join(per, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "records", "errors")])


@query("SELECT count(*) AS files, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0)::DOUBLE AS total, count(*) FILTER (o_orderstatus = 'F') AS failed, count(DISTINCT o_custkey) AS partners FROM orders WHERE o_orderstatus <> 'DUPLICATE'")
def job_totals(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'DUPLICATE'")
    return o.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_distinct("o_custkey").alias("partners"))


@query("SELECT event_type AS partner_id, max(ts) AS last_received FROM events GROUP BY 1")
def last_received_by_partner(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("partner_id")).agg(F.max("ts").alias("last_received"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def recent_jobs_topk(spark, sf_dir):
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {_R} SELECT record_id, job_id, status FROM r WHERE partner_id = 'click' AND status IN ('ERROR', 'DEAD_LETTER') ORDER BY record_id DESC LIMIT 200")
def exceptions_queue(spark, sf_dir):
    return jobs.exceptions_queue(_records(spark, sf_dir), "click").select("record_id", "job_id", "status")


@query(f"WITH {_R} SELECT record_id, status FROM r WHERE job_id = 7 ORDER BY record_id LIMIT 500")
def records_of_job(spark, sf_dir):
    return jobs.records_of_job(_records(spark, sf_dir), 7).select("record_id", "status")


@query("SELECT o_custkey AS partner_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS spec FROM orders GROUP BY 1")
def latest_spec_version(spark, sf_dir):
    specs = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("partner_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("spec"))
    return jobs.latest_specs(specs)


@query("SELECT o_custkey AS partner_id, coalesce(max(o_orderkey), 0) + 1 AS version FROM orders GROUP BY 1")
def next_spec_version(spark, sf_dir):
    return jobs.next_version(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("partner_id"), F.col("o_orderkey").alias("version")))


@query(f"""WITH {_R} SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('ERROR', 'DEAD_LETTER')) AS errors, count(*) FILTER (status NOT IN ('ERROR', 'DEAD_LETTER') AND warned) AS warnings,
 count(*) FILTER (status NOT IN ('ERROR', 'DEAD_LETTER') AND NOT warned) AS valid FROM r GROUP BY job_id""")
def recount_jobs(spark, sf_dir):
    r = _records(spark, sf_dir)
    return jobs.recount(r.select("job_id").distinct(), r).select("job_id", "total", "errors", "warnings", "valid")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_nationkey DESC, s_name")
def partner_listing(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").orderBy(F.desc("s_nationkey"), "s_name").select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 5 ORDER BY ts, event_id")
def audit_trail(spark, sf_dir):
    a = _t(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), F.col("ts").alias("at"), F.col("event_id").alias("audit_id"), "event_id", "ts", "event_type")
    return jobs.audit_trail(a, 5).select("event_id", "ts", "event_type")


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1000) WHERE event_id > 500")
def event_log_after(spark, sf_dir):
    return jobs.append_events(_t(spark, sf_dir, "events").withColumn("seq", F.col("event_id")), 500).select("event_id", "event_type")


# ---- state

@query("""WITH k AS (SELECT source, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 = 0)
SELECT source AS partner_id, sha256(text) AS sha256, min(doc_id) AS job FROM documents d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.source = d.source AND k.sha256 = sha256(d.text)) GROUP BY ALL""")
def dedupe_by_content_hash(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("partner_id"), F.encode("text", "UTF-8").alias("content"), F.col("doc_id").alias("received_at"), F.lit("f").alias("file_name"))
    known = d.where("doc_id % 3 = 0").select(F.col("source").alias("partner_id"), F.sha2("text", 256).alias("sha256")).distinct()
    return jobs.receive(files, known).select("partner_id", "sha256", F.col("received_at").alias("job"))


@query(f"""WITH {_R} SELECT record_id, CASE WHEN hit AND attempts + 1 >= 5 THEN 'DEAD_LETTER' ELSE status END AS status, attempts + CASE WHEN hit THEN 1 ELSE 0 END AS attempts,
 CASE WHEN hit AND attempts + 1 >= 5 THEN NULL WHEN hit THEN CAST('2024-01-01' AS TIMESTAMP) + INTERVAL 1 SECOND * least(60, pow(2, attempts + 1))::INTEGER ELSE next_attempt_at END AS next_attempt_at
 FROM (SELECT *, record_id % 4 = 0 AS hit FROM r)""")
def retry_backoff_state(spark, sf_dir):
    r = _records(spark, sf_dir)
    out = outbox.after_failure(r, r.where("record_id % 4 = 0"), F.lit("2024-01-01").cast("timestamp"))
    return out.select("record_id", "status", "attempts", "next_attempt_at")


@query(f"WITH {_R} SELECT record_id, next_attempt_at FROM r WHERE status IN ('VALID', 'WARNING') AND next_attempt_at <= TIMESTAMP '2100-01-01' ORDER BY next_attempt_at, record_id LIMIT 50")
def outbox_claim(spark, sf_dir):
    return outbox.claim(_records(spark, sf_dir), F.lit("2100-01-01").cast("timestamp")).select("record_id", "next_attempt_at")


@query(f"""WITH {_R} SELECT partner_id, sha256(string_agg(record_id || ':' || job_id, ',' ORDER BY next_attempt_at, record_id)) AS key FROM r GROUP BY 1""")
def delivery_idempotency_key(spark, sf_dir):
    claimed = F.sort_array(F.collect_list(F.struct("next_attempt_at", "record_id", "job_id")))
    pairs = F.transform(claimed, lambda x: F.concat_ws(":", x["record_id"], x["job_id"]))
    return _records(spark, sf_dir).groupBy("partner_id").agg(outbox.idempotency_key(pairs).alias("key"))


@query(f"WITH {_R} SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'DELIVERED' ELSE status END AS status FROM r")
def delivery_success(spark, sf_dir):
    r = _records(spark, sf_dir)
    return outbox.after_success(r, r.where("record_id % 2 = 0")).select("record_id", "status")


@query(f"WITH {_R} SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'DISMISSED' ELSE status END AS status FROM r")
def exception_dismiss(spark, sf_dir):
    r = _records(spark, sf_dir)
    return jobs.dismiss(r, r.where("record_id % 2 = 0")).select("record_id", "status")


@query(f"WITH {_R} SELECT record_id, CASE WHEN record_id % 2 = 0 AND status = 'DEAD_LETTER' THEN CASE WHEN warned THEN 'WARNING' ELSE 'VALID' END ELSE status END AS status FROM r")
def dead_letter_replay(spark, sf_dir):
    r = _records(spark, sf_dir)
    return jobs.replay(r, r.where("record_id % 2 = 0")).select("record_id", "status")


@query("""WITH k AS (SELECT 'invoiced-lines' AS dataset, o_orderkey || '|1' AS key, o_orderkey AS record_id FROM orders),
d AS (SELECT 'invoiced-lines' AS dataset, l_orderkey || '|' || l_linenumber AS key, min(l_partkey) AS record_id FROM lineitem GROUP BY ALL)
SELECT * FROM k UNION ALL SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.key = d.key)""")
def delivered_key_memory(spark, sf_dir):
    keys = _t(spark, sf_dir, "orders").select(F.lit("invoiced-lines").alias("dataset"), F.concat(F.col("o_orderkey").cast("string"), F.lit("|1")).alias("key"), F.col("o_orderkey").alias("record_id"))
    li = _t(spark, sf_dir, "lineitem").select(F.lit("invoice-line").alias("schema"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("business_key"), F.col("l_partkey").alias("record_id"))
    return outbox.remember_delivered(keys, li)


@query("""SELECT o_orderkey, CAST(CAST(o_custkey AS DECIMAL(18,3)) + coalesce(q, 0) AS DOUBLE) AS invoiced FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,3))) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def consume_open_qty(spark, sf_dir):
    po = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("poNumber"), F.lit("x").alias("sku"), F.col("o_custkey").cast("decimal(18,3)").alias("invoicedQty"))
    done = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("poNumber"), F.lit("x").alias("sku"), F.col("l_quantity").cast("decimal(18,3)").alias("quantity"))
    return outbox.consume_open_quantity(po, done).select(F.col("poNumber").alias("o_orderkey"), F.col("invoicedQty").cast("double").alias("invoiced"))


# ---- profiling

#: (a value's shape with the key in it, its kinds): one for each kind, and values of several.
_KIND_SHAPES = [
    ("{k}", "INTEGER,DECIMAL,AMOUNT"), ("usd", "CURRENCY"), ("Ctn", "UOM"), ("2024-02-29", "DATE"), ("a{k}@x.org", "EMAIL"), ("27AAPFU0939F1ZV", "GSTIN"), ("{k}.25", "DECIMAL,AMOUNT"), ("Rs. {k}", "AMOUNT"),
    ("+91 98765 43210", "PHONE"), ("AB-{k}", "CODE"), ("plain words", "TEXT"), (" n/a ", "BLANK"), ("", "BLANK"), ("2 L", "AMOUNT"),
]


def _shape(text: str) -> str:
    return "'" + text.replace("{k}", "' || c_custkey || '") + "'"


@query(f"""SELECT c_custkey, [{", ".join(repr(k) for _, k in _KIND_SHAPES)}][c_custkey % {len(_KIND_SHAPES)} + 1] AS kinds FROM customer""")
def value_kinds(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    shown = F.array(*[F.concat(*[x for i, part in enumerate(t.split("{k}")) for x in ([key] if i else []) + [F.lit(part)]]) for t, _ in _KIND_SHAPES])
    v = F.element_at(shown, (F.col("c_custkey") % len(_KIND_SHAPES) + 1).cast("int"))
    return _t(spark, sf_dir, "customer").select("c_custkey", F.array_join(suggest.classify(v), ",").alias("kinds"))


@query("""WITH v AS (SELECT CAST(l_suppkey AS VARCHAR) AS file_id, u.column, u.value FROM lineitem, (SELECT unnest([{'column': 'Qty', 'value': CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)}, {'column': 'Status', 'value': l_linestatus}, {'column': 'CGST', 'value': CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(CAST(l_tax AS DECIMAL(18,2)) * 50 AS VARCHAR) END}]) AS u))
SELECT file_id, "column", count(value) AS filled, count(DISTINCT value) AS "distinct" FROM v GROUP BY ALL""")
def column_profile(spark, sf_dir):
    out = suggest.profile(invoice_records(spark, sf_dir), None)
    return out.where(F.col("column").isin("Qty", "Status", "CGST")).select("file_id", "column", "filled", "distinct")


@query()
def header_similarity(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("column")).distinct().union(spark.createDataFrame([(c,) for c in COLUMNS], "column string"))
    return suggest.header_similarity(names, SCHEMA)


@query()
def suggest_mapping(spark, sf_dir):
    profiled = suggest.profile(invoice_records(spark, sf_dir).withColumn("file_id", F.lit("all")), None)
    return suggest.report_table(spark, suggest.suggest(SCHEMA, suggest.collect_profiles(profiled, COLUMNS), "IN"))


# ---- X12 and readers, on documents written from the tables

def x12_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, text): one 810 for each order with its lines; the segment count is wrong where the key divides by 9."""
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.concat_ws("*", F.lit("IT1"), "l_linenumber", F.col("l_quantity").cast("int"), F.lit("EA"), F.col("l_extendedprice").cast("decimal(18,2)"), F.lit(""), F.lit("VP"), "l_partkey"))).alias("lines"))
    o = _t(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    n = F.size("lines") + 4 + F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(0)
    key = F.col("o_orderkey").cast("string")
    parts = [
        F.lit("ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *260922*0930*U*00401*000000077*0*P*>"), F.lit("GS*IN*SND*RCV*20260922*0930*77*X*004010"),
        F.lit("ST*810*0001"), F.concat(F.lit("BIG*"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("*"), key), F.array_join("lines", "~\n"), F.concat(F.lit("CTT*"), F.size("lines").cast("string")),
        F.concat(F.lit("SE*"), n.cast("string"), F.lit("*0001")), F.lit("GE*1*77"), F.lit("IEA*1*000000077"), F.lit(""),
    ]
    return o.select(key.alias("file_id"), F.concat_ws("~\n", *parts).alias("text"))


@query("""WITH n AS (SELECT CAST(o_orderkey AS VARCHAR) AS file_id, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT file_id, unnest(['ISA', 'GS', 'ST', 'BIG', 'IT1', 'CTT', 'SE', 'GE', 'IEA']) AS seg_id, unnest([1, 1, 1, 1, n, 1, 1, 1, 1]) AS n FROM n""")
def x12_segments(spark, sf_dir):
    return edi.segments(x12_documents(spark, sf_dir)).groupBy("file_id", "seg_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS file_id, '810' AS tx_type, count(*) + 4 AS n_segments, count(*) + 4 + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS declared FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def x12_envelope_counts(spark, sf_dir):
    return edi.envelope_counts(edi.segment_arrays(x12_documents(spark, sf_dir))).select("file_id", "tx_type", "n_segments", "declared")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS file_id, strftime(o_orderdate, '%Y%m%d') AS day, CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity, CAST(l_partkey AS VARCHAR) AS sku, CAST(l_partkey AS VARCHAR) AS paired_sku FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 9 <> 0""")
def x12_flatten(spark, sf_dir):
    flat = edi.transactions(x12_documents(spark, sf_dir), "IT1")  # rejected transactions have no records
    return flat.select("file_id", F.col("fields")["BIG01"].alias("day"), F.col("fields")["IT101"].alias("line"), F.col("fields")["IT102"].alias("quantity"), F.col("fields")["IT107"].alias("sku"), F.col("fields")["IT1.VP"].alias("paired_sku"))


def _dealt(files: DataFrame) -> DataFrame:
    """Large files over all tasks: put together by size alone, several would be parsed one after the other."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism)


def _as_files(docs: DataFrame, suffix: str) -> DataFrame:
    return docs.select("file_id", F.concat("file_id", F.lit(suffix)).alias("file_name"), F.encode("text", "UTF-8").alias("content"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS file_id, CAST(l_linenumber AS VARCHAR) AS line_no, CAST(l_partkey AS VARCHAR) AS sku FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 9 <> 0""")
def x12_records(spark, sf_dir):
    out = reader.read_files(_as_files(x12_documents(spark, sf_dir), ".x12"), model.ReaderOptions())
    return out.select("file_id", F.col("fields")["IT101"].alias("line_no"), F.col("fields")["IT1.VP"].alias("sku"))


def x12_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, text): an 810 for each order, whole or with one of the faults that an acknowledgment tells apart, by the key's rest by 7."""
    o = _t(spark, sf_dir, "orders")
    kind, key = F.col("o_orderkey") % 7, F.col("o_orderkey").cast("string")
    pick = lambda at, then, other: F.when(kind == at, F.lit(then)).otherwise(F.lit(other))
    parts = [
        F.lit("ISA*00*          *00*          *ZZ*SENDER         *ZZ*RECEIVER       *260922*0930*U*00401*000000077*0*P*>"), F.lit("GS*IN*SND*RCV*20260922*0930*77*X*004010"),
        pick(1, "ST*999*0001", "ST*810*0001"), F.concat(F.lit("BIG*"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("*"), key),
        F.when(kind == 2, None).when(kind == 3, "SE*3*0009").when(kind == 4, "SE*8*0001").otherwise("SE*3*0001"),
        F.when(kind == 6, "ST*810*0002~\nSE*5*0002"), F.concat(F.lit("GE*"), pick(6, "2", "1"), pick(5, "*78", "*77")), F.lit("IEA*1*000000077"), F.lit(""),
    ]
    return o.select(key.alias("file_id"), F.concat_ws("~\n", *parts).alias("text"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS file_id, ['AK5*A', 'AK5*R*1', 'AK5*R*2', 'AK5*R*3', 'AK5*R*4', 'AK5*A', 'AK5*A|AK5*R*4'][o_orderkey % 7 + 1] AS ak5,
 ['AK9*A*1*1*1', 'AK9*R*1*1*0', 'AK9*R*1*1*0', 'AK9*R*1*1*0', 'AK9*R*1*1*0', 'AK9*E*1*1*1', 'AK9*P*2*2*1'][o_orderkey % 7 + 1] AS ak9 FROM orders""")
def x12_acknowledge(spark, sf_dir):
    def run(frames):
        for f in frames:
            acks = [edi.acknowledge(edi.parse(t), 1000, 500, datetime.datetime(2026, 9, 22, 9, 30)).split("~\n") for t in f["text"]]
            yield f[["file_id"]].assign(ak5=["|".join(s for s in a if s.startswith("AK5")) for a in acks], ak9=[next(s for s in a if s.startswith("AK9")) for a in acks])

    return x12_envelopes(spark, sf_dir).mapInPandas(run, "file_id string, ak5 string, ak9 string")


_LAYOUT = model.ReaderOptions(detail="D", trailer="T", layouts={
    "H": (model.Layout("INV", 2, 12), model.Layout("DATE", 14, 8)), "D": (model.Layout("LINE", 2, 4), model.Layout("PART", 6, 12), model.Layout("QTY", 18, 6)), "T": (model.Layout("RECORD_COUNT", 2, 6),),
})


def _fixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, line, text): a header for each order, its lines, and a trailer for each supplier's file."""
    li = _t(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")))
    base = F.col("l_orderkey") * 1000
    file_id = F.col("l_suppkey").cast("string").alias("file_id")
    head = li.where("n = 1").select(file_id, base.alias("line"), F.concat(F.lit("H"), F.rpad(F.col("l_orderkey").cast("string"), 12, " "), F.date_format("l_shipdate", "yyyyMMdd")).alias("text"))
    body = li.select(file_id, (base + F.col("n")).alias("line"), F.concat(F.lit("D"), F.lpad(F.col("l_linenumber").cast("string"), 4, " "), F.rpad(F.col("l_partkey").cast("string"), 12, " "), F.lpad(F.col("l_quantity").cast("int").cast("string"), 6, " ")).alias("text"))
    tail = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c")).select(file_id, F.lit(1 << 60).alias("line"), F.concat(F.lit("T"), F.lpad(F.col("c").cast("string"), 6, "0")).alias("text"))
    return head.unionByName(body).unionByName(tail)


@query("SELECT CAST(l_suppkey AS VARCHAR) AS file_id, CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_linenumber AS VARCHAR) AS line_no, CAST(l_partkey AS VARCHAR) AS part, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty FROM lineitem")
def fixed_width_carry_down(spark, sf_dir):
    out = reader.fixed_width(_fixed_lines(spark, sf_dir), _LAYOUT)
    f = F.col("fields")
    return out.select("file_id", f["H.INV"].alias("invoice"), f["LINE"].alias("line_no"), f["PART"].alias("part"), f["QTY"].alias("qty"))


@query("""WITH d AS (SELECT l_suppkey % 16 AS f, l_orderkey, l_suppkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem),
h AS (SELECT f, l_orderkey, l_suppkey, NULL AS l_linenumber, NULL AS l_partkey, NULL AS l_quantity, 0 AS n FROM d WHERE n = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY l_orderkey, l_suppkey, n) AS line FROM (SELECT * FROM d UNION ALL SELECT * FROM h))
SELECT CAST(f AS VARCHAR) AS file, line, CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_linenumber AS VARCHAR) AS line_no, CAST(l_partkey AS VARCHAR) AS part, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty FROM a WHERE n > 0""")
def fixed_split_carry_down(spark, sf_dir):
    """Fixed-width files read by as many tasks as they have blocks, headers carried over their borders."""
    li = _t(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")))
    file = (F.col("l_suppkey") % 16).cast("string").alias("file")
    place = lambda n: F.struct("l_orderkey", "l_suppkey", n.alias("n")).alias("place")
    head = li.where("n = 1").select(file, place(F.lit(0)), F.concat(F.lit("H"), F.rpad(F.col("l_orderkey").cast("string"), 12, " "), F.date_format("l_shipdate", "yyyyMMdd")).alias("text"))
    body = li.select(file, place(F.col("n")), F.concat(F.lit("D"), F.lpad(F.col("l_linenumber").cast("string"), 4, " "), F.rpad(F.col("l_partkey").cast("string"), 12, " "), F.lpad(F.col("l_quantity").cast("int").cast("string"), 6, " ")).alias("text"))
    out, f = splits.fixed_records(spark, _written(head.unionByName(body)), _LAYOUT), F.col("fields")
    return out.select(F.regexp_extract("file_id", "file=([^/]+)/", 1).alias("file"), "line", f["H.INV"].alias("invoice"), f["LINE"].alias("line_no"), f["PART"].alias("part"), f["QTY"].alias("qty"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS file_id, CAST(count(*) AS VARCHAR) AS declared FROM lineitem GROUP BY 1")
def fixed_width_trailer(spark, sf_dir):
    return reader.trailer_totals(_fixed_lines(spark, sf_dir), _LAYOUT)


def _written(lines: DataFrame) -> str:
    """The lines (file, place, text) as text files, one folder for each file; its lines in their order."""
    path = work_folder(lines.sparkSession)
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "text").write.partitionBy("file").text(path)
    return path


#: Customers in a file, by ranges of their keys: files of some 30 MB.
_PER_FILE = 500_000


@query(f"""WITH c AS (SELECT *, c_nationkey || '-' || c_custkey // {_PER_FILE} AS file FROM customer),
n AS (SELECT *, 3 + row_number() OVER w + coalesce(count(*) FILTER (c_custkey % 3 = 0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM c WINDOW w AS (PARTITION BY file ORDER BY c_custkey))
SELECT file, line, CAST(c_custkey AS VARCHAR) AS number, c_name || ', "' || c_mktsegment || '"' || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'second line' ELSE '' END AS name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS balance FROM n""")
def csv_split_rows(spark, sf_dir):
    """Delimited files with a preamble, cells over two lines and a footer, read by as many tasks as they have blocks."""
    file = F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / _PER_FILE).cast("string")).alias("file")
    name = F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('""'), F.when(F.col("c_custkey") % 3 == 0, "\nsecond line").otherwise(""), F.lit('"'))
    body = _t(spark, sf_dir, "customer").select(file, F.col("c_custkey").alias("place"), F.concat_ws(",", F.col("c_custkey").cast("string"), name, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("text"))
    around = F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("place"), F.lit(t).alias("text")) for p, t in ((-3, "Customer register"), (-2, ""), (-1, "Cust No.,Cust Name,Balance Amt"), (1 << 60, "Total,,1"))]))
    rest = body.select("file").distinct().select("file", around.alias("_x")).select("file", "_x.place", "_x.text")
    out, f = splits.csv_records(spark, _written(body.unionByName(rest))), F.col("fields")
    return out.select(F.regexp_extract("file_id", "file=([^/]+)/", 1).alias("file"), "line", f["Cust No"].alias("number"), f["Cust Name"].alias("name"), f["Balance Amt"].alias("balance"))


#: Customers of a file that one task parses.
_PART = 1000


@query("""WITH c AS (SELECT *, n_name || '-' || c_custkey // 1000 AS file_id, CAST(c_custkey AS VARCHAR) || ',"' || c_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT file_id, 3 + row_number() OVER (PARTITION BY file_id ORDER BY place) AS line, CAST(c_custkey AS VARCHAR) AS number, c_name || ', "' || c_mktsegment || '"' AS name FROM c""")
def csv_rows(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('"""')), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    body = c.groupBy(_part().alias("file_id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\r\n").alias("lines"))
    docs = body.select("file_id", F.concat(F.lit("Customer register\r\n\r\nCust No.,Cust Name,Balance Amt\r\n"), "lines", F.lit("\r\nTotal,,1")).alias("text"))
    out = reader.read_files(_as_files(docs, ".csv"), model.ReaderOptions())
    return out.select("file_id", "line", F.col("fields")["Cust No"].alias("number"), F.col("fields")["Cust Name"].alias("name"))


def _part():
    """A nation's customers in files of a bounded size."""
    return F.concat_ws("-", F.col("n_name"), F.floor(F.col("c_custkey") / _PART).cast("string"))


@query("SELECT n_name AS file_id, CAST(c_custkey AS VARCHAR) AS number, c_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def json_records(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.struct(F.col("c_custkey").alias("no"), F.struct(F.col("c_name").alias("name")).alias("party"))
    docs = c.groupBy(F.col("n_name").alias("file_id"), "n_regionkey").agg(F.collect_list(item).alias("rows")).select("file_id", F.to_json(F.struct(F.struct(F.col("n_regionkey").alias("region")).alias("head"), "rows")).alias("text"))
    f = F.col("fields")
    return reader.read_files(_dealt(_as_files(docs, ".json")), model.ReaderOptions(record_element="rows"), strict=True).select("file_id", f["no"].alias("number"), f["party/name"].alias("name"), f["head/region"].alias("region"))


@query("SELECT n_name AS file_id, CAST(c_custkey AS VARCHAR) AS number, c_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def xml_records(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    item = F.concat(F.lit('<c:Item no="'), F.col("c_custkey").cast("string"), F.lit('"><Party><Name>'), "c_name", F.lit("</Name></Party></c:Item>"))
    body = c.groupBy(F.col("n_name").alias("file_id"), "n_regionkey").agg(F.array_join(F.collect_list(item), "\n").alias("items"))
    docs = body.select("file_id", F.concat(F.lit('<?xml version="1.0"?>\n<Doc xmlns:c="urn:x"><Head region="'), F.col("n_regionkey").cast("string"), F.lit('"/>'), "items", F.lit("</Doc>")).alias("text"))
    f = F.col("fields")
    return reader.read_files(_dealt(_as_files(docs, ".xml")), model.ReaderOptions(record_element="Item")).select("file_id", f["@no"].alias("number"), f["Party/Name"].alias("name"), f["Head/@region"].alias("region"))


#: (file name, text with the key in it, format), one for each branch of the decision.
_SNIFFED = [
    ("a{k}.bin", "PK\x03\x04 {k}", "XLSX"), ("a{k}.txt", "ISA*00*{k}", "X12"), ("a{k}.csv", " \n<doc n='{k}'/>", "XML"), ("a{k}", '{{"k": {k}}}', "JSON"), ("a{k}", "[{k}]", "JSON"), ("a{k}.EDI", "{k}", "X12"), ("a{k}.850", "{k}", "X12"),
    ("a{k}.xlsm", "{k}", "XLSX"), ("a{k}.json", "{k}", "JSON"), ("a{k}.dat", "\n".join(f"H{i:04d}  A{{k}}   a line of fixed width    {i}" for i in range(5)), "FIXED_WIDTH"), ("a{k}.dat", "\n".join(f"H{i},  {{k}},  a line with a delimiter   ,{i}" for i in range(5)), "CSV"),
    ("a{k}.dat", "H1  {k}  only two lines of fixed width\nH2  {k}  only two lines of fixed width", "CSV"), ("a{k}.dat", " \n ", "UNKNOWN"), ("a{k}.txt", "k;v\n{k};1", "CSV"), ("a{k}.xml", "\ufeff{{}}{k}", "JSON"),
]


@query(f"""SELECT c_custkey, [{", ".join(repr(f) for _, _, f in _SNIFFED)}][c_custkey % {len(_SNIFFED)} + 1] AS format FROM customer""")
def format_sniff(spark, sf_dir):
    """The format of small files of every kind, told natively and, which must agree, by the parser of single files."""
    @F.pandas_udf("string")
    def by_parser(name: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([parsers.sniff(n, bytes(c)) for n, c in zip(name, content, strict=True)])

    key = F.col("c_custkey").cast("string")
    made = lambda t: F.concat(*[x for i, part in enumerate(t.replace("{{", "{").replace("}}", "}").split("{k}")) for x in ([key] if i else []) + [F.lit(part)]])
    at = (F.col("c_custkey") % len(_SNIFFED) + 1).cast("int")
    files = _t(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[made(n) for n, _, _ in _SNIFFED]), at).alias("n"), F.encode(F.element_at(F.array(*[made(t) for _, t, _ in _SNIFFED]), at), "UTF-8").alias("c"))
    told = files.select("c_custkey", reader.sniff_format(F.col("n"), F.col("c")).alias("format"), by_parser("n", "c").alias("plain"))
    return told.select("c_custkey", F.when(F.col("format") == F.col("plain"), F.col("format")).otherwise(F.concat_ws(" or ", "format", "plain")).alias("format"))


#: Layouts of the heading of a table, by the key's rest by 6: (lines above the records, explicit header row, names of the columns).
_HEADINGS = [
    ("Item No,Name,Qty", None, "Item No,Name,Qty"), ("Stock of the day\n\nItem No.,  Name :,Qty", None, "Item No,Name,Qty"), ("Order,,Rate\nItem No,Name,Amount", None, "Order Item No,Order Name,Rate Amount"),
    ("Item No,Name,Name", None, "Item No,Name,Name (2)"), ("Code,Title,Pieces\nItem No,Name,Qty", 2, "Item No,Name,Qty"), ("", None, "column_1,column_2,column_3"),
]


@query(f"""WITH c AS (SELECT *, c_custkey % {len(_HEADINGS)} AS h FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS file_id, [{", ".join(str(len(h.split(chr(10))) if h else 0) for h, _, _ in _HEADINGS)}][h + 1] + i AS line, string_split([{", ".join(repr(n) for _, _, n in _HEADINGS)}][h + 1], ',')[1] AS first_name,
 string_split([{", ".join(repr(n) for _, _, n in _HEADINGS)}][h + 1], ',')[3] AS last_name, i || '7' AS first_value, CAST(c_custkey AS VARCHAR) AS last_value FROM c, (SELECT unnest([1, 2, 3, 4]) AS i)""")
def table_headings(spark, sf_dir):
    """Headings of six layouts: plain, below a preamble, over two rows, with repeated names, at a given row, none."""
    key = F.col("c_custkey").cast("string")
    rows = F.concat(*[F.concat(F.lit(f"{i}7,word {i},"), key, F.lit("\n")) for i in range(1, 5)])
    layout = F.col("c_custkey") % len(_HEADINGS)
    top = F.element_at(F.array(*[F.lit(h + "\n" if h else "") for h, _, _ in _HEADINGS]), (layout + 1).cast("int"))
    # rows of a table that is one split, or one row group, would all be parsed by one task
    files = _dealt(_t(spark, sf_dir, "customer").select(key.alias("file_id"), layout.alias("h"), F.concat(top, rows).alias("text")))
    out = None
    for row in dict.fromkeys(r for _, r, _ in _HEADINGS):
        own = files.where(F.col("h").isin([i for i, (_, r, _) in enumerate(_HEADINGS) if r == row]))
        part = reader.read_files(_as_files(own, ".csv"), model.ReaderOptions(header_row=row), "CSV")
        out = part if out is None else out.unionByName(part)
    at = lambda i: F.element_at("columns", i)
    return out.select("file_id", "line", at(1).alias("first_name"), at(3).alias("last_name"), F.col("fields")[at(1)].alias("first_value"), F.col("fields")[at(3)].alias("last_value"))


@query(f"""WITH c AS (SELECT *, [',', '|', chr(9), ';'][c_custkey % 4 + 1] AS d FROM customer)
SELECT c_custkey, d AS delimiter FROM c""")
def delimiter_sniff(spark, sf_dir):
    """The delimiter of small files in which the others occur too, within quotes and out of them."""
    @F.pandas_udf("string")
    def sniffed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: parsers.sniff_delimiter(t.splitlines()))

    d, key = F.element_at(F.array(*[F.lit(x) for x in (",", "|", "\t", ";")]), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_custkey").cast("string")
    row = lambda *cells: F.call_function("concat_ws", d, *cells)
    lines = [row(F.lit("no"), F.lit('"a,b;c|d"'), F.lit("n")), *[row(key, F.lit(f'"x{",;|"[i]}y"'), F.lit(str(i) + (" and more" if i == 1 else ""))) for i in range(3)]]
    return _t(spark, sf_dir, "customer").select("c_custkey", sniffed(F.concat_ws("\n", *lines)).alias("delimiter"))
