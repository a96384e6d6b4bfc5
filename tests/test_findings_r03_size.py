"""What the third review found of the catalogue's growth: steps whose time grew beyond the limits, told by their plans, and results that stay."""

from pyspark.sql import functions as F

from wharfline import catalog
from wharfline.functions import codes, text
from wharfline.operators import edi, enrich, mapping, rules
from wharfline.plans import model
from wharfline.sources import reader

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_of_a_table_are_mapped_without_a_map(spark):
    """F11 and all that map line items: no map of twelve cells is built and searched for each record, and cells that nothing asks for are not made."""
    shown = plan(catalog.mapped_lines(spark, SF).select("invoiceNumber", "taxAmount"))
    assert " map(" not in shown and "[map(" not in shown and "date_format(" not in shown
    of = lambda df: sorted(map(str, df.select("file_id", "seq", "line", *[f.name for f in catalog.SCHEMA.fields], "lineage", "issues").collect()))
    assert of(catalog.mapped_lines(spark, SF)) == of(mapping.map_records(catalog.invoice_records(spark, SF), catalog.SPEC, catalog.SCHEMA, catalog._CONTEXT, catalog.COLUMNS))


def test_currencies_and_empty_tokens_are_told_without_lambdas(spark):
    """currencies were looked up in a map within a lambda, and each cell in a set of tokens."""
    cells = ["usd", " US$ ", "Rs.", "rs", "chf", "€", "£", "eur", "dollars", "x", "1234", "", None, "N/A", "n.a.", "nıl", "-1", "12345", "--", "---", "----", "9", "#n/a", "NULLS", "null"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    value, error = codes.currency(F.col("c"))
    got = {r["c"]: (r["v"], r["e"]) for r in rows.select("c", value.alias("v"), error.alias("e")).collect()}
    known = {k: v for k, v in codes.CURRENCIES.items()}
    for c in cells:
        key = None if c is None else c.strip().upper()
        want = None if c is None else known.get(key, key if len(key) == 3 and key.isascii() and key.isalpha() else None)
        assert got[c] == (want, f"'{c}' is not a recognised currency" if c is not None and want is None else None), c
    left = {r["c"] for r in rows.where(text.known(F.col("c")).isNotNull()).collect()}
    assert left == {c for c in cells if c and c.upper() not in text.NULL_TOKENS}
    assert "transform(" not in plan(rows.select(value.alias("v"))) and "keys:" not in plan(rows.select(value.alias("v")))


def test_small_files_are_dealt_over_tasks(spark):
    """a table that is one split, or one row group, had all its files parsed by one task."""
    assert "Repartition " in plan(catalog.table_headings(spark, SF))


def test_records_are_made_in_arrow_batches(spark):
    """records and their columns are the parser's, over batch ends too."""
    text_of = lambda n: "a,b\n" + "".join(f"{i}{n},x{i}\n" for i in range(n))
    files = spark.createDataFrame([(str(n), f"{n}.csv", text_of(n).encode()) for n in (0, 3, 12000)], "file_id string, file_name string, content binary").coalesce(1)
    out = reader.read_files(files, model.ReaderOptions(), "CSV")
    assert "MapInArrow" in plan(out)
    got = {(r["file_id"], r["seq"], r["line"], tuple(r["fields"].items()), tuple(r["columns"])) for r in out.collect()}
    assert got == {(str(n), i, i + 2, (("a", f"{i}{n}"), ("b", f"x{i}")), ("a", "b")) for n in (3, 12000) for i in range(n)}


def test_rules_use_the_rows_that_enrichment_looked_up(spark):
    """the catalogue was joined twice by the same key, so that whole records were moved twice where it is too large to be sent to them."""
    for name in ("price_variance_bands", "open_quantity_atmost"):
        assert plan(catalog.queries()[name](spark, SF)).count("Join LeftOuter") == 2  # the catalogue and the rates
    steps = (model.Lookup("catalog", "{sku}", {"description": "description"}, False), model.Lookup("catalog", "{description}", {"sku": "sku"}, False))
    assert enrich.shared(steps[:1], {("catalog", "{sku}")}) == {("catalog", "{sku}"): "_row0"}
    assert enrich.shared(steps, {("catalog", "{sku}"), ("fx", "{currency}")}) == {}  # the key is changed after the look-up


def test_documents_are_read_once(spark):
    """a path for each value read the whole document again."""
    shown = plan(catalog.export_json(spark, SF))
    assert "get_json_object" not in shown and shown.count("from_json(") == 1


def test_first_pass_for_duplicates_maps_the_keys_alone(spark):
    """F8: the first of the two passes over the records made all twelve cells of each, of which it needs two."""
    line = rules.first_seen(catalog.mapped_lines(spark, SF), next(r for r in catalog.RULES if r.id == "DUP"), catalog.SCHEMA, None)
    assert "_first_DUP" in line.columns
    keys = plan(catalog.mapped_lines(spark, SF).select("file_id", "invoiceNumber", "lineNumber"))
    assert "date_format(" not in keys and "format_number(" not in keys


def test_segments_are_put_by_their_names():
    """segments are plain tuples, elements are stripped once and the names of keys are kept."""
    into: dict[str, str] = {}
    for s in (edi.Segment(1, "REF", ("PO", " 7 ", "")), edi.Segment(2, "REF", ("", "8")), edi.Segment(3, "BIG", ("a", " ", "c")), edi.Segment(4, "BIG", ("z",))):
        edi._put(into, s)
    assert into == {"REF.PO.02": "7", "REF02": "8", "BIG01": "a", "BIG03": "c"}
    assert isinstance(edi.Segment(1, "ST", ()), tuple) and edi._key.cache_info().currsize > 0
