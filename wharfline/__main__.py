"""Commands over files: ``process``, ``suggest`` and ``ack997``.

    python -m wharfline process --config DIR --partner NAME [--today YYYY-MM-DD] [--json FOLDER] PATH
    python -m wharfline suggest --config DIR --schema NAME [--locale US|IN] [--record NAME] PATH
    python -m wharfline ack997 PATH

PATH is a file or a folder of files; each command reads all of them in one Spark job. A configuration folder holds
``specs/PARTNER.json``, ``schemas/NAME.json``, ``rules/NAME.json``, ``lookups.json`` and ``reference/reference-data.json``.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime
import itertools
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import edi, pipeline, suggest
from .operators.reference import TEMPLATES, Reference
from .plans import model
from .plans.layout import kept, spread
from .plans.transforms import Context
from .ship import ship
from .sources import reader


def _json(path: Path) -> dict:
    return model.parse_json(path.read_text(encoding="utf-8")) if path.exists() else {}


def reference_data(spark: SparkSession, tables: dict[str, list[dict]]) -> Reference:
    """Datasets from lists of rows; a column is decimal where all its values are numbers, else text."""
    out = {}
    for name, rows in tables.items():
        if name not in TEMPLATES or not rows:
            continue
        columns = list(dict.fromkeys(k for r in rows for k in r))
        number = {c: all(not isinstance(r.get(c), (str, bool)) for r in rows) for c in columns}
        shown = [tuple(None if r.get(c) is None else str(r[c]) for c in columns) + (i,) for i, r in enumerate(rows)]
        df = spark.createDataFrame(shown, ", ".join(f"`{c}` string" for c in columns) + ", _order int")
        out[name] = df.withColumns({c: F.col(c).cast("decimal(18,8)") for c in columns if number[c]})
    return Reference.load(out, "_order")


def process(spark: SparkSession, config: Path, partner: str, path: str, today: datetime.date) -> tuple[DataFrame, DataFrame, DataFrame, model.TargetSchema]:
    """(outcomes, file summary, file issues, schema) of all files of a partner."""
    spec = model.load_spec(_json(config / "specs" / f"{partner}.json"))
    schema = model.load_schema(_json(config / "schemas" / f"{spec.schema}.json"))
    rules = model.load_rules(_json(config / "rules" / f"{spec.schema}.json"))
    context = Context(model.load_lookups(_json(config / "lookups.json")))
    reference = reference_data(spark, _json(config / "reference" / "reference-data.json"))
    files = reader.binary_files(spark, path)
    records, meta = reader.read_files(files, spec.reader, spec.format), reader.read_meta(files, spec.reader, spec.format)
    outcomes = pipeline.run(spread(records), spec, schema, rules, reference, context, today)
    summary = pipeline.file_summary(outcomes)
    declared = meta.select("file_id", F.try_element_at("totals", F.lit("lineCount")).alias("declared"))
    unread = meta.where("error is not null").select("file_id", F.lit("READ").alias("rule"), F.lit("ERROR").alias("severity"), F.col("error").alias("message"))
    return outcomes, summary, pipeline.control_totals(summary, declared).unionByName(unread), schema


def _show(df: DataFrame, *order: str) -> None:
    for r in df.orderBy(*order).toLocalIterator():
        print("  ".join("-" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="wharfline")
    commands = parser.add_subparsers(dest="command", required=True)
    p, s, a = (commands.add_parser(n) for n in ("process", "suggest", "ack997"))
    for c in (p, s):
        c.add_argument("--config", type=Path, default=Path())
    p.add_argument("--partner", required=True)
    p.add_argument("--today", type=datetime.date.fromisoformat, default=None)
    p.add_argument("--json")
    s.add_argument("--schema", required=True)
    s.add_argument("--locale", default="IN")
    s.add_argument("--record")
    for c in (p, s, a):
        c.add_argument("path")
    o = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("wharfline").getOrCreate()
    ship(spark)
    if o.command == "process":
        outcomes, summary, issues, schema = process(spark, o.config, o.partner, o.path, o.today or datetime.date.today())
        shown = F.transform("violations", lambda v: F.concat_ws(" ", v["severity"], v["rule"], v["message"]))
        _show(outcomes.select("file_id", "line", "status", F.array_join(shown, "; ").alias("said")), "file_id", "line")
        _show(summary.select("file_id", "total", "valid", "warnings", "errors"), "file_id")
        _show(issues.select("file_id", F.lit("FILE").alias("kind"), "rule", "message"), "file_id", "rule")
        if o.json:
            pipeline.export_json(outcomes, schema).write.mode("errorifexists").text(o.json)
    elif o.command == "suggest":
        schema, options = model.load_schema(_json(o.config / "schemas" / f"{o.schema}.json")), model.ReaderOptions()
        if o.record:
            options = dataclasses.replace(options, record_segment=o.record, record_element=o.record)
        files = reader.binary_files(spark, o.path)
        meta = reader.read_meta(files, options)
        reports = kept(suggest.suggest_files(suggest.profile(reader.read_files(files, options)), meta, schema, o.locale).join(meta.select("file_id", "format", "columns"), "file_id"))
        place = {f.name: i for i, f in enumerate(schema.fields)}
        turn = F.try_element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("target"))
        last = None
        for x in itertools.chain(reports.orderBy("file_id", turn).toLocalIterator(), [None]):
            if last is not None and (x is None or x["file_id"] != last["file_id"]):
                print(f"  unused columns: {list(last['unused'])}\n  missing required: {list(last['missing'])}")
            if x is not None and (last is None or x["file_id"] != last["file_id"]):
                print(f"{x['file_id']}: format {x['format']}, columns {list(x['columns'] or [])}")
            if x is not None:
                print(f"  {x['target']:<14} <- {' + '.join(x['sources']) or '-':<40} {x['confidence']:.2f} {x['band']:<6} {'[' + x['transform'] + ']' if x['transform'] else ''}".rstrip())
            last = x
    else:
        texts = reader.binary_files(spark, o.path).select("file_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        for r in edi.acknowledge_files(texts).orderBy("interchange").toLocalIterator():
            print(r["ack"] or f"{r['file_id']}: no interchange", end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
