"""Read, map, enrich, validate and summarise; statuses of records, files and jobs."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import MappingSpec, Rule, TargetSchema
from ..plans.transforms import Context
from .enrich import enrich, shared
from .mapping import map_records
from .reference import Reference
from .rules import flatten, validate


def run(records: DataFrame, spec: MappingSpec, schema: TargetSchema, rules: list[Rule], reference: Reference, context: Context, today: datetime.date, columns: list[str] | None = None) -> DataFrame:
    """Records with typed columns, lineage, violations and status, in one plan; only ``unique`` rules act before it, to find the keys that occur again."""
    mapped = map_records(records, spec, schema, context, columns)
    joined = shared(spec.enrich, {(r.dataset, r.key) for r in flatten(rules) if r.kind == "reference"})
    return validate(enrich(mapped, spec.enrich, schema, reference, joined), rules, schema, reference, today, joined)


def file_summary(outcomes: DataFrame, keys: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Totals for each file; the error rate is 0 for an empty one."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), n("VALID").alias("valid"), n("WARNING").alias("warnings"), n("ERROR").alias("errors"))
    return out.withColumn("error_rate", F.col("errors") / F.greatest(F.col("total"), F.lit(1)))


def control_totals(summary: DataFrame, declared: DataFrame) -> DataFrame:
    """(file_id, rule, severity, message) where the declared count of lines is not what was read, or is no number."""
    joined = declared.join(summary.select("file_id", "total"), "file_id", "left")
    n = F.col("declared").try_cast("long")
    read = F.coalesce("total", F.lit(0))
    message = F.when(n.isNull(), F.concat(F.lit("file declares '"), F.col("declared"), F.lit("' line items, which is not a number"))).otherwise(
        F.concat(F.lit("file declares "), n.cast("string"), F.lit(" line items but "), read.cast("string"), F.lit(" were read"))
    )
    bad = joined.where(F.col("declared").isNotNull() & (n.isNull() | (n != read)))
    return bad.select("file_id", F.lit("CONTROL_TOTAL").alias("rule"), F.lit("WARNING").alias("severity"), message.alias("message"))


def job_status(total: Column, errors: Column, has_ack: Column) -> Column:
    return F.when(total == 0, F.when(has_ack, "REJECTED").otherwise("FAILED")).when(errors == 0, "COMPLETED").otherwise("NEEDS_REVIEW")


def export_json(outcomes: DataFrame, schema: TargetSchema) -> DataFrame:
    """One JSON document for each record: line, status, values, lineage, violations."""
    values = F.struct(*[F.col(f.name) for f in schema.fields])
    return outcomes.select(F.to_json(F.struct("line", "status", values.alias("values"), "lineage", "violations")).alias("json"))


def delivered_payload(outcomes: DataFrame, schema: TargetSchema) -> Column:
    """The values with the record's id, its partner and the messages of its warnings."""
    warnings = F.transform(F.filter("violations", lambda v: v["severity"] == "WARNING"), lambda v: v["message"])
    return F.to_json(F.struct(*[F.col(f.name) for f in schema.fields], F.col("record_id").alias("_recordId"), F.col("partner_id").alias("_partner"), warnings.alias("_warnings")))
