"""Jobs: idempotent receipt, spec versions, events, exceptions; store queries as DataFrame functions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..plans.model import ConfigError, MappingSpec, Rule, TargetSchema
from ..plans.transforms import Value, coerce
from .enrich import enrich
from .mapping import violation
from .reference import Reference
from .rules import validate


def receive(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """New files only: the first of each (partner_id, sha256) that no job has, whatever became of that job.

    Where files have an id, only ids are compared and the first one's content is joined back.
    """
    fresh = files.withColumn("sha256", F.sha2("content", 256)).join(jobs.select("partner_id", "sha256"), ["partner_id", "sha256"], "left_anti")
    order = F.struct("received_at", "file_name")
    if "file_id" in fresh.columns:
        first = fresh.groupBy("partner_id", "sha256").agg(F.min_by("file_id", order).alias("file_id"))
        return fresh.join(first, ["partner_id", "sha256", "file_id"])
    keep = F.min_by(F.struct(*[c for c in fresh.columns if c not in ("partner_id", "sha256")]), order)
    return fresh.groupBy("partner_id", "sha256").agg(keep.alias("_f")).select("partner_id", "sha256", "_f.*")


def partner_of(path: Column, root: str) -> Column:
    """The first folder below the inbox, upper-cased."""
    return F.upper(F.element_at(F.split(F.regexp_replace(path, rf"^.*\Q{root.strip('/')}\E/", ""), "/"), 1))


def latest_specs(specs: DataFrame) -> DataFrame:
    """The highest version of each partner's spec."""
    return specs.groupBy("partner_id").agg(F.max("version").alias("version"), F.max_by("spec", "version").alias("spec"))


def next_version(specs: DataFrame) -> DataFrame:
    return specs.groupBy("partner_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def append_events(log: DataFrame, after: int, keep: int = 1000) -> DataFrame:
    """Events after a sequence number, of the last ``keep``."""
    return log.orderBy(F.desc("seq")).limit(keep).where(F.col("seq") > after)


def records_of_job(records: DataFrame, job_id: str, status: str | None = None, limit: int = 500) -> DataFrame:
    picked = records.where(F.col("job_id") == job_id)
    return (picked.where(F.col("status") == status) if status else picked).orderBy("line").limit(limit)


def exceptions_queue(records: DataFrame, partner_id: str | None = None, limit: int = 200) -> DataFrame:
    held = records.where(F.col("status").isin("ERROR", "DEAD_LETTER"))
    return (held.where(F.col("partner_id") == partner_id) if partner_id else held).orderBy(F.desc("record_id")).limit(limit)


def recount(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """Jobs with their counts taken anew from their records."""
    warned = F.exists("violations", lambda v: v["severity"] == "WARNING")
    open_ = F.col("status").isin("ERROR", "DEAD_LETTER")
    counts = records.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(open_).alias("errors"), F.count_if(~open_ & warned).alias("warnings"), F.count_if(~open_ & ~warned).alias("valid"))
    names = ["total", "errors", "warnings", "valid"]
    return jobs.drop(*names).join(counts, "job_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def audit_trail(audit: DataFrame, record_id: str) -> DataFrame:
    return audit.where(F.col("record_id") == record_id).orderBy("at", "audit_id")


def fix(
    records: DataFrame, edits: DataFrame, spec: MappingSpec, schema: TargetSchema, rules: list[Rule], reference: Reference, today: datetime.date, actor: str = "operator"
) -> DataFrame:
    """Records with edits (record_id, field, value) applied, coerced, enriched and validated again.

    A blank or null value empties the field. A value that its type does not take is an error of the record. An edited field's
    lineage names the actor. A field that the schema lacks stops the call. The rules see each record in a file of its
    own, so duplicates within the file do not fire again.
    """
    names = [f.name for f in schema.fields]
    unknown = [r["field"] for r in edits.where(~F.col("field").isin(names)).select("field").distinct().limit(5).collect()]
    if unknown:
        raise ConfigError(f"unknown field {', '.join(map(str, unknown))}")
    said = F.col("value").cast("string")
    wide = edits.groupBy("record_id").pivot("field", names).agg(F.max(F.struct(F.when(~is_blank(said), said).alias("value"))))
    joined = records.join(wide.select("record_id", *[F.col(f"`{n}`").alias(f"_new_{n}") for n in names]), "record_id")
    edited = {n: F.col(f"_new_{n}").isNotNull() for n in names}
    made = {f.name: coerce(Value(F.col(f"_new_{f.name}")["value"]), f.type) for f in schema.fields}
    joined = joined.withColumns({f"_typed_{n}": v.source for n, v in made.items()})
    of = lambda n, part: F.col(f"_typed_{n}")[part] if made[n].failed else F.col(f"_typed_{n}") if part == "v" else F.lit(None).cast("string")
    wrong = [F.when(edited[f.name] & of(f.name, "e").isNotNull(), violation("MAPPING", f.name, "ERROR", F.concat(F.lit(f"{f.label}: "), of(f.name, "e")))) for f in schema.fields]
    traced = F.map_from_entries(F.array_compact(F.array(*[F.when(edited[n], F.struct(F.lit(n).alias("key"), F.array(F.lit(f"edited by {actor}")).alias("value"))) for n in names])))
    kept = F.map_filter("lineage", lambda k, _: ~F.map_contains_key(F.col("_traced"), k))
    fresh = joined.withColumn("_traced", traced).withColumns({
        **{n: F.when(edited[n], of(n, "v")).otherwise(F.col(n)) for n in names},
        "issues": F.array_compact(F.array(*wrong)),
        "lineage": F.map_concat(kept, F.col("_traced")),
    })
    fresh = fresh.drop("_traced", *[f"{p}{n}" for n in names for p in ("_new_", "_typed_")], "violations", "status")
    alone = fresh.withColumn("_file", F.col("file_id")).withColumn("file_id", F.col("record_id").cast("string"))
    out = validate(enrich(alone, spec.enrich, schema, reference), rules, schema, reference, today)
    return out.withColumn("file_id", F.col("_file")).drop("_file")


def audit_of(edits: DataFrame, action: str, actor: str, at: datetime.datetime) -> DataFrame:
    """(audit_id, record_id, action, actor, at, detail): a row for each edit; the id is the digest of the rest, so a step that is tried again writes the same row."""
    made = edits.select("record_id", F.lit(action).alias("action"), F.lit(actor).alias("actor"), F.lit(at).alias("at"), F.to_json(F.struct("*")).alias("detail"))
    return made.select(F.sha2(F.concat_ws("|", *made.columns), 256).alias("audit_id"), *made.columns)


def dismiss(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ``ids`` become DISMISSED, whatever their status."""
    marked = records.join(ids.select("record_id").distinct().withColumn("_hit", F.lit(True)), "record_id", "left")
    return marked.withColumn("status", F.when(F.col("_hit"), "DISMISSED").otherwise(F.col("status"))).drop("_hit")


def replay(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Dead letters of ``ids`` become deliverable again: WARNING if any violation is left, else VALID. Other records stay as they are."""
    marked = records.join(ids.select("record_id").distinct().withColumn("_hit", F.lit(True)), "record_id", "left")
    again = F.col("_hit") & (F.col("status") == "DEAD_LETTER")
    fresh = F.when(F.coalesce(F.size("violations"), F.lit(0)) > 0, "WARNING").otherwise("VALID")
    return marked.withColumn("status", F.when(again, fresh).otherwise(F.col("status"))).drop("_hit")


def recount_touched(jobs: DataFrame, records: DataFrame, touched: DataFrame) -> DataFrame:
    """Jobs with the counts of those taken anew that have a record of ``touched``; only these jobs' records are read."""
    own = records.join(touched.select("record_id").distinct(), "record_id", "left_semi").select("job_id").distinct()
    of = jobs.join(own, "job_id", "left_semi")
    return recount(of, records.join(own, "job_id", "left_semi")).select(*jobs.columns).unionByName(jobs.join(own, "job_id", "left_anti"))


def transition(records: DataFrame, jobs: DataFrame, audit: DataFrame, after: DataFrame, touched: DataFrame, action: str, actor: str, at: datetime.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, jobs, audit) once ``after`` (of :func:`fix`, :func:`dismiss`, :func:`replay`) holds: its rows replace those of the same id, an audit row is
    written for each row of ``touched`` and the jobs concerned are counted anew."""
    names = [c for c in records.columns if c in after.columns]
    rest = records.join(after.select("record_id").distinct(), "record_id", "left_anti")
    now = rest.select(*names).unionByName(after.select(*names))
    return now, recount_touched(jobs, now, touched), audit.unionByName(audit_of(touched, action, actor, at))
