"""Source records to canonical typed columns, with lineage and mapping issues.

A record DataFrame has ``file_id, seq, line, fields map<string,string>, columns array<string>``. The mapped one
has the schema's columns in place of ``fields``, ``lineage map<string,array<string>>`` and ``issues``. Records of a table whose
column names are known may have their cells as columns of their own, by those names after CELL, in place of ``fields`` and ``columns``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts
from ..functions.text import is_blank, known, normalize_key, plain, strip, stripped, trimmed
from ..plans.model import VIOLATION, ConfigError, FieldMapping, MappingSpec, TargetSchema
from ..plans.transforms import Context, Value, apply_transform, coerce, compile_transform, decimal

SPARK_TYPES = {"STRING": "string", "INTEGER": "bigint", "DECIMAL": amounts.DECIMAL, "DATE": "date", "BOOLEAN": "boolean"}
KINDS = {"STRING": "text", "INTEGER": "long", "DECIMAL": "decimal", "DATE": "date", "BOOLEAN": "bool"}
#: Columns that every record has beside its schema's.
RESERVED = {"file_id", "seq", "line", "fields", "columns", "lineage", "issues", "violations", "status"}
#: What the names of cells begin with where they are columns, so that they are not taken for a record's own.
CELL = "cell "
PLACEHOLDER = re.compile(r"\{([A-Za-z0-9_]+)\}")


def violation(rule: str, field: str | None, severity: str | Column, message: Column) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(rule).alias("rule"), F.lit(field).cast("string").alias("field"), level.alias("severity"), message.alias("message"))


def gathered(fires: Column, v: Column) -> Column:
    """An array of the violation where it fires, else an empty one."""
    return F.when(fires, F.array(v)).otherwise(none_yet())


def none_yet() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


def normal(name: str) -> str:
    """The driver's twin of :func:`normalize_key`, for names of columns known when the plan is built."""
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", s).lower()
    return re.sub("[^a-z0-9#₹$%]+", " ", s).strip()


def check_spec(spec: MappingSpec, schema: TargetSchema) -> None:
    """Unknown targets and transforms fail here, named."""
    clash = sorted({f.name for f in schema.fields} & RESERVED)
    if clash:
        raise ConfigError(f"schema {schema.name} has fields with names of record columns: {', '.join(clash)}")
    unknown = [m.target for m in spec.fields if schema.field(m.target) is None]
    if unknown:
        raise ConfigError(f"spec for {spec.partner_id} maps fields that are not in schema {schema.name}: {', '.join(unknown)}")
    for m in spec.fields:
        compile_transform(m.transform)


def named(source: str, columns: list[str]) -> str | None:
    """The column of that name, or the first with the same normalised name."""
    return source if source in columns else next((c for c in columns if normal(c) == normal(source)), None)


def resolve(source: str, columns: list[str] | None) -> Column:
    """The record's column of that name, or the first with the same normalised name; null if there is none."""
    if columns is not None:
        return F.lit(named(source, columns)).cast("string")
    alike = F.get(F.filter("columns", lambda c: normalize_key(c) == normal(source)), F.lit(0))
    return F.when(F.map_contains_key("fields", F.lit(source)), F.lit(source)).otherwise(alike)


def _cell(name: str | None) -> Column:
    return F.lit(None).cast("string") if name is None else F.col("`" + (CELL + name).replace("`", "``") + "`")


def _source(m: FieldMapping, names: list[Column], parts: list[Column]) -> tuple[Value, Column]:
    """The raw value and the lineage of a field whose sources have these names and cleaned values, or amounts where they are added up; all are columns."""
    if m.const is not None:
        return Value(F.lit(m.const)), F.array(F.lit("const"))
    used = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    lineage = F.when(F.size(used) > 0, used).otherwise(F.array(*[F.lit(s) for s in m.sources]).cast("array<string>"))
    if not parts:
        return Value(F.lit(None).cast("string")), lineage
    if m.join == "+":
        bad, some = F.coalesce(*[p["e"] for p in parts]), F.coalesce(*[p["v"] for p in parts])
        sums = F.lit(0).cast(amounts.DECIMAL)
        for p in parts:
            sums = (sums + F.coalesce(p["v"], F.lit(0).cast(amounts.DECIMAL))).cast(amounts.DECIMAL)
        return Value(F.struct(F.when(bad.isNull() & some.isNotNull(), sums).alias("v"), bad.alias("e")), "decimal", True), lineage
    if len(parts) == 1:
        return Value(parts[0], bound=True), lineage
    return Value(F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(m.join, *parts))), lineage


def map_records(records: DataFrame, spec: MappingSpec, schema: TargetSchema, context: Context, columns: list[str] | None = None) -> DataFrame:
    """Map in one stage; ``columns``, where known, settles column names when the plan is built.

    Source cells are cleaned in projections of their own, so that generated code, and no lambda, computes each once. Records without ``fields`` have
    their cells as columns: no map is built and searched for each record, and cells that nothing asks for are not made.
    """
    check_spec(spec, schema)
    wide = columns is not None and "fields" not in records.columns
    own = [c for c in records.columns if c not in ("fields", "columns", *([CELL + c for c in columns] if wide else ()))]
    sources = list(dict.fromkeys(s for m in spec.fields if m.const is None for s in m.sources))
    at = {s: i for i, s in enumerate(sources)}
    names = {s: resolve(s, columns) for s in sources}
    if columns is None:
        records = records.select(*own, "fields", *[n.alias(f"_n_{at[s]}") for s, n in names.items()])
        names = {s: F.col(f"_n_{i}") for s, i in at.items()}
    shown = [F.col(f"_n_{i}") for i in at.values()] if columns is None else []
    cell = lambda s: _cell(named(s, columns)) if wide else F.col("fields")[names[s]]
    records = records.select(*own, *shown, *[cell(s).alias(f"_r_{i}") for s, i in at.items()])
    records = records.select(*own, *shown, *[stripped(F.col(f"_r_{i}")).alias(f"_s_{i}") for i in at.values()])
    records = records.select(*own, *shown, *[known(F.col(f"_s_{i}")).alias(f"_c_{i}") for i in at.values()])
    added = list(dict.fromkeys(at[s] for m in spec.fields if m.const is None and m.join == "+" for s in m.sources))
    if added:
        records = records.select("*", *[amounts.amount(F.col(f"_c_{i}")).alias(f"_a_{i}") for i in added])
    values, lineage, errors, parsed = {}, [], [], []
    for m in spec.fields:
        target = schema.field(m.target)
        given = m.sources if m.const is None else ()
        raw, used = _source(m, [names[s] for s in given], [F.col(f"_{'a' if m.join == '+' else 'c'}_{at[s]}") for s in given])
        out = apply_transform(m.transform, raw, context)
        if target.type == "INTEGER":  # the amount first, then whether it is whole
            amount = decimal(out)
            parsed.append(amount.source.alias(f"_t_{m.target}"))
            out = Value(F.col(f"_t_{m.target}"), amount.kind, amount.failed, bound=True)
        out = coerce(out, target.type)
        values[m.target] = out
        lineage += [F.lit(m.target), used]
        if out.failed:
            errors.append((m.target, target.label))
    keep = own
    if parsed:
        records = records.select("*", *parsed)
    made = records.select(*keep, *[v.source.alias(f"_m_{t}") for t, v in values.items()], (F.create_map(*lineage) if lineage else F.create_map().cast("map<string,array<string>>")).alias("lineage"))
    typed = []
    for f in schema.fields:
        c = F.lit(None) if f.name not in values else F.col(f"_m_{f.name}")["v"] if values[f.name].failed else F.col(f"_m_{f.name}")
        typed.append(c.cast(SPARK_TYPES[f.type]).alias(f.name))
    wrong = lambda name: F.col(f"_m_{name}")["e"]
    found = [gathered(wrong(name).isNotNull(), violation("MAPPING", name, "ERROR", F.concat(F.lit(f"{label}: "), wrong(name)))) for name, label in errors]
    issues = F.concat(*found) if found else none_yet()
    return made.select(*keep, *typed, "lineage", issues.alias("issues"))


def render(template: str, schema: TargetSchema) -> Column:
    """A key such as ``{poNumber}|{sku}``; null if any placeholder is blank."""
    parts, ready, at = [], [], 0
    for m in PLACEHOLDER.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(as_text(m[1], schema))
        ready.append(~blank(m[1], schema))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    ok = F.lit(True)
    for r in ready:
        ok = ok & r
    return F.when(ok, F.concat(*parts))


def as_text(name: str, schema: TargetSchema) -> Column:
    """A value as rules show it: decimals without trailing zeros, other values stripped."""
    field = schema.field(name)
    if field is None:
        return F.lit(None).cast("string")
    if field.type == "DECIMAL":
        return plain(F.col(name))
    return trimmed(F.col(name)) if field.type == "STRING" else F.col(name).cast("string")


def blank(name: str, schema: TargetSchema) -> Column:
    """Whether a value has no text; only strings are looked into, and trimmed only where they do not begin with a mark, letter or digit of ASCII."""
    field, c = schema.field(name), F.col(name)
    if field is None:
        return F.lit(True)
    return F.when((c >= "!") & (c < "\x7f"), False).otherwise(is_blank(c)) if field.type == "STRING" else c.isNull()


def number(name: str | None, schema: TargetSchema) -> Column:
    field = schema.field(name) if name else None
    if field is None:
        return F.lit(None).cast(amounts.DECIMAL)
    return F.col(name) if field.type == "DECIMAL" else strip(F.col(name).cast("string")).try_cast(amounts.DECIMAL)


def business_key(schema: TargetSchema) -> Column:
    return render("|".join(f"{{{k}}}" for k in schema.business_key), schema) if schema.business_key else F.lit(None).cast("string")
