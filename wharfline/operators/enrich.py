"""Enrichment in the order of the spec: lookups, currency conversion, computed fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..plans.model import Compute, ConfigError, Convert, Lookup, TargetSchema
from .mapping import PLACEHOLDER, SPARK_TYPES, number, render, violation
from .reference import Reference

OPERATORS = {"*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b}


def _trace(df: DataFrame, where: Column, target: str, sources: Column) -> Column:
    own = F.map_filter("lineage", lambda k, _: k != target)
    return F.when(where, F.map_concat(own, F.create_map(F.lit(target), sources))).otherwise(F.col("lineage"))


def targets(step: Lookup | Convert | Compute) -> set[str]:
    return set(step.copy) if isinstance(step, Lookup) else {step.target}


def shared(steps: tuple[Lookup | Convert | Compute, ...], asked: set[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """Columns for the rows of those lookups whose (dataset, key) is asked for again after enrichment, and whose key no later or own step changes."""
    out = {}
    for i, step in enumerate(steps):
        if isinstance(step, Lookup) and (step.dataset, step.key) in asked:
            changed = set().union(*[targets(s) for s in steps[i:]])
            if not changed & set(PLACEHOLDER.findall(step.key)):
                out.setdefault((step.dataset, step.key), f"_row{len(out)}")
    return out


def enrich(df: DataFrame, steps: tuple[Lookup | Convert | Compute, ...], schema: TargetSchema, reference: Reference, keep: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """``keep`` names the columns (see :func:`shared`) in which rows that were looked up stay, so that nothing that follows joins them again."""
    held = keep or {}
    for step in steps:
        if isinstance(step, Lookup):
            df = lookup(df, step, schema, reference, held.get((step.dataset, step.key)))
        elif isinstance(step, Convert):
            df = convert(df, step, schema, reference)
        else:
            df = compute(df, step, schema)
    return df


def lookup(df: DataFrame, step: Lookup, schema: TargetSchema, reference: Reference, keep: str | None = None) -> DataFrame:
    row = keep or "_row"
    if row not in df.columns:
        df = reference.join(df, step.dataset, render(step.key, schema), row)
    have = reference.columns(step.dataset)
    for target, column in step.copy.items():
        if column not in have:
            continue
        fresh = F.col(row)[column].cast(SPARK_TYPES[schema.field(target).type])
        take = fresh.isNotNull() & (is_blank(F.col(target).cast("string")) if step.only_if_blank else F.lit(True))
        df = df.withColumn("_take", take).withColumn(target, F.when(F.col("_take"), fresh).otherwise(F.col(target)))
        df = df.withColumn("lineage", _trace(df, F.col("_take"), target, F.array(F.lit(f"{step.dataset}.{column}")))).drop("_take")
    return df if keep else df.drop(row)


def convert(df: DataFrame, step: Convert, schema: TargetSchema, reference: Reference) -> DataFrame:
    amount, currency = number(step.amount, schema), F.col(step.currency)
    df = reference.join(df, "fx", currency, "_fx")
    rate = F.col("_fx")["rate"].cast("decimal(18,8)") if "rate" in reference.columns("fx") else F.lit(None).cast("decimal(18,8)")
    ready = amount.isNotNull() & currency.isNotNull()
    same = ready & (F.upper(currency) == step.base.upper())
    turned = ready & ~same & rate.isNotNull()
    lost = ready & ~same & rate.isNull()
    value = F.when(same, amount).when(turned, F.round(amount * rate, 2)).otherwise(F.col(step.target)).cast("decimal(18,6)")
    sources = F.when(same, F.array(F.lit(step.amount))).otherwise(F.array(F.lit(step.amount), F.concat(F.lit("fx."), currency)))
    issue = violation("FX_RATE", step.target, "WARNING", F.concat(F.lit("no FX rate for "), currency, F.lit(f" to {step.base}")))
    out = {"lineage": _trace(df, same | turned, step.target, sources), "issues": F.when(lost, F.concat("issues", F.array(issue))).otherwise(F.col("issues")), step.target: value}
    return df.withColumns(out).drop("_fx")


def compute(df: DataFrame, step: Compute, schema: TargetSchema) -> DataFrame:
    left, right = number(step.left, schema), number(step.right, schema)
    if step.op == "/":
        result = F.round(F.round(F.try_divide(left, right), min(step.scale + 4, 18)), step.scale)
    elif step.op in OPERATORS:
        result = F.round(OPERATORS[step.op](left, right), step.scale)
    else:
        raise ConfigError(f"unsupported operator {step.op}")
    result = result.try_cast(SPARK_TYPES["DECIMAL"])
    fresh = F.col(step.target).isNull() & result.isNotNull()
    trace = _trace(df, fresh, step.target, F.array(F.lit(f"computed: {step.left} {step.op} {step.right}")))
    return df.withColumns({"lineage": trace, step.target: F.coalesce(F.col(step.target), result.cast(SPARK_TYPES[schema.field(step.target).type]))})
