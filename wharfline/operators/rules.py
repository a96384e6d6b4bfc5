"""Declarative validation rules compiled to Columns that give a violation or null.

Mapping and enrichment issues come first, then rules in their order. Blank values pass every rule but ``required``.
Rules that look at the same (dataset, key) share one join.
"""

from __future__ import annotations

import datetime
import functools
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.text import plain
from ..plans.layout import kept
from ..plans.model import ConfigError, RefCheck, Rule, TargetSchema
from .enrich import OPERATORS
from .mapping import PLACEHOLDER, as_text, blank, gathered, number, render, violation
from .reference import Reference


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _dec(d: Decimal) -> Column:
    return F.lit(d).cast("decimal(18,6)")


def _bound(d: Decimal | None) -> str:
    if d is None:
        return "∞"
    s = format(d.normalize(), "f")
    return s


def flatten(rules: list[Rule]) -> list[Rule]:
    return [x for r in rules for x in ([r, *flatten(list(r.then))] if r.kind == "when" else [r])]


class Compiler:
    def __init__(self, schema: TargetSchema, reference: Reference, today: datetime.date):
        self.schema, self.reference, self.today = schema, reference, today
        self.joins: dict[tuple[str, str], str] = {}

    def text(self, name: str) -> Column:
        return as_text(name, self.schema)

    def num(self, name: str) -> Column:
        return number(name, self.schema)

    def check(self, r: Rule, when: Column | None) -> list[tuple[Column, Column]]:
        """(fires, violation) pairs."""
        if r.kind == "when":
            inside = self.text(r.field)
            hit = ~blank(r.field, self.schema) & F.upper(inside).isin([a.upper() for a in r.allowed])
            return [c for n in r.then for c in self.check(n, hit if when is None else when & hit)]
        out = getattr(self, f"_{r.kind}")(r)
        return [(fires if when is None else when & fires, v) for fires, v in out]

    def _v(self, r: Rule, message: Column, field: str | None = None, severity: str | Column | None = None) -> Column:
        return violation(r.id, field or r.field, severity if severity is not None else r.severity, message)

    def _required(self, r: Rule) -> list:
        return [(blank(r.field, self.schema), self._v(r, F.lit(f"{r.field} is missing")))]

    def _matches(self, r: Rule) -> list:
        t = self.text(r.field)
        message = _say(r.message, " (got '", t, "')") if r.message is not None else _say(f"{r.field} '", t, "' has an invalid format")
        return [(~blank(r.field, self.schema) & ~t.rlike(rf"\A(?:{r.regex})\z"), self._v(r, message))]

    def _range(self, r: Rule) -> list:
        n = self.num(r.field)
        low = n < _dec(r.min) if r.min is not None else F.lit(False)
        high = n > _dec(r.max) if r.max is not None else F.lit(False)
        return [(n.isNotNull() & (low | high), self._v(r, _say(f"{r.field} ", plain(n), f" is outside {_bound(r.min)} to {_bound(r.max)}")))]

    def _datewindow(self, r: Rule) -> list:
        if self.schema.field(r.field) is None or self.schema.field(r.field).type != "DATE":
            return []
        d, day = F.col(r.field), F.col(r.field).cast("string")
        late = d > F.lit(self.today + datetime.timedelta(days=r.max_future_days)) if r.max_future_days is not None else F.lit(False)
        old = d < F.lit(self.today - datetime.timedelta(days=r.max_past_days)) if r.max_past_days is not None else F.lit(False)
        message = F.when(late, _say(f"{r.field} ", day, " is in the future")).otherwise(_say(f"{r.field} ", day, f" is more than {r.max_past_days} days old"))
        return [(d.isNotNull() & (late | old), self._v(r, message))]

    def _oneof(self, r: Rule) -> list:
        t = self.text(r.field)
        return [(~blank(r.field, self.schema) & ~F.upper(t).isin([a.upper() for a in r.allowed]), self._v(r, _say(f"{r.field} '", t, f"' is not one of {', '.join(r.allowed)}")))]

    def _unique(self, r: Rule) -> list:
        first = F.col(f"_first_{r.id}")
        again = first.isNotNull() & (first["seq"] < F.col("seq"))
        return [(F.coalesce(again, F.lit(False)), self._v(r, _say("duplicate of line ", first["line"].cast("string"), f" ({' + '.join(r.fields)})"), r.fields[0]))]

    def _arithmetic(self, r: Rule) -> list:
        if r.op not in OPERATORS:
            raise ConfigError(f"unsupported operator {r.op}")
        actual = self.num(r.field)
        expected = OPERATORS[r.op](self.num(r.left), self.num(r.right))
        allowed = _dec(r.tolerance or Decimal(0))
        if r.tolerance_pct is not None:
            allowed = F.greatest(allowed.cast("decimal(38,6)"), F.round(F.abs(expected).cast("decimal(30,8)") * F.lit(r.tolerance_pct / 100).cast("decimal(8,6)"), 6).cast("decimal(38,6)"))
        off = F.abs(actual - expected) > allowed
        message = _say(f"{r.field} ", plain(actual), f" does not equal {r.left} {r.op} {r.right} = ", plain(F.round(expected, 2)))
        return [(F.coalesce(off, F.lit(False)), self._v(r, message))]

    def _gstin(self, r: Rule) -> list:
        t = self.text(r.field)
        reason = F.when(codes.gstin_format(t), "check digit does not match").otherwise("wrong format")
        return [(~blank(r.field, self.schema) & ~F.coalesce(codes.gstin_valid(t), F.lit(False)), self._v(r, _say("GSTIN '", t, "' is invalid (", reason, ")")))]

    def _reference(self, r: Rule) -> list:
        row, key = F.col(self.joins[(r.dataset, r.key)]), render(r.key, self.schema)
        names = PLACEHOLDER.findall(r.key)
        first = names[0] if names else None
        found = row.isNotNull()
        said = _say(r.message, " (", key, ")") if r.message is not None else _say(key, f" not found in {r.dataset}" if r.must_exist else f" already exists in {r.dataset}")
        out = [(key.isNotNull() & (~found if r.must_exist else found), violation(r.id, first, r.severity, said))]
        return out + ([self._ref(r, c, row, key) for c in r.checks] if r.must_exist else [])

    def _ref(self, r: Rule, c: RefCheck, row: Column, key: Column) -> tuple:
        have = self.reference.columns(r.dataset)
        theirs = lambda n: row[n] if n in have else F.lit(None).cast("string")
        amount = lambda n: theirs(n).try_cast("decimal(18,6)")
        live = key.isNotNull() & row.isNotNull()
        if c.kind == "equals":
            mine, other = self.text(c.field), F.btrim(theirs(c.ref_field).cast("string"))
            differ = ~blank(c.field, self.schema) & other.isNotNull() & (F.upper(mine) != F.upper(other))
            return live & F.coalesce(differ, F.lit(False)), violation(r.id, c.field, c.severity, _say(f"{c.field} '", mine, f"' does not match {c.label or f'{r.dataset} {c.ref_field}'} '", other, "'"))
        mine, other = self.num(c.field), amount(c.ref_field)
        if c.kind == "withinpct":
            off = F.round(F.when(other != 0, F.abs(mine - other) * 100 / F.abs(other)), 2)
            beyond = lambda p: off > _dec(p) if p is not None else F.lit(False)
            level = F.when(beyond(c.error_pct), "ERROR").when(beyond(c.warn_pct), "WARNING")
            side = F.when(mine > other, "above").otherwise("below")
            message = _say(f"{c.field} ", plain(mine), " is ", plain(off), "% ", side, f" {c.label or f'{r.dataset} {c.ref_field}'} ", plain(other))
            return live & level.isNotNull(), violation(r.id, c.field, level, message)
        free = (other - F.coalesce(amount(c.minus), F.lit(Decimal(0)).cast("decimal(18,6)")) if c.minus else other).cast("decimal(18,6)")
        limit = F.round(free * F.lit(1 + c.tolerance_pct / 100).cast("decimal(10,6)"), 6) if c.tolerance_pct is not None else free
        tail = f" (+{_bound(c.tolerance_pct)}% tolerance)" if c.tolerance_pct is not None else ""
        message = _say(f"{c.field} ", plain(mine), f" exceeds {c.label or f'{r.dataset} open quantity'} ", plain(free), tail)
        return live & F.coalesce(mine > limit, F.lit(False)), violation(r.id, c.field, c.severity, message)


def first_seen(df: DataFrame, r: Rule, schema: TargetSchema, condition: Column | None) -> DataFrame:
    """Add ``_first_<id>``: the earliest (seq, line) of the row's file with the same key, where the key occurs more than once.

    Keys that occur again are found first, from the key's fields alone (nothing else of a record is read or mapped for it), by a partial
    aggregate that no key makes uneven. They are kept as a table, which is small next to the records as a rule; Spark knows its size when it plans the join, and
    sends it to the records where it is under the session's threshold for broadcasts, so that whole records are moved only beyond it.
    """
    key = render("|".join(f"{{{f}}}" for f in r.fields), schema)
    key = F.upper(key if condition is None else F.when(condition, key))
    df = df.withColumn("_unique", key)
    seen = df.where("_unique is not null").groupBy(F.col("file_id").alias("_f"), F.col("_unique").alias("_u")).agg(F.min(F.struct("seq", "line")).alias(f"_first_{r.id}"), F.count(F.lit(1)).alias("_n"))
    again = kept(seen.where("_n > 1").drop("_n"))
    return df.join(again, F.col("file_id").eqNullSafe(F.col("_f")) & (F.col("_unique") == F.col("_u")), "left").drop("_f", "_u", "_unique")


def validate(df: DataFrame, rules: list[Rule], schema: TargetSchema, reference: Reference, today: datetime.date, joined: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Add ``violations`` and ``status``; ``issues`` goes, and so do the columns of ``joined``, which hold reference rows that enrichment has looked up already."""
    c = Compiler(schema, reference, today)
    c.joins.update(joined or {})

    def prepare(rs: list[Rule], condition: Column | None) -> None:
        nonlocal df
        for r in rs:
            if r.kind == "when":
                t = as_text(r.field, schema)
                hit = F.coalesce(F.upper(t).isin([a.upper() for a in r.allowed]), F.lit(False))
                prepare(list(r.then), hit if condition is None else condition & hit)
            elif r.kind == "unique":
                df = first_seen(df, r, schema, condition)
            elif r.kind == "reference" and (r.dataset, r.key) not in c.joins:
                name = f"_ref{len(c.joins)}"
                df = reference.join(df, r.dataset, render(r.key, schema), name)
                c.joins[(r.dataset, r.key)] = name

    prepare(rules, None)
    found = [v for r in rules for v in c.check(r, None)]
    # severities have columns of their own, so that a status needs no message; violations are gathered without lambdas, which run without generated code
    levels = {f"_l{i}": F.when(fires, v["severity"]) for i, (fires, v) in enumerate(found)}
    df = df.withColumns({"violations": F.concat("issues", *[gathered(fires, v) for fires, v in found]), **levels})
    has = lambda level: functools.reduce(Column.__or__, [F.coalesce(F.col(n) == level, F.lit(False)) for n in levels], F.exists("issues", lambda v: v["severity"] == level))
    extra = [*levels, *c.joins.values(), *[f"_first_{r.id}" for r in flatten(rules) if r.kind == "unique"], "issues"]
    return df.withColumn("status", F.when(has("ERROR"), "ERROR").when(has("WARNING"), "WARNING").otherwise("VALID")).drop(*extra)


def violations(outcomes: DataFrame, *keep: str, of: str = "violations") -> DataFrame:
    """(keep, v): a row for each violation. An inner explode would push its test for emptiness below the rules, which would then be worked out twice."""
    return outcomes.select(*keep, F.explode_outer(of).alias("v")).where("v is not null")
