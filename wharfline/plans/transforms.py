"""The transform language: ``step ('|' step)*`` with ``step := name['(' arg (',' arg)* ')']``, compiled to Columns.

Every step takes and returns a value with its kind and an error text, so a bad value becomes null and a message
and never fails the job. Names are open: :func:`register` adds one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import amounts, codes, dates
from ..functions.text import collapse, is_blank, let, plain, strip, title
from .model import ConfigError



@dataclass(frozen=True)
class Value:
    """A typed value: kind is text, decimal, date, bool or long. With ``failed`` the column is struct(v, e); ``bound``: it is a column by name, which costs nothing to name again."""

    source: Column
    kind: str = "text"
    failed: bool = False
    bound: bool = False

    @property
    def column(self) -> Column:
        return self.source["v"] if self.failed else self.source

    @property
    def error(self) -> Column | None:
        return self.source["e"] if self.failed else None

    def then(self, f: Callable[[Column], Column], kind: str) -> Value:
        """A step that cannot fail."""
        if not self.failed:
            return Value(f(self.source), kind)
        return Value(self.let(lambda p: F.struct(F.when(p["e"].isNull(), f(p["v"])).alias("v"), p["e"].alias("e"))), kind, True)

    def let(self, body: Callable[[Column], Column]) -> Column:
        return body(self.source) if self.bound else let(self.source, body)

    def attempt(self, f: Callable[[Column], Column], kind: str) -> Value:
        """A step whose result is struct(v, e)."""
        if not self.failed:
            return Value(f(self.source), kind, True)
        after = lambda p: F.when(p["e"].isNull(), f(p["v"])).otherwise(F.struct(F.lit(None).cast(TYPES[kind]).alias("v"), p["e"].alias("e")))
        return Value(self.let(after), kind, True)

    def shown(self, c: Column) -> Column:
        return c if self.kind == "text" else plain(c) if self.kind == "decimal" else c.cast("string")


TYPES = {"text": "string", "decimal": amounts.DECIMAL, "date": "date", "bool": "boolean", "long": "bigint"}


def outcome(value: Column, error: Column) -> Column:
    return F.struct(value.alias("v"), error.cast("string").alias("e"))


@dataclass(frozen=True)
class Context:
    lookups: dict[str, dict[str, str]]


Step = Callable[[Value, list[str], Context], Value]
REGISTRY: dict[str, Step] = {}


def register(name: str, step: Step) -> None:
    REGISTRY[name.lower()] = step


def _text(f: Callable[[Column, list[str]], Column], least: int = 0) -> Step:
    def step(v: Value, args: list[str], _: Context) -> Value:
        return v.then(lambda c: f(v.shown(c), args), "text")

    return _needs(step, least)


def _needs(step: Step, least: int) -> Step:
    step.least = least  # type: ignore[attr-defined]
    return step


def decimal(v: Value) -> Value:
    if v.kind == "decimal":
        return v
    if v.kind == "long":
        return v.then(lambda c: c.cast(amounts.DECIMAL), "decimal")
    return v.attempt(lambda c: amounts.amount(v.shown(c)), "decimal")


def _number(f: Callable[[Column, list[str]], Column]) -> Step:
    return _needs(lambda v, args, _: decimal(v).then(lambda c: f(c, args).try_cast(amounts.DECIMAL), "decimal"), 1)


def _divide(v: Value, args: list[str], _: Context) -> Value:
    by = F.lit(args[0]).cast(amounts.DECIMAL)
    if float(args[0]) == 0:
        return decimal(v).attempt(lambda c: outcome(F.lit(None).cast(amounts.DECIMAL), F.when(c.isNotNull(), F.lit("/ by zero"))), "decimal")
    return decimal(v).then(lambda c: F.round(F.try_divide(c, by), 6).try_cast(amounts.DECIMAL), "decimal")


def _extract(c: Column, args: list[str]) -> Column:
    groups = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", args[0])).groups
    group = int(args[1]) if len(args) > 1 else (1 if groups else 0)
    return F.when(c.rlike(args[0]), F.regexp_extract(c, args[0], group))


def _split(c: Column, args: list[str]) -> Column:
    parts = F.split(c, r"\Q" + args[0] + r"\E", -1)
    i = int(args[1]) if len(args) > 1 else 0
    return strip(F.get(parts, F.lit(i) if i >= 0 else F.size(parts) + i))


def _date(v: Value, args: list[str], _: Context) -> Value:
    return v if v.kind == "date" else v.attempt(lambda c: dates.date(v.shown(c), args or None), "date")


def _implied(v: Value, args: list[str], _: Context) -> Value:
    places = F.lit(10 ** int(args[0])).cast("decimal(20,0)")

    def moved(c: Column) -> Column:
        number = lambda s: F.when(s.rlike(r"^-?\d+(\.\d+)?\z"), (s.try_cast("decimal(38,6)") / places).try_cast(amounts.DECIMAL))
        made = lambda s: let(number(s), lambda n: outcome(n, F.when(s.isNotNull() & n.isNull(), F.concat(F.lit("'"), s, F.lit("' is not a number")))))
        return let(F.regexp_replace(strip(v.shown(c)), r"^\+", ""), made)

    return v.attempt(moved, "decimal")


def _lookup(v: Value, args: list[str], context: Context) -> Value:
    table = context.lookups.get(args[0], {})
    codes_ = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    hit = lambda s: F.try_element_at(codes_, F.upper(strip(s)))
    if len(args) > 1:
        other = (lambda s: s) if args[1] == "*" else (lambda s: F.when(s.isNotNull(), F.lit(args[1])))
        return v.then(lambda c: F.coalesce(hit(v.shown(c)), other(v.shown(c))), "text")
    said = lambda s, h: F.when(s.isNotNull() & h.isNull(), F.concat(F.lit("'"), s, F.lit(f"' is not a known value in '{args[0]}'")))
    return v.attempt(lambda c: let(v.shown(c), lambda s: let(hit(s), lambda h: outcome(h, said(s, h)))), "text")


def _coded(f: Callable[[Column], tuple[Column, Column]], kind: str) -> Step:
    made = lambda s: outcome(*f(s))
    return lambda v, args, _: v.attempt(lambda c: made(c) if v.bound and v.kind == "text" else let(v.shown(c), made), kind)


def _default(v: Value, args: list[str], _: Context) -> Value:
    return v.then(lambda c: let(v.shown(c), lambda s: F.when(is_blank(s), F.lit(args[0])).otherwise(s)), "text")


def _nullif(v: Value, args: list[str], _: Context) -> Value:
    return v.then(lambda c: F.when(~F.upper(strip(v.shown(c))).isin([a.upper() for a in args]), c), v.kind)


def _amount(v: Value, args: list[str], _: Context) -> Value:
    return decimal(v)


for _name, _step in {
    "trim": _text(lambda c, a: strip(c)),
    "upper": _text(lambda c, a: F.upper(c)),
    "lower": _text(lambda c, a: F.lower(c)),
    "collapse": _text(lambda c, a: collapse(c)),
    "title": _text(lambda c, a: title(c)),
    "digits": _text(lambda c, a: F.regexp_replace(c, r"\D", "")),
    "alnum": _text(lambda c, a: F.regexp_replace(c, "[^A-Za-z0-9]", "")),
    "nullif": _nullif,
    "default": _needs(_default, 1),
    "prefix": _text(lambda c, a: F.concat(F.lit(a[0]), c), 1),
    "suffix": _text(lambda c, a: F.concat(c, F.lit(a[0])), 1),
    "replace": _text(lambda c, a: F.regexp_replace(c, a[0], a[1] if len(a) > 1 else ""), 1),
    "extract": _text(_extract, 1),
    "left": _text(lambda c, a: F.substring(c, 1, int(a[0])), 1),
    "right": _text(lambda c, a: F.right(c, F.lit(int(a[0]))), 1),
    "split": _text(_split, 1),
    "amount": _amount,
    "number": _amount,
    "round": _number(lambda c, a: F.round(c, int(a[0]))),
    "mul": _number(lambda c, a: c * F.lit(a[0]).cast(amounts.DECIMAL)),
    "div": _needs(_divide, 1),
    "implied": _needs(_implied, 1),
    "date": _date,
    "currency": _coded(codes.currency, "text"),
    "lookup": _needs(_lookup, 1),
    "bool": _coded(codes.yes_no, "bool"),
}.items():
    register(_name, _step)


def split_top(s: str, separator: str) -> list[str]:
    """Split where the separator stands outside quotes and brackets; a backslash escapes inside quotes."""
    parts, depth, quote, at = [""], 0, "", 0
    while at < len(s):
        ch = s[at]
        if quote:
            if ch == "\\" and at + 1 < len(s):
                parts[-1] += ch
                at += 1
                ch = s[at]
            elif ch == quote:
                quote = ""
        elif ch in "'\"":
            quote = ch
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == separator and not depth:
            parts.append("")
            at += 1
            continue
        parts[-1] += ch
        at += 1
    return parts


def _unquote(s: str) -> str:
    if len(s) > 1 and s[0] in "'\"" and s[-1] == s[0]:
        return s[1:-1].replace("\\" + s[0], s[0])
    return s


def compile_transform(expression: str) -> list[tuple[str, list[str]]]:
    """(name, arguments) of each step; unknown names and missing arguments fail here, before any data is read."""
    steps = []
    for part in split_top(expression, "|") if expression.strip() else []:
        m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(?:\((.*)\))?\s*", part, re.S)
        if not m:
            raise ConfigError(f"cannot read transform step '{part.strip()}'")
        name = m[1].lower()
        if name not in REGISTRY:
            raise ConfigError(f"unknown transform '{m[1]}', known: {', '.join(sorted(REGISTRY))}")
        args = [_unquote(a.strip()) for a in split_top(m[2], ",")] if m[2] and m[2].strip() else []
        if len(args) < getattr(REGISTRY[name], "least", 0):
            raise ConfigError(f"transform '{name}' needs argument {len(args) + 1}")
        steps.append((name, args))
    return steps


def apply_transform(expression: str, value: Value, context: Context) -> Value:
    for name, args in compile_transform(expression):
        value = REGISTRY[name](value, args, context)
    return value


def coerce(v: Value, kind: str) -> Value:
    """To the declared type; what does not fit is an error."""
    if kind == "STRING":
        return v if v.kind == "text" else v.then(v.shown, "text")
    if kind == "DECIMAL":
        return decimal(v)
    if kind == "INTEGER":
        said = lambda d: F.when(d != F.floor(d), F.concat(F.lit("'"), plain(d), F.lit("' is not a whole number")))
        return decimal(v).attempt(lambda c: outcome(F.when(c == F.floor(c), c.try_cast("long")), said(c)), "long")
    if kind == "DATE":
        return _date(v, [], Context({}))
    return v if v.kind == "bool" else _coded(codes.yes_no, "bool")(v, [], Context({}))
