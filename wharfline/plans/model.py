"""The configuration language: schemas, mapping specs, rules, lookups, as JSON and as dataclasses."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

TYPES = ["STRING", "INTEGER", "DECIMAL", "DATE", "BOOLEAN"]
VIOLATION = "struct<rule:string,field:string,severity:string,message:string>"


class ConfigError(ValueError):
    """A configuration element that is missing, misspelt or of the wrong shape."""


@dataclass(frozen=True)
class TargetField:
    name: str
    type: str = "STRING"
    required: bool = False
    label: str = ""
    aliases: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    derived: bool = False


@dataclass(frozen=True)
class TargetSchema:
    name: str
    label: str
    fields: tuple[TargetField, ...]
    business_key: tuple[str, ...] = ()

    def field(self, name: str) -> TargetField | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True)
class FieldMapping:
    target: str
    sources: tuple[str, ...] = ()
    join: str = " "
    const: str | None = None
    transform: str = ""


@dataclass(frozen=True)
class Layout:
    name: str
    start: int
    length: int


@dataclass(frozen=True)
class ReaderOptions:
    delimiter: str | None = None
    header_row: int | None = None
    sheet: str | None = None
    record_element: str | None = None
    record_segment: str | None = None
    charset: str = "UTF-8"
    detail: str | None = None
    trailer: str | None = None
    layouts: dict[str, tuple[Layout, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Lookup:
    dataset: str
    key: str
    copy: dict[str, str]
    only_if_blank: bool = True


@dataclass(frozen=True)
class Convert:
    amount: str
    currency: str
    target: str
    base: str = "USD"


@dataclass(frozen=True)
class Compute:
    target: str
    left: str
    op: str
    right: str
    scale: int = 2


@dataclass(frozen=True)
class MappingSpec:
    partner_id: str
    version: int
    schema: str
    format: str
    reader: ReaderOptions
    fields: tuple[FieldMapping, ...]
    enrich: tuple[Lookup | Convert | Compute, ...] = ()


@dataclass(frozen=True)
class RefCheck:
    kind: str  # equals, withinpct, atmost
    field: str
    ref_field: str
    label: str | None = None
    severity: str = "ERROR"
    warn_pct: Decimal | None = None
    error_pct: Decimal | None = None
    minus: str | None = None
    tolerance_pct: Decimal | None = None


@dataclass(frozen=True)
class Rule:
    """One rule; which attributes count depends on ``kind``."""

    id: str
    kind: str
    severity: str = "ERROR"
    field: str | None = None
    regex: str | None = None
    message: str | None = None
    min: Decimal | None = None
    max: Decimal | None = None
    max_past_days: int | None = None
    max_future_days: int | None = None
    allowed: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    left: str | None = None
    op: str | None = None
    right: str | None = None
    tolerance: Decimal | None = None
    tolerance_pct: Decimal | None = None
    dataset: str | None = None
    key: str | None = None
    must_exist: bool = True
    checks: tuple[RefCheck, ...] = ()
    then: tuple[Rule, ...] = ()


def parse_json(text: str) -> Any:
    """JSON with exact decimals; of keys that repeat the last counts."""
    try:
        return json.loads(text, parse_float=Decimal, parse_int=Decimal)
    except json.JSONDecodeError as e:
        raise ConfigError(f"invalid JSON at line {e.lineno}: {e.msg}") from None


def _need(d: dict, key: str, where: str) -> Any:
    if not isinstance(d, dict):
        raise ConfigError(f"{where} must be an object")
    if d.get(key) is None:
        raise ConfigError(f"{where} needs '{key}'")
    return d[key]


def _text(v: Any) -> str | None:
    return None if v is None else str(v)


def _list(d: dict, key: str) -> tuple[str, ...]:
    v = d.get(key) or []
    if not isinstance(v, list):
        raise ConfigError(f"'{key}' must be a list")
    return tuple(str(x) for x in v)


def _num(d: dict, key: str) -> Decimal | None:
    return None if d.get(key) is None else Decimal(str(d[key]))


def load_schema(doc: dict) -> TargetSchema:
    fields = []
    for f in _need(doc, "fields", "schema"):
        name = _need(f, "name", "schema field")
        kind = str(f.get("type", "STRING")).upper()
        if kind not in TYPES:
            raise ConfigError(f"field '{name}' has unknown type '{kind}'")
        fields.append(TargetField(name, kind, bool(f.get("required", False)), str(f.get("label") or name), _list(f, "aliases"), tuple(k.upper() for k in _list(f, "kinds")), bool(f.get("derived", False))))
    name = _need(doc, "name", "schema")
    return TargetSchema(name, str(doc.get("label") or name), tuple(fields), _list(doc, "businessKey"))


def load_reader(doc: dict) -> ReaderOptions:
    delimiter = doc.get("delimiter")
    fixed = doc.get("fixed") or {}
    layouts = {kind: tuple(Layout(str(_need(c, "name", "layout column")), int(_need(c, "start", "layout column")), int(_need(c, "length", "layout column"))) for c in columns) for kind, columns in (fixed.get("layouts") or {}).items()}
    return ReaderOptions(
        "\t" if delimiter in ("\\t", "tab") else delimiter, None if doc.get("headerRow") is None else int(doc["headerRow"]), doc.get("sheet"),
        doc.get("recordElement"), doc.get("recordSegment"), doc.get("charset") or "UTF-8", fixed.get("detail"), fixed.get("trailer"), layouts,
    )


def load_enrichment(doc: dict) -> Lookup | Convert | Compute:
    kind = str(doc.get("type") or next((k for k in ("lookup", "convert", "compute") if k in doc), "")).lower()
    body = doc[kind] if isinstance(doc.get(kind), dict) else doc
    if kind == "lookup":
        copy = _need(body, "copy", "lookup")
        return Lookup(_need(body, "dataset", "lookup"), _need(body, "key", "lookup"), {str(k): str(v) for k, v in copy.items()}, bool(body.get("onlyIfBlank", True)))
    if kind == "convert":
        return Convert(_need(body, "amount", "convert"), _need(body, "currency", "convert"), _need(body, "target", "convert"), body.get("base") or "USD")
    if kind == "compute":
        return Compute(_need(body, "target", "compute"), _need(body, "left", "compute"), _need(body, "op", "compute"), _need(body, "right", "compute"), int(body.get("scale", 2)))
    raise ConfigError(f"unknown enrichment type '{kind}'")


def load_spec(doc: dict) -> MappingSpec:
    fields = []
    for f in _need(doc, "fields", "spec"):
        sources = _list(f, "sources") if f.get("sources") else ((str(f["source"]),) if f.get("source") is not None else ())
        fields.append(FieldMapping(_need(f, "target", "spec field"), sources, f.get("join") if f.get("join") is not None else " ", _text(f.get("const")), f.get("transform") or ""))
    return MappingSpec(
        _need(doc, "partnerId", "spec"), int(doc.get("version", 1)), _need(doc, "schema", "spec"), str(doc.get("format") or "UNKNOWN").upper(),
        load_reader(doc.get("reader") or {}), tuple(fields), tuple(load_enrichment(e) for e in doc.get("enrich") or []),
    )


def load_check(doc: dict, severity: str) -> RefCheck:
    kind = str(_need(doc, "type", "reference check")).lower()
    if kind not in ("equals", "withinpct", "atmost"):
        raise ConfigError(f"unknown reference check '{kind}'")
    own = str(doc.get("severity") or "ERROR").upper()
    return RefCheck(kind, _need(doc, "field", kind), _need(doc, "refField", kind), doc.get("label"), own, _num(doc, "warnPct"), _num(doc, "errorPct"), doc.get("minus"), _num(doc, "tolerancePct"))


def load_rule(doc: dict) -> Rule:
    kind = str(_need(doc, "type", "rule")).lower()
    name = _need(doc, "id", f"rule of type '{kind}'")
    where = f"rule '{name}'"
    severity = str(doc.get("severity") or "ERROR").upper()
    base = {"id": name, "kind": kind, "severity": severity}
    one = lambda: {"field": _need(doc, "field", where)}
    whole = lambda k: None if doc.get(k) is None else int(doc[k])
    if kind in ("required", "gstin"):
        return Rule(**base, **one())
    if kind == "matches":
        return Rule(**base, **one(), regex=_need(doc, "regex", where), message=doc.get("message"))
    if kind == "range":
        return Rule(**base, **one(), min=_num(doc, "min"), max=_num(doc, "max"))
    if kind == "datewindow":
        return Rule(**base, **one(), max_past_days=whole("maxPastDays"), max_future_days=whole("maxFutureDays"))
    if kind == "oneof":
        return Rule(**base, **one(), allowed=_list(doc, "allowed"))
    if kind == "unique":
        return Rule(**base, fields=tuple(_need(doc, "fields", where)))
    if kind == "arithmetic":
        return Rule(**base, **one(), left=_need(doc, "left", where), op=_need(doc, "op", where), right=_need(doc, "right", where), tolerance=_num(doc, "tolerance"), tolerance_pct=_num(doc, "tolerancePct"))
    if kind == "reference":
        checks = tuple(load_check(c, severity) for c in doc.get("checks") or [])
        return Rule(**base, dataset=_need(doc, "dataset", where), key=_need(doc, "key", where), must_exist=bool(doc.get("mustExist", True)), message=doc.get("message"), checks=checks)
    if kind == "when":
        return Rule(**base, **one(), allowed=_list(doc, "in"), then=tuple(load_rule(r) for r in _need(doc, "then", where)))
    raise ConfigError(f"unknown rule type '{kind}'")


def load_rules(doc: dict) -> list[Rule]:
    return [load_rule(r) for r in _need(doc, "rules", "rules document")]


def load_lookups(doc: dict) -> dict[str, dict[str, str]]:
    """Code tables; aliases are compared without case."""
    return {str(t): {str(k).strip().upper(): str(v) for k, v in table.items()} for t, table in doc.items()}
