"""Profiles of unknown columns and suggestions for mapping them.

Profiling and scoring run in Spark; the greedy assignment works on at most (fields x columns) candidates of a file, on the driver for one file and in a
task for each of many (:func:`suggest_files`).
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codes, dates
from ..functions.text import clean, known, let, looks_like_date, looks_numeric, stripped
from ..plans.layout import kept
from ..plans.model import TargetField, TargetSchema
from .mapping import normal

# Words, codes, patterns, weights.
ABBREVIATIONS = {
    "inv": "invoice", "invc": "invoice", "bill": "invoice", "no": "number", "num": "number", "nbr": "number", "#": "number", "dt": "date", "dated": "date",
    "qty": "quantity", "qnty": "quantity", "quantiy": "quantity", "amt": "amount", "val": "value", "desc": "description", "descr": "description",
    "ccy": "currency", "curr": "currency", "cur": "currency", "ln": "line", "sr": "serial", "sl": "serial", "prc": "price", "ext": "extended", "itm": "item",
    "prod": "product", "mat": "material", "matl": "material", "vend": "vendor", "supp": "supplier", "sup": "supplier", "ord": "order", "purch": "purchase",
    "ref": "reference", "id": "id", "pc": "piece", "pcs": "pieces", "orderid": "order id", "invoiceid": "invoice id",
}
STOPWORDS = {"of", "the", "a", "an", "in", "for", "per", "by", "to", "rs", "inr", "usd", "₹", "$"}
X12_MEANINGS = {
    "BIG01": "invoice date", "BIG02": "invoice number", "BIG03": "purchase order date", "BIG04": "purchase order number", "BEG03": "purchase order number",
    "BEG05": "purchase order date", "IT101": "line number", "IT102": "quantity invoiced", "IT103": "unit of measure", "IT104": "unit price",
    "IT1.VP": "vendor part number sku", "IT1.BP": "buyer part number", "IT1.UP": "upc", "PO101": "line number", "PO102": "quantity ordered",
    "PO103": "unit of measure", "PO104": "unit price", "PO1.VP": "vendor part number sku", "PO1.BP": "buyer part number", "PID05": "item description",
    "CUR.SE.02": "currency", "CUR.BY.02": "currency", "REF.PO.02": "purchase order number", "REF.IA.02": "vendor number", "N1.ST.02": "ship to name",
    "N1.ST.04": "ship to code", "N1.RE.02": "remit to name", "N1.BY.02": "buyer name", "N1.SE.02": "seller supplier name",
    "DTM.002.02": "requested delivery date", "DTM.011.02": "ship date", "TXI.ST.02": "sales tax amount", "TXI.GS.02": "gst tax amount",
    "ISA06": "sender id", "GS02": "sender code",
}
#: Units of measure; fixed values.
UOM_CODES = [
    "EA", "EACH", "PCS", "PC", "PIECE", "PIECES", "NOS", "NO", "UNIT", "UNITS", "KG", "KGS", "KILOGRAM", "BOX", "BOXES", "BX", "CS", "CASE", "CASES",
    "CT", "CTN", "CARTON", "PK", "PACK", "PKT", "SET", "DZ", "DOZEN", "M", "MTR", "METER", "METRE", "RL", "ROLL", "ROLLS", "PR", "PAIR", "L", "LTR",
    "LB", "LBS", "BAG", "BAGS", "BG", "BD", "BUNDLE",
]
CURRENCY_CODES = ["USD", "INR", "EUR", "GBP", "$", "₹", "RS", "RS.", "US$"]
KINDS = ["BLANK", "GSTIN", "DATE", "AMOUNT", "DECIMAL", "INTEGER", "CURRENCY", "UOM", "CODE", "TEXT", "EMAIL", "PHONE"]
NAME_WEIGHT, FIT_WEIGHT, MIN_SCORE, MIN_NAME, SAMPLE = 0.6, 0.4, 0.35, 0.3, 200
STRONG = ["GSTIN", "CURRENCY", "UOM"]
ACCEPTED = {"DATE": ["DATE"], "DECIMAL": ["AMOUNT", "DECIMAL"], "INTEGER": ["INTEGER"], "BOOLEAN": ["TEXT"], "STRING": ["TEXT", "CODE"]}
DAY_FIRST, MONTH_FIRST = ["dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy"], ["MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy"]


def classify(c: Column) -> Column:
    """The kinds of a value; one value can have several."""
    return let(clean(c), _kinds)


def _kinds(s: Column) -> Column:
    upper = F.upper(s)
    integer = s.rlike(r"^[+-]?\d{1,12}\z")
    plain_decimal = s.rlike(r"^[+-]?\d{1,3}(,\d{2,3})*(\.\d+)?\z|^[+-]?\d+\.\d+\z")
    dated = (looks_like_date(s) | s.rlike(r"^(19|20)\d{6}\z")) & F.coalesce(dates.special(s), *[dates.try_pattern(s, p) for p in dates.CANDIDATES]).isNotNull()
    gstin = codes.gstin_format(s)
    money = s.rlike(r"[$₹€£]|(?i)\b(rs\.?|inr|usd)\b|\d\s*(?i)(l|lakh|lakhs|cr|crore)$|/-$") & looks_numeric(F.regexp_replace(s, r"(?i)\s*(l|lakh|lakhs|cr|crore)$", ""))
    phone = ~integer & ~dated & s.rlike(r"^\+?[0-9][0-9 ()-]{8,16}\z") & (F.length(F.regexp_replace(s, r"\D", "")) >= 10)
    code = ~dated & ~integer & ~plain_decimal & ~gstin & s.rlike(r"^(?=.*\d)[A-Za-z0-9][A-Za-z0-9/_.#-]{2,30}\z")
    tests = [
        ("CURRENCY", upper.isin(CURRENCY_CODES)), ("UOM", upper.isin(UOM_CODES)), ("GSTIN", gstin), ("EMAIL", s.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}\z")),
        ("DATE", dated), ("INTEGER", integer), ("DECIMAL", integer | plain_decimal), ("AMOUNT", integer | plain_decimal | money), ("PHONE", phone), ("CODE", code),
    ]
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests]))
    return F.when(s.isNull(), F.array(F.lit("BLANK"))).when(F.size(found) == 0, F.array(F.lit("TEXT"))).otherwise(found)


def profile(records: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """One row for each file and column: total, filled, distinct, samples, shares of kinds, date patterns.

    The first ``sample`` records of each file are profiled, a documented bound of the feature; None takes all.
    Cells are counted by their values first, and only distinct values are classified; their table is kept, as kinds, samples and patterns are all taken from it.
    """
    rows = records if sample is None else records.where(F.col("seq") < sample)
    cells = rows.select("file_id", "seq", F.explode("fields").alias("column", "raw")).select("file_id", "seq", "column", stripped(F.col("raw")).alias("_s"))
    cells = cells.select("file_id", "seq", "column", known(F.col("_s")).alias("value"))  # in steps of their own, so that no lambda works them out
    cells = kept(cells.groupBy("file_id", "column", "value").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_at")))
    filled = F.when(F.col("value").isNotNull(), F.col("_n"))
    share = {k: F.coalesce(F.sum(F.when(F.array_contains("kinds", k), filled)), F.lit(0)) for k in KINDS}
    typed = cells.withColumn("kinds", classify(F.col("value")))
    main = typed.groupBy("file_id", "column").agg(F.coalesce(F.sum(filled), F.lit(0)).alias("filled"), F.count("value").alias("distinct"), *[share[k].alias(f"_{k}") for k in KINDS])
    total = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("total"))
    turn = F.row_number().over(Window.partitionBy("file_id", "column").orderBy("_at", "value"))  # its limit is pushed below the shuffle
    firsts = cells.where("value is not null").withColumn("_turn", turn).where("_turn <= 5")
    samples = firsts.groupBy("file_id", "column").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]).alias("samples"))
    patterns = dates.infer_patterns(cells, "value", ["file_id", "column"])
    out = main.join(total, "file_id").join(samples, ["file_id", "column"], "left").join(patterns, ["file_id", "column"], "left")
    shares = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.coalesce(F.try_divide(F.col(f"_{k}"), F.col("filled")), F.lit(0.0)) for k in KINDS]))
    return out.select(
        "file_id", "column", "total", "filled", "distinct", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        F.map_filter(shares, lambda _, v: v > 0).alias("shares"),
        F.when(F.col("_DATE") >= 0.8 * F.col("filled"), F.coalesce("patterns", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("patterns"),
    )


def header_phrase(text: str) -> str:
    words = [t for w in normal(text).split(" ") for t in ABBREVIATIONS.get(w, w).split(" ")]
    return " ".join(t for t in words if t and t not in STOPWORDS)


def variants(column: str) -> list[str]:
    """The forms of a header that carry meaning: the dictionary's, and the last parts of a path."""
    out = [X12_MEANINGS[column]] if column in X12_MEANINGS else []
    parts = column.split("/")
    last = parts[-1].replace("@", "")
    out += [last, f"{parts[-2]} {last}"] if len(parts) > 1 else [last]
    return [p for p in dict.fromkeys(map(header_phrase, out)) if p]


def similarity(a: str, b: str) -> float:
    """The best of word overlap, containment and spelling."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = set(a.split(" ")), set(b.split(" "))
    both = len(x & y)
    inside = 0.75 + 0.2 * both / max(len(x), len(y)) if both in (len(x), len(y)) else 0.0
    spelled = codes.jaro_winkler(a, b)
    return max(2 * both / (len(x) + len(y)), inside, 0.95 * spelled if spelled >= 0.9 else 0.0)


def name_score(column: str, f: TargetField) -> float:
    phrases = [header_phrase(p) for p in (f.name, f.label, *f.aliases)]
    return max((similarity(v, p) for v in variants(column) for p in phrases), default=0.0)


def header_similarity(columns: DataFrame, schema: TargetSchema) -> DataFrame:
    """(column, field, name): every header against every field that can be mapped; a schema's fields are few and literal."""
    fields = [f for f in schema.fields if not f.derived]

    @F.pandas_udf("array<double>")
    def scores(c: pd.Series) -> pd.Series:
        return c.map(lambda x: [name_score(x, f) for f in fields])

    names = F.array(*[F.lit(f.name) for f in fields])
    return columns.select("column", F.explode(F.arrays_zip(names.alias("field"), scores("column").alias("name"))).alias("_z")).select("column", F.col("_z.field").alias("field"), F.col("_z.name").alias("name"))


@dataclass
class Profile:
    column: str
    filled: int
    samples: list[str]
    shares: dict[str, float]
    patterns: list[str]

    def share(self, kind: str) -> float:
        return self.shares.get(kind, 0.0)


@dataclass
class Suggestion:
    target: str
    sources: list[str] = field(default_factory=list)
    join: str | None = None
    confidence: float = 0.0
    transform: str | None = None
    reasons: list[str] = field(default_factory=list)

    @property
    def band(self) -> str:
        return "HIGH" if self.confidence >= 0.8 else "MEDIUM" if self.confidence >= 0.55 else "LOW"


@dataclass
class Report:
    suggestions: list[Suggestion]
    unused: list[str]
    missing: list[str]


def strong_kind(f: TargetField, p: Profile) -> bool:
    return any(k in f.kinds and p.share(k) >= 0.9 for k in STRONG)


def fit(f: TargetField, p: Profile) -> float:
    accepted = f.kinds or ACCEPTED[f.type]
    best = max((p.share(k) for k in accepted), default=0.0) if p.filled else 0.0
    return best * 0.3 if f.type != "DATE" and p.share("DATE") >= 0.8 and "DATE" not in accepted else best


def combine(f: TargetField, p: Profile, name: float, fits: float) -> float:
    if not p.filled:
        return 0.6 * name
    score = NAME_WEIGHT * name + FIT_WEIGHT * fits
    if name >= 0.95 and fits >= 0.5:
        score = max(score, 0.92)
    if fits < 0.2 and name < 0.95:
        score *= 0.5
    return min(max(score, 0.8) if strong_kind(f, p) else score, 1.0)


def _describe(f: TargetField) -> str:
    known = {"GSTIN": "GSTINs", "CURRENCY": "currency codes", "UOM": "unit codes", "AMOUNT": "amounts"}
    if f.type == "DATE":
        return "dates"
    return next((v for k, v in known.items() if k in f.kinds), "numbers" if f.type in ("INTEGER", "DECIMAL") else "codes" if "CODE" in f.kinds else "text")


def transform_for(f: TargetField, p: Profile, locale: str, reasons: list[str]) -> str:
    if f.type == "DATE":
        if not p.patterns:
            reasons.append("date format could not be inferred from the sample")
        if not p.patterns or "iso" in p.patterns:
            return "date"
        day, month = ([x for x in order if x in p.patterns] for order in (DAY_FIRST, MONTH_FIRST))
        if day and month:
            us = locale.upper() == "US"
            reasons.append(f"every sample date is ambiguous (day <= 12); assumed {'month-first (US partner)' if us else 'day-first (IN partner)'}")
            return f"date({(month if us else day)[0]})"
        return f"date({p.patterns[0]})"
    if "CURRENCY" in f.kinds:
        return "currency"
    if "UOM" in f.kinds:
        return "upper | lookup(uom, *)"
    if f.type == "DECIMAL":
        return "amount" if "AMOUNT" in f.kinds else "number"
    if f.type == "INTEGER":
        return "number"
    return "trim | upper" if {"GSTIN", "CODE"} & set(f.kinds) else "collapse" if "TEXT" in f.kinds else "trim"


def _group(column: str) -> str | None:
    m = re.match(r"(.+?\))(?=.)", column)
    return m[1].strip().lower() if m else None


def suggest(schema: TargetSchema, profiles: list[Profile], locale: str = "IN") -> Report:
    """Assign columns to fields, best scores first; ties go to the earlier field, then the earlier column."""
    fields = [f for f in schema.fields if not f.derived]
    candidates = []
    for f in fields:
        for p in profiles:
            name, fits = name_score(p.column, f), fit(f, p)
            if name >= MIN_NAME or strong_kind(f, p):
                score = combine(f, p, name, fits)
                if score >= MIN_SCORE:
                    candidates.append((score, f, p, name, fits))
    candidates.sort(key=lambda c: -c[0])
    chosen: dict[str, tuple] = {}
    used: set[str] = set()
    for c in candidates:
        if c[1].name not in chosen and c[2].column not in used:
            chosen[c[1].name] = c
            used.add(c[2].column)
    sums: dict[str, list[str]] = {}
    for name, (_, f, p, _, _) in chosen.items():
        group = _group(p.column) if f.type == "DECIMAL" else None
        if group:
            beside = [o[2].column for o in candidates if o[1] is f and o[2].column not in used and _group(o[2].column) == group and o[3] >= 0.8 and o[4] >= 0.8]
            used.update(beside)
            if beside:
                sums[name] = beside
    out, missing = [], []
    for f in fields:
        if f.name not in chosen:
            out.append(Suggestion(f.name, reasons=[f"no column looks like {f.label}"]))
            missing += [f.name] * f.required
            continue
        score, _, p, name, fits = chosen[f.name]
        example = f" (e.g. '{p.samples[0]}')" if p.samples else ""
        reasons = [f"header '{p.column}' ~ '{f.label}' ({name:.2f})", f"{fits * 100:.0f}% of sampled values look like {_describe(f)}{example}" if p.filled else "column is empty in the sample"]
        sources = [p.column, *sums.get(f.name, [])]
        if len(sources) > 1:
            reasons.append(f"sums {' + '.join(sources)} (same header group)")
        transform = transform_for(f, p, locale, reasons)
        confidence = int(score * 100 + 0.5) / 100
        missing += [f.name] * (f.required and confidence < 0.55)
        out.append(Suggestion(f.name, sources, "+" if len(sources) > 1 else None, confidence, transform, reasons))
    claimed = {s for x in out for s in x.sources}
    return Report(out, [p.column for p in profiles if p.column not in claimed], missing)


def collect_profiles(profiled: DataFrame, columns: list[str]) -> list[Profile]:
    """The profiles of one file in the order of its columns: one row for each column."""
    rows = {r["column"]: r for r in profiled.collect()}
    return [Profile(c, rows[c]["filled"], list(rows[c]["samples"]), dict(rows[c]["shares"]), list(rows[c]["patterns"])) for c in columns if c in rows]


def draft_spec(report: Report, partner_id: str, schema: TargetSchema, constants: dict[str, str] | None = None) -> dict:
    """A mapping spec to be reviewed: suggested fields, constants for what stays empty, line amount from quantity and price."""
    fields = []
    for s in report.suggestions:
        if s.sources:
            one = {"source": s.sources[0]} if len(s.sources) == 1 else {"sources": s.sources, "join": s.join}
            fields.append({"target": s.target, **one, "transform": s.transform})
        elif s.target in (constants or {}):
            fields.append({"target": s.target, "const": constants[s.target]})
    have = {f["target"] for f in fields}
    enrich = []
    if schema.field("lineAmount") and "lineAmount" not in have and {"quantity", "unitPrice"} <= have:
        enrich.append({"compute": {"target": "lineAmount", "left": "quantity", "op": "*", "right": "unitPrice"}})
    return {"partnerId": partner_id, "version": 1, "schema": schema.name, "format": "UNKNOWN", "fields": fields, "enrich": enrich}


def _masked(text: str) -> str:
    """The driver's twin of :func:`.text.mask_pii`, for the few samples of a profile."""
    return re.sub(r"\d", "9", re.sub(r"\b\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b", "[GSTIN]", text, flags=re.ASCII), flags=re.ASCII)


def advise(report: Report, profiles: list[Profile], advisor) -> Report:
    """Ask ``advisor(fields, {column: masked samples})`` about unresolved fields; its confidence counts 0.75 at most."""
    masked = {p.column: [_masked(s) for s in p.samples] for p in profiles if p.column in report.unused}
    open_ = [s.target for s in report.suggestions if not s.sources]
    for target, (column, confidence, why) in (advisor(open_, masked) if open_ and masked else {}).items():
        s = next((x for x in report.suggestions if x.target == target and not x.sources), None)
        if s and column in report.unused:
            s.sources, s.confidence, s.reasons = [column], min(0.75, confidence), [why]
            report.unused.remove(column)
            report.missing = [m for m in report.missing if m != target or s.confidence < 0.55]
    return report


def report_table(spark: SparkSession, report: Report) -> DataFrame:
    rows = [asdict(s) | {"band": s.band} for s in report.suggestions]
    return spark.createDataFrame(rows, "target string, sources array<string>, join string, confidence double, transform string, reasons array<string>, band string")


REPORTS = "file_id string, target string, sources array<string>, join string, confidence double, transform string, reasons array<string>, band string, unused array<string>, missing array<string>"


def suggest_files(profiled: DataFrame, columns: DataFrame, schema: TargetSchema, locale: str = "US") -> DataFrame:
    """The suggestions of :func:`suggest` for many files, in one plan: a row for each file and field, with the file's unused columns and missing fields.

    ``profiled`` is of :func:`profile` and ``columns`` has (file_id, columns), the order of each file's columns; a task holds the profile of a file, one row for each column.
    """

    def report(f: pd.DataFrame) -> pd.DataFrame:
        rows = {r.column: r for r in f.itertuples()}
        order = [c for c in (f["columns"].iloc[0] if f["columns"].iloc[0] is not None else []) if c in rows]
        found = suggest(schema, [Profile(c, int(rows[c].filled), list(rows[c].samples), dict(rows[c].shares), list(rows[c].patterns)) for c in order], locale)
        made = [asdict(s) | {"band": s.band, "unused": found.unused, "missing": found.missing} for s in found.suggestions]
        return pd.DataFrame(made, columns=["target", "sources", "join", "confidence", "transform", "reasons", "band", "unused", "missing"]).assign(file_id=f["file_id"].iloc[0])

    met = profiled.join(columns.select("file_id", "columns"), "file_id")
    return met.groupBy("file_id").applyInPandas(report, REPORTS)
