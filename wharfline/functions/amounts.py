"""Amounts in business spellings: currencies, brackets, lakh and crore, credit marks, both decimal styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NBSP, let, strip

#: Business decimals; products of two are exact.
DECIMAL = "decimal(18,6)"

# Spellings of currencies and of scales.
PREFIX = r"(?i)^(US\$|\$|₹|RS\.?|INR|USD|EUR|€|£|GBP)\s*"
SUFFIX = r"(?i)\s*(INR|USD|EUR|GBP|/-)$"
#: Shapes that most cells have: digits, and digits with thousands marks before a decimal point.
COMMON = r"^-?[$₹]?(?:\d+|\d[\d,]*\.\d+)\z"
SCALED = r"(?i)^(\d{1,3}(?:\.\d+)?)\s*(L|LAC|LACS|LAKH|LAKHS|CR|CRORE|CRORES|K|M|MN|MILLION)$"
SCALES = {"L": 100000, "LAC": 100000, "LACS": 100000, "LAKH": 100000, "LAKHS": 100000, "CR": 10000000, "CRORE": 10000000, "CRORES": 10000000, "K": 1000, "M": 1000000, "MN": 1000000, "MILLION": 1000000}


def separators(s: Column) -> Column:
    """One style of number: no thousands marks, a point before decimals."""
    last = lambda mark: F.length(s) - F.locate(mark, F.reverse(s))
    both, comma_last = s.contains(",") & s.contains("."), last(",") > last(".")
    return (
        F.when(both & comma_last, F.translate(F.translate(s, ".", ""), ",", "."))
        .when(~s.contains(".") & s.rlike(r"^[^,]*,.{1,2}$"), F.translate(s, ",", "."))
        .otherwise(F.translate(s, ",", ""))
    )


def _unsigned(s: Column) -> Column:
    """struct(n, flips): the size of a text without brackets and signs, and whether it is a credit."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(s, PREFIX, ""), SUFFIX, "")), PREFIX, ""))
    scale = F.create_map(*[x for k, v in SCALES.items() for x in (F.lit(k), F.lit(v))])

    def size(t: Column) -> Column:
        scaled = t.rlike(SCALED)
        times = (F.regexp_extract(t, SCALED, 1).try_cast(DECIMAL) * F.try_element_at(scale, F.upper(F.regexp_extract(t, SCALED, 2)))).try_cast(DECIMAL)
        rest = F.translate(strip(F.regexp_replace(t, "(?i)(CR|DR)$", "")), " _'", "")
        number = let(let(rest, separators), lambda x: F.when(x.rlike(r"^\d+(\.\d+)?\z"), x.try_cast(DECIMAL)))
        return F.struct(F.when(scaled, times).otherwise(number).alias("n"), (~scaled & F.upper(t).endswith("CR")).alias("credit"))

    return let(bare, size)


def _signed(whole: Column) -> Column:
    def outer(w: Column) -> Column:
        bracket = w.startswith("(") & w.endswith(")") & (F.length(w) >= 2)
        return F.struct(F.when(bracket, strip(F.regexp_replace(w, r"^\(|\)$", ""))).otherwise(w).alias("s"), bracket.alias("b"))

    def inner(o: Column) -> Column:
        rest = strip(F.regexp_replace(o["s"], "^[-+]", ""))
        return F.struct(rest.alias("s"), (o["b"] != o["s"].startswith("-")).alias("b"))

    def trailing(i: Column) -> Column:
        minus = i["s"].endswith("-") & ~i["s"].endswith("/-")
        return F.struct(F.when(minus, strip(F.regexp_replace(i["s"], "-$", ""))).otherwise(i["s"]).alias("s"), (i["b"] != minus).alias("b"))

    def value(t: Column) -> Column:
        return let(_unsigned(t["s"]), lambda u: F.when(t["b"] != u["credit"], -u["n"]).otherwise(u["n"]))

    return let(let(let(let(whole, outer), inner), trailing), value)


def amount(c: Column) -> Column:
    """struct(v, e): null and no error for blank text."""

    def parsed(w: Column) -> Column:
        bad = lambda v: F.when((w != "") & v.isNull(), F.concat(F.lit("'"), w, F.lit("' is not a valid amount")))
        return let(F.when(w != "", _signed(w)), lambda v: F.struct(v.cast(DECIMAL).alias("v"), bad(v).alias("e")))

    # cells without text and those of common shapes need none of the steps above, nor a lambda
    marked = c.contains(",") | c.contains("$") | c.contains("₹")
    plain = F.when(marked, F.translate(c, ",$₹", "")).otherwise(c).try_cast(DECIMAL)
    return F.when(c.isNull() | (c.rlike(COMMON) & (F.length(c) < 12)), F.struct(plain.alias("v"), F.lit(None).cast("string").alias("e"))).otherwise(let(strip(F.translate(c, NBSP, " ")), parsed))


def parse_amount(c: Column) -> tuple[Column, Column]:
    out = amount(c)
    return out["v"], out["e"]
