"""Dates: strict patterns, Excel serials, ISO timestamps in their own offset, inference of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, strip

# Candidate patterns, most specific first, and those that cannot be misread.
CANDIDATES = [
    "yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "MM-dd-yyyy", "d/M/yyyy", "M/d/yyyy",
    "dd-MMM-yyyy", "d-MMM-yyyy", "dd-MMM-yy", "d-MMM-yy", "dd MMM yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM dd, yyyy", "MMMM d, yyyy",
    "dd/MM/yy", "MM/dd/yy", "yyMMdd",
]
UNAMBIGUOUS = ["yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "dd-MMM-yyyy", "d-MMM-yyyy", "dd-MMM-yy", "d-MMM-yy", "dd MMM yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM dd, yyyy", "MMMM d, yyyy"]
ISO = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d([.]\d{1,9})?)?(Z|[+-](0\d|1[0-8]):[0-5]\d)?$"


def try_pattern(s: Column, pattern: str) -> Column:
    """The date, or null; every digit that the pattern asks for must be there."""
    shape = "".join(_shape(pattern))
    return F.when(s.rlike(shape), F.try_to_date(F.initcap(s) if "MMM" in pattern else s, pattern))


def _shape(pattern: str):
    yield "(?i)^"
    i = 0
    while i < len(pattern):
        j = i
        while j < len(pattern) and pattern[j] == pattern[i]:
            j += 1
        letter, n = pattern[i], j - i
        if letter == "M" and n >= 3:
            yield "[A-Za-z]{3}" if n == 3 else "[A-Za-z]{3,9}"
        elif letter in "yMd":
            yield rf"\d{{{n}}}" if n > 1 else r"\d{1,2}"
        else:
            yield "".join(rf"\{ch}" if not ch.isalnum() and ch != " " else ch for ch in pattern[i:j])
        i = j
    yield r"\z"


def special(s: Column) -> Column:
    """ISO timestamps, in their own offset, and five-digit Excel serials."""
    day = lambda n: F.when((n > 20000) & (n < 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")))
    serial = F.when(s.rlike(r"^\d{5}(\.\d+)?$"), let(s.try_cast("double"), day))
    stamp = F.when(s.rlike(ISO), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    return F.when(s.contains("T"), stamp).when((F.length(s) == 5) | s.contains("."), serial)


def date(c: Column, patterns: list[str] | None = None) -> Column:
    """struct(v, e): null and no error for blank text."""
    names = patterns or UNAMBIGUOUS
    said = F.lit("' does not match date format " + " or ".join(names))

    def parsed(s: Column) -> Column:
        found = F.coalesce(special(s), *[try_pattern(s, p) for p in names])
        return let(found, lambda v: F.struct(v.alias("v"), F.when((s != "") & v.isNull(), F.concat(F.lit("'"), s, said)).alias("e")))

    slow = let(strip(c), parsed)
    if not any(mark in names[0] for mark in "/- "):
        return slow
    # no serial and no timestamp has the shape of a pattern with such marks, so the first pattern may be tried first
    first = try_pattern(c, names[0])
    return F.when(c.isNull() | first.isNotNull(), F.struct(first.alias("v"), F.lit(None).cast("string").alias("e"))).otherwise(slow)


def parse_date(c: Column, patterns: list[str] | None = None) -> tuple[Column, Column]:
    out = date(c, patterns)
    return out["v"], out["e"]


def infer_patterns(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, patterns): the candidates that parse every value that is not blank; ["iso"] where all are special."""
    s = strip(F.col(value))
    filled = df.where(F.col(value).isNotNull() & (s != ""))
    fits = [F.bool_and(try_pattern(s, p).isNotNull()).alias(f"p{i}") for i, p in enumerate(CANDIDATES)]
    seen = filled.groupBy(*keys).agg(F.bool_and(special(s).isNotNull()).alias("iso"), *fits)
    found = F.array_compact(F.array(*[F.when(F.col(f"p{i}"), F.lit(p)) for i, p in enumerate(CANDIDATES)]))
    return seen.select(*keys, F.when(F.col("iso"), F.array(F.lit("iso"))).otherwise(found).alias("patterns"))
