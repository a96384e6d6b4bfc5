"""Codes: GSTIN check characters, currencies, yes/no words, value classes, string similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, trimmed

# Fixed values.
CHARSET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
CURRENCIES = {"₹": "INR", "RS": "INR", "RS.": "INR", "INR": "INR", "RUPEES": "INR", "$": "USD", "US$": "USD", "USD": "USD", "DOLLARS": "USD", "€": "EUR", "EUR": "EUR", "£": "GBP", "GBP": "GBP"}
YES, NO = ["Y", "YES", "TRUE", "T", "1"], ["N", "NO", "FALSE", "F", "0"]


def gstin_check_char(first14: Column) -> Column:
    """The check character of 14 characters: products by 1 and 2 in turn, digits to base 36 summed."""
    product = lambda i: (F.instr(F.lit(CHARSET), F.substring(first14, i, F.lit(1))) - 1) * (F.lit(2) - i % 2)
    digits = F.transform(F.transform(F.sequence(F.lit(1), F.lit(14)), product), lambda p: F.floor(p / 36) + p % 36)
    total = F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.substring(F.lit(CHARSET), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))


def gstin_format(c: Column) -> Column:
    return F.coalesce(F.upper(strip(c)).rlike(GSTIN), F.lit(False))


def gstin_valid(c: Column) -> Column:
    return let(F.upper(strip(c)), lambda g: gstin_format(g) & (gstin_check_char(F.substring(g, 1, 14)) == F.substring(g, 15, 1)))


def currency(c: Column) -> tuple[Column, Column]:
    key = F.upper(trimmed(c))
    known = F
    for code in dict.fromkeys(CURRENCIES.values()):  # a map would be searched from its beginning for each cell
        known = known.when(key.isin([k for k, v in CURRENCIES.items() if v == code]), code)
    value = known.when(key.rlike(r"^[A-Z]{3}\z"), key)
    return value, F.when(c.isNotNull() & value.isNull(), F.concat(F.lit("'"), c, F.lit("' is not a recognised currency")))


def yes_no(c: Column) -> tuple[Column, Column]:
    word = F.upper(strip(c))
    value = F.when(word.isin(YES), True).when(word.isin(NO), False)
    return value, F.when(c.isNotNull() & value.isNull(), F.concat(F.lit("'"), c, F.lit("' is not a yes/no value")))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each common leading character, up to four."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken: set[int] = set()
    mine = []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == ch), None)
        if j is not None:
            taken.add(j)
            mine.append(ch)
    if not mine:
        return 0.0
    theirs = [b[j] for j in sorted(taken)]
    m = len(mine)
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def jaro_winkler_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)
