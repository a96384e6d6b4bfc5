"""Text helpers as Column expressions: stripping, null tokens, keys, headers, masks, hashes."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "no value", words that stay small in titles, shapes of numbers and dates.
NULL_TOKENS = ["NA", "N/A", "N.A.", "NULL", "NIL", "-", "--", "---", "#N/A"]
SMALL_WORDS = ["a", "an", "and", "of", "the", "for", "in", "on", "to", "x"]
NUMERIC = r"(?i)^[(+-]?\s*(?:[$₹€£]|RS\.?|INR|USD)?\s*[0-9][0-9,.'\s]*\)?(?:\s*(?:CR|DR|-))?$"
DATE_SHAPE = r"^(\d{1,4}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}[-\s][A-Za-z]{3,9}[-\s,]+\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}T.*)$"

#: Every text whose upper case is one of the tokens (a dotless i becomes I): a look-up in a set costs less than upper-casing each cell.
_NULL_SPELLINGS = ["".join(s) for t in NULL_TOKENS for s in itertools.product(*[dict.fromkeys([c, c.lower(), *("\u0131" if c == "I" else "")]) for c in t])]

_LONGEST = max(len(s.encode()) for s in _NULL_SPELLINGS)

#: White space of Java's Character.isWhitespace; fixed values.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]))
NBSP = " "


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Unicode white space off both ends; a non-breaking space stays."""
    return F.btrim(c, F.lit(SPACE))


def trimmed(c: Column) -> Column:
    """:func:`strip` of a column that costs nothing to name again: trimming by a set of characters is left out where both ends are ASCII marks, letters or digits."""
    marks = lambda s: (s >= "!") & (s < "\x7f")  # noqa: E731  texts are ordered by their bytes
    return F.when(marks(c) & marks(F.substring(c, -1, 1)), c).otherwise(strip(c))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def clean(c: Column) -> Column:
    """Stripped text, null for the tokens that mean no value."""
    return let(let(c, stripped), known)


def stripped(c: Column) -> Column:
    """Without white space and non-breaking spaces at its ends; those inside become spaces. ``c`` is a column that costs nothing to name again."""
    return F.when(c.contains(NBSP), strip(F.translate(c, NBSP, " "))).otherwise(trimmed(c))


def known(s: Column) -> Column:
    """Stripped text, null for the tokens that mean no value; a token has at most four bytes and none begins with a digit, so most cells are not looked up."""
    token = F.when((F.octet_length(s) > _LONGEST) | ((s >= "0") & (s < ":")), False).otherwise((s == "") | s.isin(_NULL_SPELLINGS))
    return F.when(~token, s)


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def normalize_key(c: Column) -> Column:
    """Lower-case words: camel case and acronyms split, other characters to blanks."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9#₹$%]+", " "))


def clean_header(c: Column) -> Column:
    s = collapse(F.translate(F.coalesce(c, F.lit("")), NBSP, " "))
    return F.regexp_replace(s, r"[.:\s]*[.:]$", "")


def title(c: Column) -> Column:
    """Capitalised words; small words stay small but the first, words with digits are upper-cased."""
    words = F.filter(F.split(F.lower(strip(c)), r"\s+"), lambda w: w != "")
    cased = F.transform(
        words,
        lambda w, i: F.when((i > 0) & w.isin(SMALL_WORDS), w).when(w.rlike(r"\p{Nd}"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))),
    )
    return F.array_join(cased, " ")


def plain(c: Column) -> Column:
    """A decimal as text without trailing zeros."""
    s = c.cast("string")
    return F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)


def looks_numeric(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(NUMERIC), F.lit(False))


def looks_like_date(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(DATE_SHAPE), F.lit(False))


def is_label(c: Column) -> Column:
    """A cell that can be a column's name: short, with a letter, few digits, neither number nor date."""
    digits = lambda s: F.length(F.regexp_replace(s, r"\P{Nd}", ""))
    test = lambda s: (s != "") & (F.length(s) <= 40) & s.rlike(r"\p{L}") & (digits(s) <= F.length(s) * 0.25) & ~looks_numeric(s) & ~looks_like_date(s)
    return let(F.coalesce(strip(c), F.lit("")), test)


def mask_pii(c: Column) -> Column:
    """GSTINs to a token, then digits to 9."""
    return F.regexp_replace(F.regexp_replace(c, r"\b\d{2}[A-Z]{5}\d{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b", "[GSTIN]"), r"\d", "9")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
