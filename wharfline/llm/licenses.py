"""Licence scans by canonical digests.

A text is brought to a canonical form: A-Z lower-cased, copyright lines dropped
("copyright" with (c), a year or a name; not prose that is wrapped before the word), equivalent spellings made equal,
punctuation and white space reduced to single blanks. Its SHA-256 is joined to the digests of known licences. The
whole text of a document is looked up, and so is each of its lines, so that a notice inside a longer document is
found as well. The catalogue is a constant of this module, of at most CATALOGUE_LIMIT texts, and is broadcast.

Defined results: a null or empty text, and one of punctuation alone, has the digest of no characters and matches
nothing; a text that is a licence word for word matches by ``license_id``; lines that match are counted once for
each occurrence and listed by licence in order; repeated rows give repeated results; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

CATALOGUE_LIMIT = 1000

#: Spellings that mean the same, as (pattern, replacement) on lower-case text; fixed values in the order of use.
EQUIVALENT = [
    ("[‘’“”`]", "'"),
    ("[‐-―−]", "-"),
    ("https?://", ""),
    ("licence", "license"),
    ("licencing", "licensing"),
    ("copyright holders?", "copyright owner"),
    ("copyright owners", "copyright owner"),
    ("merchantibility", "merchantability"),
    ("non-?infringement", "noninfringement"),
    ("sub-?license", "sublicense"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
]
#: Spellings of several words, made equal once more in the joined text, where a line may have ended between the words.
WRAPPED = [("copyright (?:holders?|owners)", "copyright owner"), ("per cent", "percent"), ("non infringement", "noninfringement"), ("sub license", "sublicense")]
#: The SQL twin's wider pattern; it also drops wrapped prose that begins a line.
COPYRIGHT_LINE = r"^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Words after "copyright" that are prose and not a holder's name.
_PROSE = (
    "notices?|holders?|owners?|laws?|licen[cs]es?|licensing|statements?|interests?|rights?|treat(?:y|ies)|protections?|disclaimers?|infringements?|material|permissions?|works?|status|"
    "protected|resulting|and|or|on|in|to|for|of|from|is|are|as|at|if|it|its|may|can|shall|will|must|under|with|without|that|which|this|these|those|you|your|they|we|does|do|not|"
    "(?:the|a|an|each|any|all|such) (?:software|library|program|works?|notices?|licen[cs]es?|materials?|documents?|holders?|owners?)"
)
_YEAR = r"[\[<{(]?(?:(?:19|20)(?:\d\d|yy)|y{4}|year)\b"
NOTICE_LINE = rf"^[ \t]*(?:copyright[ \t]*(?:\(c\)|©|:|$|{_YEAR})|copyright[ \t]+(?!(?:{_PROSE})\b)[^\s,;.)][^\n]*|\(c\)[ \t]*(?:copyright\b|©|{_YEAR})|©|all rights reserved[ \t]*[.!]?[ \t]*$)[^\n]*"

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Known licence texts and notices by identifier; fixed values.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software.\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.\n" + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


TEXTS = Path(__file__).with_name("license_texts")
#: Titles that published files of short licences carry; fixed values.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"], "ISC": ["ISC License", "The ISC License"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"],
}


def full_texts() -> list[tuple[str, str]]:
    """Whole licences: as published, without their first paragraph if it is a title, without an appendix, and under usual titles."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        text = path.read_text(encoding="utf-8").strip()
        ends = re.search("END OF TERMS AND CONDITIONS", text)
        for body in [text] + ([text[: ends.end()], text[: ends.start()]] if ends else []):
            out.append((path.stem, body))
            title, _, rest = body.partition("\n\n")
            if len(title) < 200 and len(rest) > 1000:
                out.append((path.stem, rest))
    short = out + [(i, t) for i, t in KNOWN if len(t) > 500]
    return out + [(i, f"{title}\n\n{t}") for i, t in short for title in TITLES.get(i, [])]


def canonical_line(line: Column) -> Column:
    out = F.regexp_replace(ascii_lower(line), NOTICE_LINE, "")
    for pattern, by in EQUIVALENT:
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(F.regexp_replace(out, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))


def canonical_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), canonical_line)


def whole(lines: Column) -> Column:
    """The canonical form of a text from those of its lines."""
    joined = F.array_join(F.filter(lines, lambda line: line != ""), " ")
    return F.transform(F.array(joined), lambda text: F.when(text.rlike("|".join(p for p, _ in WRAPPED)), _unwrapped(text)).otherwise(text))[0]


def _unwrapped(text: Column) -> Column:
    for pattern, by in WRAPPED:
        text = F.regexp_replace(text, pattern, by)
    return text


def catalogue(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id), one row for each digest."""
    known = KNOWN + full_texts() if known is None else known
    if len(known) > CATALOGUE_LIMIT:
        raise ValueError(f"the catalogue has {len(known)} texts; at most {CATALOGUE_LIMIT} are broadcast")
    rows = spark.createDataFrame(known, "license_id string, text string").select("license_id", F.sha2(whole(canonical_lines(F.col("text"))), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id")).where(F.col("digest") != F.sha2(F.lit(""), 256))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each document: id, digest, license_id (whole text), n_lines (lines that are licences), line_licenses."""
    listed = catalogue(docs.sparkSession, known)
    rows = docs.select(F.col(id_col), canonical_lines(F.col(text_col)).alias("_lines"))
    rows = rows.select(id_col, F.sha2(whole(F.col("_lines")), 256).alias("digest"), F.transform("_lines", lambda line: F.sha2(line, 256)).alias("_each"))
    rows = rows.join(F.broadcast(listed), "digest", "left")
    # a map from digest to licence is the same hash join for the lines inside each document's row
    known_map = listed.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license_id"))).alias("_known"))
    found = F.filter(F.transform("_each", lambda d: F.try_element_at(F.col("_known"), d)), lambda x: x.isNotNull())
    out = rows.join(F.broadcast(known_map)).select(id_col, "digest", "license_id", found.alias("_found"))
    return out.select(id_col, "digest", "license_id", F.size("_found").cast("long").alias("n_lines"), F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("line_licenses"))
