"""Packing of documents into sequences by cutting-stock column generation.

A document's ids with its end id are cut into pieces of the sequence length and a rest. Rests fall into length
classes of ``grain`` tokens. The histogram of the classes, a few hundred numbers whatever the input, goes to the
driver, where a linear program over patterns (how many pieces of each class fill a sequence) is solved by column
generation: the simplex duals price the classes and a knapsack dynamic program finds the pattern that is worth
most. Solutions are rounded down and what is left over is filled first-fit decreasing. Pieces are ranked within
their class, and a pattern's share of the ranks tells each piece its sequence.

Defined results: a null or empty text is its end id alone; a document longer than a sequence is cut into whole
sequences and a rest; repeated rows are packed one by one; an empty table gives an empty result. Only id and text
are read. Every sequence is at most ``length`` long; padding to ``length`` is implied.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import in_batches, load
from .common import materialise, ranked, ship

#: Buckets of the ranking within a class.
BUCKETS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, length: int, end_id: int, path: str | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens), one row for each piece."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, end = load(path), np.array([end_id], "<u4")
        for f in in_batches(frames, 4_000_000):
            flat, at = bpe.encode_batch(f["text"].tolist())
            rows = []
            for doc, i, j in zip(f["doc_id"].tolist(), at.tolist(), at[1:].tolist(), strict=False):
                n = j - i + 1
                for s in range(0, n, length):
                    part = flat[i + s : min(i + s + length, j)].astype("<u4")
                    crc = zlib.crc32(part)
                    if s + length >= n:
                        crc = zlib.crc32(end, crc)
                    rows.append((doc, s, min(length, n - s), crc, n))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": "Int64"})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(run, PIECES)


def _knapsack(worth: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, Counter]:
    """The pattern of the largest worth that fits into ``room`` units."""
    items, top = [], 0.0  # a class that is worth no more than a smaller one is left out
    for i, (size, value) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if value > top + 1e-12:
            items.append((size, value, i))
            top = value
    best, pick = [0.0] * (room + 1), [-1] * (room + 1)
    for r in range(1, room + 1):
        most, which = best[r - 1], -1
        for k, (size, value, _) in enumerate(items):
            if size > r:
                break
            if best[r - size] + value > most + 1e-12:
                most, which = best[r - size] + value, k
        best[r], pick[r] = most, which
    pattern: Counter = Counter()
    r = room
    while r > 0:
        if pick[r] < 0:
            r -= 1
        else:
            pattern[items[pick[r]][2]] += 1
            r -= items[pick[r]][0]
    return best[room], pattern


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 4000, tolerance: float = 1e-3) -> list[tuple[dict[int, int], float]]:
    """(pattern, times) of the linear program: least sequences for ``demand`` pieces of ``sizes`` units each.

    Columns are added until no pattern is worth over 1 + tolerance; then the program is within that share of its optimum.
    """
    m = len(sizes)
    columns = [{i: int(room // s)} for i, s in enumerate(sizes)]
    inverse = np.diag(1.0 / (room // sizes))
    times = inverse @ demand
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        value, pattern = _knapsack(np.maximum(dual, 0), sizes, room)
        if value <= 1 + tolerance:
            break
        column = np.zeros(m)
        for i, a in pattern.items():
            column[i] = a
        along = inverse @ column
        ok = along > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, times / np.where(ok, along, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        times = np.maximum(times - step * along, 0)
        times[out] = step
        row = inverse[out] / along[out]
        inverse -= np.outer(along, row)
        inverse[out] = row
        columns[out] = dict(pattern)
    return list(zip(columns, times.tolist(), strict=True))


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(units -> pieces, times): patterns that together hold exactly the pieces of ``histogram`` (units -> pieces)."""
    out: list[tuple[dict[int, int], int]] = []
    left = Counter({u: n for u, n in histogram.items() if n > 0})
    if left.get(room):
        out.append(({room: 1}, left.pop(room)))
    if left:
        sizes = np.array(sorted(left), np.int64)
        for pattern, times in solve(sizes, np.array([left[u] for u in sizes.tolist()], float), room):
            own = {int(sizes[i]): a for i, a in pattern.items()}
            n = min([int(times + 1e-6), *(left[u] // a for u, a in own.items())])
            if n > 0:
                out.append((own, n))
                left.subtract({u: a * n for u, a in own.items()})
    rest: list[tuple[int, Counter]] = []  # what rounding leaves: first fit, largest first
    for u in sorted((u for u, n in left.items() if n > 0), reverse=True):
        for _ in range(left[u]):
            for k, (free, bin_) in enumerate(rest):
                if free >= u:
                    bin_[u] += 1
                    rest[k] = (free - u, bin_)
                    break
            else:
                rest.append((room - u, Counter({u: 1})))
    return out + [(dict(c), n) for c, n in Counter(tuple(sorted(b.items())) for _, b in rest).items()]


def pack(
    docs: DataFrame, length: int = 2048, end_id: int = 1, grain: int = 8, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece."""
    ship(docs.sparkSession)
    room = length // grain
    made = materialise(pieces(docs, length, end_id, path, id_col, text_col), "pieces")
    made = made.withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["_class"]: r["n"] for r in made.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `room` rows
    first, share, base, key = [], [], [], []
    taken: Counter = Counter()
    sequence = 0
    for pattern, times in plan(histogram, room):
        for u, a in pattern.items():
            key.append((u << 48) + taken[u])
            first.append(taken[u])
            share.append(a)
            base.append(sequence)
            taken[u] += a * times
        sequence += times
    order = np.argsort(np.array(key, np.int64))
    keys, firsts, shares, bases = (np.array(x, np.int64)[order] for x in (key, first, share, base))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = f.pop("_rank").to_numpy(np.int64)
            at = np.searchsorted(keys, (f.pop("_class").to_numpy(np.int64) << 48) + rank, side="right") - 1
            yield f.assign(sequence_id=bases[at] + (rank - firsts[at]) // shares[at])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int")
    numbered = ranked(made, ["_class"], ["doc_id", "start", "ids_crc32"], bucket, "_rank")
    placed = numbered.mapInPandas(place, PIECES + ", sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    offset = F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select(F.col("doc_id").alias(id_col), *names[1:], "sequence_id", offset.cast("long").alias("offset"))
