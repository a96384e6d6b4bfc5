"""Token ids in files compressed by Re-Pair grammars.

Documents are sorted by id into ranges, encoded, ended by an id of their own and cut into blocks. A block is a
grammar: frequent pairs of neighbouring ids are replaced by nonterminals, again and again, never across the end of a document. Every
round counts all pairs exactly, from their sorted codes, and replaces those with at least a quarter of the count that the last round asked for
(at first of the largest count), so that frequent pairs go first, until no pair occurs LEAST times or the 16-bit ids are used up.
Of chosen pairs that overlap, the more frequent one is replaced, and of equally frequent ones every other. A block stores the rules, the
expansion length of every symbol and the shortened sequence, so that a document is decoded without the others. Blocks are rows of
a Parquet data set, which Spark's committers write once however often tasks are retried.

Layout of a block, little-endian: magic ``WRP1``; unsigned 32-bit counts of documents, rules and symbols, and the
first nonterminal; rules (2 x 16 bits each); expansion lengths of rules (32 bits each); ends of documents in symbols (64
bits each); ends in ids (64 bits each); the sequence (16 bits each).

Defined results: a null or empty text is its end id alone; documents with a null id come first; rows that repeat
are written one by one, in an order fixed by their text; an empty table gives an empty data set. Only id and text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import in_batches, load
from .common import partitions, run_folder, ship

MAGIC = b"WRP1"
#: A pair with fewer occurrences costs a rule more than it saves.
LEAST = 8
#: A round's least count, as a share of the one before.
STEP = 0.25
#: Bytes of text for each range of ids.
RANGE_BYTES = 64_000_000
BLOCK_SCHEMA = "part int, block int, doc_ids binary, n_tokens long, data binary"


def pair_counts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, exact number of each)."""
    code = np.sort(pairs)
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[head], np.diff(np.append(head, len(code)))


def _slot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(16)


def replaceable(pairs: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where in ``pairs`` one of the ``chosen`` codes stands, its number); a table of hashes spares most of the searches."""
    maybe = np.zeros(1 << 16, bool)
    maybe[_slot(chosen)] = True
    at = np.flatnonzero(maybe[_slot(pairs)])
    number = np.minimum(np.searchsorted(chosen, pairs[at]), len(chosen) - 1)
    same = chosen[number] == pairs[at]
    return at[same], number[same]


def disjoint(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the pairs at the rising positions ``at`` are replaced, so that no two share a symbol."""
    if not len(at):
        return np.zeros(0, bool)
    beside = at[1:] == at[:-1] + 1
    starts = np.append(True, ~beside | (weight[1:] != weight[:-1]))
    first = np.flatnonzero(starts)
    keep = (np.arange(len(at)) - first[np.cumsum(starts) - 1]) % 2 == 0  # every other in a run of equals
    keep[:-1] &= ~(beside & (weight[1:] > weight[:-1]))
    keep[1:] &= ~(beside & (weight[:-1] > weight[1:]))
    return keep


def compress(ids: np.ndarray, ends: np.ndarray, first: int, least: int = LEAST, step: float = STEP) -> bytes:
    """The block of ``ids`` (all below ``first``) whose documents end before the positions ``ends``."""
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[ends - 1] = True
    rules: list[np.ndarray] = []
    used, asked = first, np.inf
    while used < 65536 and len(s) > 1:
        inside = np.flatnonzero(~last[:-1])
        pairs = ((s[:-1] << np.uint32(16)) | s[1:])[inside]
        code, count = pair_counts(pairs)
        if not len(code) or count.max() < least:
            break
        asked = max(least, int(step * min(asked, count.max())))
        often = np.flatnonzero(count >= asked)
        if len(often) > 65536 - used:
            often = np.sort(often[np.argsort(-count[often], kind="stable")[: 65536 - used]])
        code, count = code[often], count[often]
        if not len(code):
            continue
        at, number = replaceable(pairs, code)
        at = inside[at]
        keep = disjoint(at, count[number])
        at, number = at[keep], number[keep]
        real = np.unique(number)
        symbol = np.zeros(len(code), np.uint32)
        symbol[real] = used + np.arange(len(real), dtype=np.uint32)
        rules.append(code[real])
        used += len(real)
        s[at] = symbol[number]
        last[at] = last[at + 1]
        stay = np.ones(len(s), bool)
        stay[at + 1] = False
        s, last = s[stay], last[stay]
    rule = np.concatenate([np.zeros(0, np.uint32), *rules])
    left, right = (rule >> np.uint32(16)).astype("<u2"), (rule & np.uint32(0xFFFF)).astype("<u2")
    size = np.ones(first + len(rule), np.uint32)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        size[first + i] = size[a] + size[b]
    head = MAGIC + struct.pack("<IIII", len(ends), len(rule), len(s), first)
    at_end = np.flatnonzero(last) + 1
    return b"".join([head, np.stack([left, right], axis=1).tobytes(), size[first:].astype("<u4").tobytes(), at_end.astype("<u8").tobytes(), ends.astype("<u8").tobytes(), s.astype("<u2").tobytes()])


class Block:
    """A compressed block, open for reading."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        self.docs, rules, symbols, self.first = struct.unpack_from("<IIII", data, 4)
        at = 20
        self.rules = np.frombuffer(data, "<u2", 2 * rules, at).reshape(rules, 2)
        self.sizes = np.frombuffer(data, "<u4", rules, at := at + 4 * rules)
        self.symbol_ends = np.frombuffer(data, "<u8", self.docs, at := at + 4 * rules).astype(np.int64)
        self.ends = np.frombuffer(data, "<u8", self.docs, at := at + 8 * self.docs).astype(np.int64)
        self.symbols = np.frombuffer(data, "<u2", symbols, at + 8 * self.docs)
        parts = [np.arange(self.first, dtype=np.uint16)]
        self.length = np.concatenate([np.ones(self.first, np.int64), self.sizes.astype(np.int64)])
        expanded: list[np.ndarray] = []
        get = lambda x: np.array([x], np.uint16) if x < self.first else expanded[x - self.first]
        for a, b in self.rules.tolist():
            expanded.append(np.concatenate([get(a), get(b)]))
        self.pool = np.concatenate(parts + expanded)
        self.place = np.cumsum(self.length) - self.length

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        length = self.length[symbols]
        before = np.cumsum(length) - length
        return self.pool[np.repeat(self.place[symbols] - before, length) + np.arange(int(length.sum()))]

    def ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def document(self, i: int) -> np.ndarray:
        """The ids of the block's i-th document; no other document is expanded."""
        return self.expand(self.symbols[self.symbol_ends[i - 1] if i else 0 : self.symbol_ends[i]])


def _ranges(source: DataFrame) -> int:
    """Ranges of about RANGE_BYTES of text, whatever the input's partitions."""
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // RANGE_BYTES))


def write(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> None:
    """Write the ids of all documents, ascending by id, as blocks under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bpe, part = load(tokenizer), TaskContext.get().partitionId()
        for block, f in enumerate(in_batches(frames, 8_000_000)):
            flat, at = bpe.encode_batch(f["text"].tolist())
            n = np.diff(at) + 1
            ends = np.cumsum(n)
            ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint16)
            own = np.ones(len(ids), bool)
            own[ends - 1] = False
            ids[own] = flat
            order = f["doc_id"].fillna(-(1 << 63)).to_numpy(np.int64)
            yield pd.DataFrame({"part": [part], "block": [block], "doc_ids": [order.astype("<i8").tobytes()], "n_tokens": [len(ids)], "data": [compress(ids, ends, bpe.size, least)]})

    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = max(partitions(docs.sparkSession), _ranges(source))
    ranges = source.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ranges.mapInPandas(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under ``path``."""
    ship(spark)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # the counts of blocks are a few numbers for each 24 MB of text; parts first, then the blocks of each part
    sizes = blocks.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("part").alias("_p"), F.col("block").alias("_b"), F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("_at"))
    starts = starts.join(parts, F.col("_p") == F.col("part")).select("_p", "_b", (F.col("_at") + F.col("_from")).alias("begin"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for part, block, names, data in zip(f["part"], f["block"], f["doc_ids"], f["data"], strict=True):
                b = Block(data)
                ids = b.ids().astype("<u4")
                begin = np.concatenate([[0], b.ends[:-1]])
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(begin.tolist(), b.ends.tolist(), strict=True)]
                yield pd.DataFrame({"_part": part, "_block": block, "doc_id": np.frombuffer(names, "<i8"), "_start": begin, "n_tokens": b.ends - begin, "ids_crc32": crc})

    rows = blocks.select("part", "block", "doc_ids", "data").mapInPandas(run, "_part int, _block int, doc_id long, _start long, n_tokens long, ids_crc32 long")
    rows = rows.join(starts, (F.col("_part") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    null = F.lit(-(1 << 63)).cast("long")
    return rows.select(F.when(F.col("doc_id") != null, F.col("doc_id")).alias("doc_id"), (F.col("begin") + F.col("_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{run_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, end_id, tokenizer, id_col, text_col)
    return read(spark, path).withColumnRenamed("doc_id", id_col)
