"""Large text files, each read by many tasks.

Spark cuts a file into blocks, and a block's lines come to one task in their order. What a block is depends on what comes before it: whether it
begins within a quoted cell, at which physical line, below which header. A first pass makes one small row for each block: what it would
do from either state (quotes), how many lines it has, which header lines come last. These rows, one for each block
of some 128 MB, are composed in order on the driver, and a second pass reads each block from the state in which it begins.

Rows of delimited text that run over the end of a block are put together from their pieces, one for each block that they touch; that pass
reads only the blocks concerned and is left out where there are none. The heading of a table is found in the first HEAD bytes of its
file (more, up to MOST_HEAD, where these hold too few rows), which the driver reads, as it does for a schema.

Results equal those of the parsers of whole files, line numbers included; ``seq`` is the physical line, so it grows within a file and is not
gapless. At most MOST_FILES files are read at once: these readers are for large files, :func:`.reader.read_files` for many small ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import ReaderOptions
from . import parsers
from .reader import RECORDS

HEAD, MOST_HEAD, MOST_FILES = 1 << 16, 1 << 24, 10_000
BOM = "﻿"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_id, block, raw) of every line of files (as :func:`files_of` names them), in order within a block; lines end at line feeds, a carriage return before one stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    text = spark.read.option("lineSep", "\n").text([path(spark._jvm.java.net.URI(p)).toString() for p in paths])
    at = F.col("_metadata")
    return text.select(at["file_path"].alias("file_id"), at["file_block_start"].alias("block"), F.col("value").cast("binary").alias("raw"))


def files_of(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files below a path, as the readers name them."""
    as_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(p))
    found = sorted(re.sub(r"^(\w+):///", r"\1:/", as_path(p).toUri().toString()) for p in spark.read.option("recursiveFileLookup", "true").text(path).inputFiles())
    if len(found) > MOST_FILES:
        raise ValueError(f"{len(found)} files; at most {MOST_FILES} are read at once")
    return found


def head(spark: SparkSession, file_id: str, size: int) -> tuple[bytes, bool]:
    """The first bytes of a file in any store that Spark reads, and whether they are all of it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file_id))
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        data = bytes(stream.readNBytes(size))
    finally:
        stream.close()
    return data, len(data) < size


def table_head(spark: SparkSession, file_id: str, o: ReaderOptions) -> tuple[str, parsers.Heading]:
    """(delimiter, heading) of a file."""
    size = HEAD
    while True:
        data, whole = head(spark, file_id, size)
        text = data.decode(o.charset, "replace").removeprefix(BOM)
        if not whole:
            text = text[: text.rfind("\n") + 1]  # the last line may be cut
        delimiter = o.delimiter or parsers.sniff_delimiter(text.splitlines())
        reader = parsers.RowReader(delimiter)
        rows = [row for line in text.split("\n")[:-1] for row in reader.feed(line)]
        if whole:
            rows = parsers.csv_rows(text, delimiter)
        if whole or len(rows) >= parsers.HEADER_ROWS or size >= MOST_HEAD:
            return delimiter, parsers.heading(rows, o.header_row)
        size *= 4


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, list | None]]:
    """(file, block, lines) in order, in pieces; then (file, block, None) at its end."""
    at = None
    for f in frames:
        new = ((f["file_id"] != f["file_id"].shift()) | (f["block"] != f["block"].shift())).cumsum()
        for _, g in f.groupby(new.to_numpy(), sort=False):
            key = (g["file_id"].iloc[0], int(g["block"].iloc[0]))
            if at is not None and key != at:
                yield *at, None
            at = key
            yield *key, g["raw"].tolist()
    if at is not None:
        yield *at, None


# ---- delimited text

def quote_states(text: DataFrame, delimiter: str, charset: str) -> DataFrame:
    """One row for each block and state it may begin in: (inside, ends, starts, lines): whether it ends inside, whether a row starts in it, its physical lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = None
        for file_id, block, some in _blocks(frames):
            if both is None:
                both, starts, seen = [parsers.RowReader(delimiter, inside, 0) for inside in (False, True)], [True, False], False
            if some is None:
                yield pd.DataFrame({"file_id": file_id, "block": block, "inside": [False, True], "ends": [r.inside for r in both], "starts": starts, "lines": [r.line for r in both]})
                both = None
                continue
            for raw in some:
                if seen:
                    starts = [s or not r.inside for s, r in zip(starts, both, strict=True)]
                seen = True
                if raw is None:  # neither quotes nor carriage returns: nothing changes
                    for r in both:
                        r.line += 1
                    continue
                line = raw.decode(charset, "replace")
                line = line.removeprefix(BOM) if block == 0 and both[0].line == 0 else line
                for i, r in enumerate(both):
                    was = r.inside
                    ended = len(r.feed(line))
                    r.cells, r.open = [], ""
                    # a carriage return within the line ends a row, and another starts
                    starts[i] = starts[i] or ended > 1 or (was and ended == 1 and r.inside)

    plain = (F.instr(F.col("raw").cast("string"), '"') == 0) & (F.instr(F.expr("substring(raw, 1, length(raw) - 1)").cast("string"), "\r") == 0)
    marked = text.select("file_id", "block", F.when(~plain, F.col("raw")).alias("raw"))
    return marked.mapInPandas(run, "file_id string, block long, inside boolean, ends boolean, starts boolean, lines long")


def compose(states: list) -> tuple[dict[tuple[str, int], tuple[bool, int, int]], set[tuple[str, int]]]:
    """From the rows of :func:`quote_states`: {(file, block): (begins inside, its first line, the block in which the row that it begins within
    started)}, and the blocks that have a piece of a row that does not lie within one."""
    by: dict[str, dict[int, dict[bool, object]]] = {}
    for r in states:
        by.setdefault(r["file_id"], {}).setdefault(r["block"], {})[r["inside"]] = r
    out, cut = {}, set()
    for file_id, blocks in by.items():
        inside, line, owner = False, 1, 0
        for block in sorted(blocks):
            out[file_id, block] = (inside, line, owner)
            if inside:
                cut |= {(file_id, owner), (file_id, block)}
            r = blocks[block][inside]
            owner = block if r["starts"] else owner
            inside, line = r["ends"], line + r["lines"]
        if inside:  # the file ends within a cell
            cut.add((file_id, owner))
    return out, cut


def csv_records(spark: SparkSession, path: str | list[str], options: ReaderOptions = ReaderOptions()) -> DataFrame:
    """Records of delimited files, as :func:`.reader.read_files` gives them, by as many tasks as they have blocks."""
    tops = {f: table_head(spark, f, options) for f in files_of(spark, path)}
    out = None
    for delimiter in sorted({d for d, _ in tops.values()}):
        own = {f: top for f, (d, top) in tops.items() if d == delimiter}
        part = _delimited(spark, own, delimiter, options.charset)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], RECORDS)


def _delimited(spark: SparkSession, tops: dict[str, parsers.Heading], delimiter: str, charset: str) -> DataFrame:
    text = lines(spark, list(tops))
    plan, cut = compose(quote_states(text, delimiter, charset).collect())  # two rows for each block
    known = spark.sparkContext.broadcast((plan, tops))

    def read(frames: Iterator[pd.DataFrame], use: Callable) -> Iterator[pd.DataFrame]:
        reader, rows = None, []
        for file_id, block, some in _blocks(frames):
            inside, line, owner = known.value[0][file_id, block]
            if reader is None:
                reader, first = parsers.RowReader(delimiter, inside, line), inside
            for raw in some or []:
                text_ = raw.decode(charset, "replace")
                for row in reader.feed(text_.removeprefix(BOM) if block == 0 and reader.line == 1 else text_):
                    if first:  # the end of a row that began in a block before
                        rows.append((owner, block, None, row[1]))
                        first = False
                    else:
                        rows.append((block, block, *row))
            if some is None:
                if reader.inside:  # it goes on in the next block, or the file ends within it
                    rows.append((owner if first else block, block, None if first else reader.start, [*reader.cells, reader.open], False))
                reader = None
            if some is None or len(rows) >= 5000:
                found = use(file_id, rows)
                rows = []
                if len(found):
                    yield found

    def whole(file_id: str, rows: list) -> pd.DataFrame:
        return _records(file_id, known.value[1][file_id], [(r[2], r[3]) for r in rows if len(r) == 4 and r[2] is not None])

    def pieces(file_id: str, rows: list) -> pd.DataFrame:
        cut = [r[:4] for r in rows if len(r) == 5 or r[2] is None]
        return pd.DataFrame(cut, columns=["owner", "piece", "line", "cells"]).assign(file_id=file_id).astype({"line": "Int64"})

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file_id, parts in zip(f["file_id"], f["parts"], strict=True):
                line, cells = next(p["line"] for p in parts if p["line"] is not None), []
                for p in parts:
                    more = list(p["cells"])
                    cells = [*cells[:-1], cells[-1] + more[0], *more[1:]] if cells else more
                made = _records(file_id, known.value[1][file_id], [(int(line), cells)])
                if len(made):  # not a row of the preamble
                    yield made

    out = text.mapInPandas(lambda fs: read(fs, whole), RECORDS)
    if not cut:
        return out
    concerned = F.col("block").isin(sorted({b for _, b in cut})) if len(cut) <= 1000 else F.lit(True)
    found = text.where(concerned).mapInPandas(lambda fs: read(fs, pieces), "owner long, piece long, line long, cells array<string>, file_id string")
    rows = found.groupBy("file_id", "owner").agg(F.sort_array(F.collect_list(F.struct("piece", "line", "cells"))).alias("parts"))
    return out.unionByName(rows.mapInPandas(join, RECORDS))


def _records(file_id: str, top: parsers.Heading, rows: list[tuple[int, list[str]]]) -> pd.DataFrame:
    made = [(line, fields) for line, cells in rows if line > top.last and (fields := top.record(cells)) is not None]
    return pd.DataFrame({"file_id": file_id, "seq": [n for n, _ in made], "line": [n for n, _ in made], "fields": [x for _, x in made], "columns": [list(x) for _, x in made]})


# ---- fixed width

def fixed_records(spark: SparkSession, path: str | list[str], options: ReaderOptions) -> DataFrame:
    """Records of fixed-width files with the header fields above them carried down, by as many tasks as they have blocks."""
    text = lines(spark, files_of(spark, path))
    detail = parsers.detail_type(options)
    heads = [k for k in options.layouts if k not in (detail, options.trailer)]
    kind = parsers.line_type(options)

    def parts(raw: bytes) -> list[str]:
        return raw.decode(options.charset, "replace").removesuffix("\r").split("\r")

    def last_heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, last = 0, {}
        for file_id, block, some in _blocks(frames):
            if some is None:
                yield pd.DataFrame({"file_id": [file_id], "block": [block], "lines": [n], "heads": [[last.get(k) for k in heads]]})
                n, last = 0, {}
            for raw in some or []:
                for line in parts(raw):
                    n += 1
                    if (k := kind(line)) in heads:
                        last[k] = line

    plan: dict[tuple[str, int], tuple[int, dict[str, str]]] = {}
    line, held = {}, {}
    for r in sorted(text.mapInPandas(last_heads, "file_id string, block long, lines long, heads array<string>").collect(), key=lambda r: (r["file_id"], r["block"])):
        f = r["file_id"]
        plan[f, r["block"]] = (line.get(f, 1), dict(held.get(f, {})))
        line[f] = line.get(f, 1) + r["lines"]
        held[f] = held.get(f, {}) | {k: h for k, h in zip(heads, r["heads"], strict=True) if h is not None}
    known = spark.sparkContext.broadcast(plan)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried, rows = None, []
        for file_id, block, some in _blocks(frames):
            if carried is None:
                number, carried = known.value[file_id, block]
                carried = {k: parsers.header_fields(options, k, carried[k]) for k in heads if k in carried}
            for raw in some or []:
                for text_ in parts(raw):
                    k = kind(text_)
                    if k == detail:
                        rows.append((number, {n: v for h in carried.values() for n, v in h.items()} | parsers.cut_fields(options, k, text_)))
                    elif k in heads:
                        carried[k] = parsers.header_fields(options, k, text_)
                    number += 1
            if some is None or len(rows) >= 5000:
                if rows:
                    yield pd.DataFrame({"file_id": file_id, "seq": [n for n, _ in rows], "line": [n for n, _ in rows], "fields": [x for _, x in rows], "columns": [list(x) for _, x in rows]})
                rows = []
            if some is None:
                carried = None

    return text.mapInPandas(read, RECORDS)
