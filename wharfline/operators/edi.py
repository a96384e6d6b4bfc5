"""EDI X12: delimiters, segments, envelopes with their issues, flattened records, 997 acknowledgments.

:func:`segments` and :func:`envelope_counts` are Column expressions over many files; the walk of one interchange,
whose issues come in order, is a function of its text.
"""

from __future__ import annotations

import datetime
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layout import kept

# Fixed values of the format.
SUPPORTED = {"810", "850"}
QUALIFIED = {"N1", "NM1", "REF", "DTM", "PER", "AMT", "CUR", "TXI", "SAC", "N9", "QTY"}
SUMMARY = {"TDS", "CTT"}
PAIRED = {"IT1", "PO1"}


class X12Error(ValueError):
    """Text that is no X12 interchange."""


class Segment(NamedTuple):
    position: int
    id: str
    elements: tuple[str, ...]

    def at(self, i: int) -> str:
        return self.elements[i - 1].strip() if 0 < i <= len(self.elements) else ""

    def raw(self, i: int) -> str:
        return self.elements[i - 1] if 0 < i <= len(self.elements) else ""


@dataclass
class Transaction:
    type: str
    control: str
    segments: list[Segment]
    issues: list[tuple[str, str, int]] = field(default_factory=list)  # code, message, position

    @property
    def accepted(self) -> bool:
        return not self.issues


@dataclass
class Group:
    functional: str = ""
    sender: str = ""
    receiver: str = ""
    control: str = ""
    transactions: list[Transaction] = field(default_factory=list)
    issues: list[tuple[str, str, int]] = field(default_factory=list)


@dataclass
class Interchange:
    element: str
    component: str
    terminator: str
    isa: Segment
    groups: list[Group] = field(default_factory=list)
    issues: list[tuple[str, str, int]] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.issues and all(not g.issues and all(t.accepted for t in g.transactions) for g in self.groups)


def _int(s: str) -> int:
    try:
        return int(s.strip())
    except ValueError:
        return -1


def delimiters(text: str) -> tuple[str, str, str]:
    if not text.startswith("ISA") or len(text) < 16:
        raise X12Error("not an X12 interchange: file does not start with an ISA segment")
    at = 3
    for _ in range(15):
        at = text.find(text[3], at + 1)
        if at < 0:
            break
    if at < 0 or at + 2 >= len(text):
        raise X12Error("truncated ISA segment: expected 16 elements")
    return text[3], text[at + 1], text[at + 2]


def parse(raw: str) -> Interchange:
    """One interchange; what is wrong becomes an issue at its level."""
    text = (raw or "").removeprefix("﻿").lstrip()
    element, component, terminator = delimiters(text)
    parts = [p.strip().split(element) for p in text.split(terminator) if p.strip()]
    return walked([Segment(i, p[0].strip(), tuple(p[1:])) for i, p in enumerate(parts, 1)], element, component, terminator)


def walked(segs: list[Segment], element: str, component: str, terminator: str) -> Interchange:
    """The interchange of these segments, of which the first is its ISA."""
    out = Interchange(element, component, terminator, segs[0])
    if len(segs[0].elements) != 16:
        out.issues.append(("", f"ISA has {len(segs[0].elements)} elements, expected 16", 1))
    state = _Walk(out)
    for s in segs[1:]:
        state.take(s)
    state.finish(segs[-1].position)
    return out


class _Walk:
    def __init__(self, out: Interchange):
        self.out, self.group, self.tx, self.ended = out, None, None, False

    def take(self, s: Segment) -> None:
        if s.id in _ENVELOPE:
            _ENVELOPE[s.id](self, s)
        elif self.tx is not None:
            self.tx.segments.append(s)
        else:
            self._stray(f"segment {s.id} is outside any transaction set", s)

    def _stray(self, message: str, s: Segment) -> None:
        self.out.issues.append(("", message, s.position))

    def _end_tx(self, position: int) -> None:
        if self.tx is not None:
            self.tx.issues.append(("2", f"transaction set {self.tx.control} has no SE trailer", position))
            self._close_tx()

    def _close_tx(self) -> None:
        self.group.transactions.append(self.tx)
        self.tx = None

    def _end_group(self, position: int, whole: bool = False) -> None:
        if self.group is not None:
            if not whole:
                self.group.issues.append(("", f"functional group {self.group.control} has no GE trailer", position))
            self.out.groups.append(self.group)
            self.group = None

    def _gs(self, s: Segment) -> None:
        self._end_tx(s.position)
        self._end_group(s.position)
        self.group = Group(s.at(1), s.at(2), s.at(3), s.at(6))

    def _st(self, s: Segment) -> None:
        if self.group is None:
            self.group = Group(issues=[("", "transaction set found without a GS header", s.position)])
        self._end_tx(s.position)
        self.tx = Transaction(s.at(1), s.at(2), [s])
        if s.raw(1) not in SUPPORTED:
            self.tx.issues.append(("1", f"transaction set {s.raw(1)} is not supported", s.position))

    def _se(self, s: Segment) -> None:
        if self.tx is None:
            self._stray("SE found without a matching ST", s)
            return
        self.tx.segments.append(s)
        n = len(self.tx.segments)
        if s.at(2) != self.tx.control:
            self.tx.issues.append(("3", f"SE02 {s.raw(2)} does not match ST02 {self.tx.segments[0].raw(2)}", s.position))
        if _int(s.raw(1)) != n:
            self.tx.issues.append(("4", f"SE01 declares {s.raw(1)} segments but {n} were received", s.position))
        self._close_tx()

    def _ge(self, s: Segment) -> None:
        self._end_tx(s.position)
        if self.group is None:
            self._stray("GE found without a matching GS", s)
            return
        n = len(self.group.transactions)
        if s.at(2) != self.group.control:
            self.group.issues.append(("", f"GE02 {s.raw(2)} does not match GS06 {self.group.control}", s.position))
        if _int(s.raw(1)) != n:
            self.group.issues.append(("", f"GE01 declares {s.raw(1)} transaction sets but {n} were received", s.position))
        self._end_group(s.position, whole=True)

    def _iea(self, s: Segment) -> None:
        self.ended = True
        self._end_tx(s.position)
        self._end_group(s.position)
        if s.at(2) != self.out.isa.at(13):
            self._stray(f"IEA02 {s.raw(2)} does not match ISA13 {self.out.isa.raw(13)}", s)
        if _int(s.raw(1)) != len(self.out.groups):
            self._stray(f"IEA01 declares {s.raw(1)} functional groups but {len(self.out.groups)} were received", s)

    def finish(self, position: int) -> None:
        self._end_tx(position)
        self._end_group(position)
        if not self.ended:
            self.out.issues.append(("", "interchange has no IEA trailer", position))


_ENVELOPE = {"GS": _Walk._gs, "ST": _Walk._st, "SE": _Walk._se, "GE": _Walk._ge, "IEA": _Walk._iea}


@functools.lru_cache(1 << 12)
def _key(id: str, qualifier: str, i: int) -> str:
    return f"{id}.{qualifier}.{i:02d}" if qualifier else f"{id}{i:02d}"


def _put(into: dict[str, str], s: Segment) -> None:
    qualifier = s.at(1) if s.id in QUALIFIED else ""
    first = 1 if qualifier else 0
    for i, e in enumerate(s.elements[first:], first + 1):
        e = e.strip()
        if e:
            into.setdefault(_key(s.id, qualifier, i), e)


def flatten(tx: Transaction, record: str, envelope: dict[str, str]) -> tuple[list[tuple[int, dict[str, str]]], dict[str, str]]:
    """(records, summary): header fields in front of each loop's; the first value of a key counts."""
    header, summary, loops = envelope | {"ST01": tx.type, "ST02": tx.control}, {}, []
    ended = False
    for s in tx.segments:
        ended = ended or s.id in SUMMARY
        if s.id in ("ST", "SE"):
            continue
        if ended:
            _put(summary, s)
            continue
        if s.id == record:
            loops.append((s.position, {}))
        into = loops[-1][1] if loops else header
        _put(into, s)
        if s.id == record and s.id in PAIRED:
            for i in range(6, len(s.elements), 2):
                if s.at(i) and s.at(i + 1):
                    into.setdefault(f"{s.id}.{s.at(i)}", s.at(i + 1))
    return [(position, header | own) for position, own in loops], summary


def transaction_records(x: Interchange, g: Group, t: Transaction, record: str | None) -> tuple[list[tuple[int, dict[str, str]]], dict[str, str]]:
    envelope = {"ISA06": x.isa.at(6), "ISA08": x.isa.at(8), "ISA13": x.isa.at(13), "GS01": g.functional, "GS02": g.sender, "GS06": g.control}
    return flatten(t, record or ("PO1" if t.type == "850" else "IT1"), envelope)


def records(x: Interchange, record_segment: str | None = None):
    """Records of the accepted transactions; a CTT01 that is no number fails the file."""
    from ..sources.parsers import Parsed

    out = Parsed(context={"interchangeControl": x.isa.at(13), "sender": x.isa.at(6), "receiver": x.isa.at(8), "usage": x.isa.at(15)})
    for g in x.groups:
        for t in (t for t in g.transactions if t.accepted):
            found, summary = transaction_records(x, g, t, record_segment)
            out.records += found
            if "CTT01" in summary:
                out.totals["lineCount"] = str(int(out.totals.get("lineCount", "0")) + int(summary["CTT01"]))
    out.columns = list(dict.fromkeys(c for _, fields in out.records for c in fields))
    return out


def group_status(g: Group) -> str:
    accepted = sum(t.accepted for t in g.transactions)
    if not accepted:
        return "R"
    return "P" if accepted < len(g.transactions) else "E" if g.issues else "A"


def acknowledge(x: Interchange, interchange_control: int, group_control: int, now: datetime.datetime) -> str:
    """The 997 text for an interchange, parties swapped; control numbers count up from 1000 and 500 at the caller."""
    e = x.element
    first = x.groups[0] if x.groups else None
    us, them = (first.receiver, first.sender) if first else (x.isa.at(8), x.isa.at(6))
    pad = lambda s, n: s[:n].ljust(n)
    isa = f"{interchange_control:09d}"
    out = [
        ["ISA", "00", " " * 10, "00", " " * 10, x.isa.at(7), pad(x.isa.at(8), 15), x.isa.at(5), pad(x.isa.at(6), 15), f"{now:%y%m%d}", f"{now:%H%M}", "U", "00401", isa, "0", x.isa.at(15) or "P", x.component],
        ["GS", "FA", us, them, f"{now:%Y%m%d}", f"{now:%H%M}", str(group_control), "X", "004010"],
    ]
    for n, g in enumerate(x.groups, 1):
        body = [["ST", "997", f"{n:04d}"], ["AK1", g.functional, g.control]]
        for t in g.transactions:
            body += [["AK2", t.type, t.control], ["AK5", "A"] if t.accepted else ["AK5", "R", t.issues[0][0] or "5"]]
        count = str(len(g.transactions))
        body.append(["AK9", group_status(g), count, count, str(sum(t.accepted for t in g.transactions))])
        out += [*body, ["SE", str(len(body) + 1), f"{n:04d}"]]
    out += [["GE", str(len(x.groups)), str(group_control)], ["IEA", "1", isa]]
    return "".join(e.join(s) + x.terminator + "\n" for s in out)


# ---- over many files

#: The first control numbers of acknowledgments; fixed values.
FIRST_INTERCHANGE, FIRST_GROUP = 1000, 500
ACKS = "file_id string, interchange long, group_control long, ack string"


def acknowledge_files(files: DataFrame, acks: DataFrame | None = None, now: datetime.datetime | None = None) -> DataFrame:
    """(file_id, interchange, group_control, ack) of (file_id, text): the 997 of each interchange, with control numbers that leave no gap.

    ``acks`` are those of earlier runs: a file among them keeps its numbers, so a batch that is tried again says the same; others are numbered on from the highest, in
    the order of their ids. Ranges of ids are sorted apart and each is moved by the number of those before it. Files that are no interchange have no acknowledgment and take no number.
    """
    spark, now = files.sparkSession, now or datetime.datetime.now()
    acks = spark.createDataFrame([], ACKS) if acks is None else acks
    top = acks.agg(F.max("interchange").alias("i"), F.max("group_control").alias("g")).first()
    first = [FIRST_INTERCHANGE if top["i"] is None else top["i"] + 1, FIRST_GROUP if top["g"] is None else top["g"] + 1]
    body = F.ltrim(F.regexp_replace("text", "^\ufeff", ""))
    whole = files.where(body.startswith("ISA")).select("file_id", "text")
    ids = whole.select("file_id").distinct().join(acks.select("file_id"), "file_id", "left_anti")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = ids.repartitionByRange(ranges, "file_id").sortWithinPartitions("file_id").withColumn("_at", F.monotonically_increasing_id())
    at = kept(at.select("file_id", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place")))
    starts, upto = {}, 0
    for r in sorted(at.groupBy("_range").count().collect()):  # a row for each range
        starts[r["_range"]], upto = upto, upto + r["count"]
    moved = F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]) if starts else F.create_map().cast("map<bigint,bigint>")
    place = F.col("_place") + F.try_element_at(moved, F.col("_range"))
    fresh = at.select("file_id", (place + first[0]).alias("interchange"), (place + first[1]).alias("group_control"))
    numbers = fresh.unionByName(acks.select("file_id", "interchange", "group_control"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for file_id, text, i, g in f[["file_id", "text", "interchange", "group_control"]].itertuples(index=False):
                try:
                    rows.append((file_id, i, g, acknowledge(parse(text), int(i), int(g), now)))
                except X12Error:
                    rows.append((file_id, i, g, None))
            yield pd.DataFrame(rows, columns=["file_id", "interchange", "group_control", "ack"])

    return whole.join(numbers, "file_id").mapInPandas(run, ACKS)

def segment_arrays(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, segs array of (pos, seg_id, elements)) of all files: the delimiters come from each file's first segment."""
    body = F.ltrim(F.regexp_replace(F.col(text), "^\ufeff", ""))
    head = files.select("file_id", body.alias("_t")).where(F.col("_t").startswith("ISA"))
    head = head.withColumn("_e", F.substring("_t", 4, 1))
    sixteenth = F.expr("length(substring_index(_t, _e, 16)) + 2")
    marked = head.withColumn("_x", F.substring("_t", sixteenth + 1, F.lit(1)))
    parts = F.transform(F.expr("split(_t, concat('\\\\Q', _x, '\\\\E'))"), lambda s: F.btrim(s, F.lit(" \t\r\n")))
    rows = marked.select("file_id", "_e", F.filter(parts, lambda s: s != "").alias("_s"))
    cells = rows.select("file_id", F.expr("transform(_s, x -> split(x, concat('\\\\Q', _e, '\\\\E')))").alias("_a"))
    one = lambda a, i: F.struct((i + 1).cast("long").alias("pos"), F.btrim(F.get(a, F.lit(0))).alias("seg_id"), F.slice(a, 2, 1 << 30).alias("elements"))
    return cells.select("file_id", F.transform("_a", one).alias("segs"))


def segments(files: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, pos, seg_id, elements): a row for each segment."""
    return segment_arrays(files, text).select("file_id", F.inline("segs"))


def _arrays(segs: DataFrame) -> DataFrame:
    """Segments in arrays by file, in their order, whether they are so already or lie in rows."""
    if "segs" in segs.columns:
        return segs
    return segs.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("pos", "seg_id", "elements"))).alias("segs"))


def envelope_counts(segs: DataFrame) -> DataFrame:
    """(file_id, tx_no, tx_type, n_segments, declared): every transaction's segments against its SE01.

    ``segs`` are rows of :func:`segments` or, which moves nothing, arrays of :func:`segment_arrays`. A transaction is the slice from one ST to the next.
    """
    starts = F.filter(F.transform("segs", lambda s, i: F.when(s["seg_id"] == "ST", i)), lambda i: i.isNotNull())
    held = _arrays(segs).withColumn("_st", starts)
    upto = lambda k: F.coalesce(F.get("_st", k + 1), F.size("segs"))
    slices = F.transform("_st", lambda i, k: F.filter(F.slice("segs", i + 1, upto(k) - i), lambda s: ~s["seg_id"].isin("GS", "GE", "IEA")))
    each = held.select("file_id", F.posexplode(slices).alias("_k", "_own"))
    ended = F.filter("_own", lambda s: s["seg_id"] == "SE")
    said = F.btrim(F.get(F.get(ended, F.lit(0))["elements"], F.lit(0)))
    kind = F.btrim(F.get(F.get("_own", F.lit(0))["elements"], F.lit(0)))
    return each.select("file_id", (F.col("_k") + 1).cast("long").alias("tx_no"), kind.alias("tx_type"), F.size("_own").cast("long").alias("n_segments"), said.try_cast("long").alias("declared"))


FLAT = "file_id string, tx_no long, loop_no long, line long, fields map<string,string>"


def _flat(file_id: str, x: Interchange, record: str | None) -> list[tuple]:
    out, number = [], 0
    for g in x.groups:
        for t in g.transactions:
            number += 1
            if t.accepted:
                found = transaction_records(x, g, t, record)[0]
                out += [(file_id, number, i, line, fields) for i, (line, fields) in enumerate(found, 1)]
    return out


def _flat_frames(files: Iterator[list[tuple]]) -> Iterator[pd.DataFrame]:
    """The rows of many files in frames of some thousand: a frame for each file would cost more than its rows."""
    frame = lambda rows: pd.DataFrame(rows, columns=["file_id", "tx_no", "loop_no", "line", "fields"])
    held: list[tuple] = []
    for rows in files:
        held += rows
        while len(held) >= 5000:
            yield frame(held[:5000])
            held = held[5000:]
    if held:
        yield frame(held)


def transactions(files: DataFrame, record: str | None = None) -> DataFrame:
    """(file_id, tx_no, loop_no, line, fields) of the loops of accepted transactions of (file_id, text): the same walk as of single files, and nothing is moved."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for f in frames:
            for file_id, text in zip(f["file_id"], f["text"], strict=True):
                try:
                    x = parse(text)
                except X12Error:
                    continue
                yield _flat(file_id, x, record)

    return files.select("file_id", "text").mapInPandas(lambda frames: _flat_frames(read(frames)), FLAT)


def flattened(segs: DataFrame, record: str | None = None) -> DataFrame:
    """The rows of :func:`transactions`, from segments."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
        for f in frames:
            for file_id, own in zip(f["file_id"], f["segs"], strict=True):
                yield _flat(file_id, walked([Segment(int(s["pos"]), s["seg_id"], tuple(s["elements"])) for s in own], "", "", ""), record)

    return _arrays(segs).mapInPandas(lambda frames: _flat_frames(read(frames)), FLAT)
