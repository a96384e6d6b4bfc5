"""Parsers of single partner files, as plain functions on bytes; :mod:`.reader` runs them in Spark tasks.

A parsed file is a :class:`Parsed`: records (line, ordered fields), column names, declared totals, context.
"""

from __future__ import annotations

import functools
import io
import json
import re
import zipfile
from collections import Counter
from dataclasses import dataclass, field
from decimal import Decimal
from xml.etree import ElementTree
from xml.parsers import expat

from ..functions import text as T
from ..operators.mapping import normal as _normal
from ..plans.model import ReaderOptions

# Bounds of sniffing, words of headers, footers.
HEAD_BYTES, SNIFF_LINES, HEADER_ROWS = 8192, 40, 25
DELIMITERS = [",", "|", "\t", ";"]
HEADER_WORDS = set(
    "no number num date dt qty quantity amount amt rate price total invoice inv po order item sku code description desc uom unit tax "
    "gst gstin hsn line currency id name value part material sr sl".split()
)
FOOTER = re.compile(r"(?i)(grand\s*total|sub\s*-?\s*total|total|end\s+of\s+(report|file|data)|\*{3,})")
FORMATS = ["CSV", "XLSX", "X12", "XML", "JSON", "FIXED_WIDTH", "UNKNOWN"]
FORMAT_ALIASES = {"EDI": "X12", "FIXED": "FIXED_WIDTH", "FIXEDWIDTH": "FIXED_WIDTH", "FLAT": "FIXED_WIDTH", "EXCEL": "XLSX"}
EXTENSIONS = {"xlsx": "XLSX", "xlsm": "XLSX", "edi": "X12", "x12": "X12", "810": "X12", "850": "X12", "xml": "XML", "json": "JSON"}

#: Files of a partner repeat their headers and many of their cells.
normal = functools.lru_cache(1 << 14)(_normal)
NUMERIC, DATE_SHAPE = re.compile(T.NUMERIC), re.compile(T.DATE_SHAPE)


class ReadError(ValueError):
    """A file that its format's parser cannot read."""


@dataclass
class Parsed:
    records: list[tuple[int, dict[str, str]]] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    totals: dict[str, str] = field(default_factory=dict)
    context: dict[str, str] = field(default_factory=dict)


# ---- sniffing

def format_name(name: str | None) -> str:
    key = (name or "").strip().upper().replace("-", "_").replace(" ", "_")
    key = FORMAT_ALIASES.get(key, key)
    return key if key in FORMATS else "UNKNOWN"


def sniff(file_name: str, head: bytes) -> str:
    """The format: magic bytes, then first characters, then the extension, then the shape of lines."""
    if head[:4] == b"PK\x03\x04":
        return "XLSX"
    text = head[:HEAD_BYTES].decode("utf-8", "replace").removeprefix("﻿").lstrip()
    for start, found in (("ISA", "X12"), ("<", "XML"), ("{", "JSON"), ("[", "JSON")):
        if text.startswith(start):
            return found
    known = EXTENSIONS.get(file_name.rpartition(".")[2].lower() if "." in file_name else "")
    if known:
        return known
    if looks_fixed(text):
        return "FIXED_WIDTH"
    return "CSV" if text.strip() else "UNKNOWN"


def looks_fixed(text: str) -> bool:
    lines = [line for line in text.splitlines() if line.strip()][:20]
    if len(lines) < 3 or any(sum(d in line for line in lines) > len(lines) // 2 for d in DELIMITERS):
        return False
    return sum("  " in line and len(line) >= 30 for line in lines) >= 0.8 * len(lines)


def sniff_delimiter(lines: list[str]) -> str:
    """The candidate whose count per line, quotes apart, agrees most."""
    lines = [re.sub(r'"[^"]*("|$)', "", line) for line in lines[:SNIFF_LINES] if line.strip()]
    best, top = ",", -1.0
    for d in DELIMITERS:
        counts = Counter(line.count(d) for line in lines)
        if not counts:
            continue
        mode, n = max(counts.items(), key=lambda kv: (kv[1], kv[0]))
        score = 10 * n / len(lines) + min(mode, 30) / 30
        if mode and score > top:
            best, top = d, score
    return best


# ---- tabular

class RowReader:
    """Rows of delimited text from its lines, fed one at a time without their line feed.

    A quote opens a quoted cell only where nothing but white space stands before it; within one, line feeds belong to the cell and two quotes are one. After the closing quote, and in
    other cells, quotes are ordinary characters. Rows end at a line feed, a carriage return or both. A quoted cell that is never closed ends with the text.
    ``inside`` and ``line`` are where reading begins: within a quoted cell or not, and the number of the physical line.
    """

    def __init__(self, delimiter: str, inside: bool = False, line: int = 1):
        d = re.escape(delimiter)
        self.delimiter, self.inside, self.line, self.start = delimiter, inside, line, line
        self.cells: list[str] = []
        self.open = ""
        self.opening, self.bare = re.compile(rf'([^\S{d}\r]*+)"'), re.compile(rf"[^{d}\r]*+")
        self.quoted = re.compile(r'([^"]*+(?:""[^"]*+)*+)("?)')

    def _close(self, text: str, at: int) -> int:
        """Read on in a quoted cell; where it ends, or -1 if it goes on in the next line."""
        m = self.quoted.match(text, at)
        self.open += m[1].replace('""', '"')
        if not m[2]:
            self.open, self.inside = self.open + "\n", True
            self.line += 1
            return -1
        self.inside, rest = False, self.bare.match(text, m.end())
        self.open += rest[0]
        return rest.end()

    def feed(self, text: str) -> list[tuple[int, list[str]]]:
        """(first line, cells) of the rows that end in this line."""
        if not self.inside and '"' not in text and "\r" not in text[:-1]:
            self.line += 1
            return [(self.line - 1, text.removesuffix("\r").split(self.delimiter))]
        rows, at = [], 0
        fresh = not self.inside
        if fresh:
            self.start = self.line
        while True:
            if fresh:
                m = self.opening.match(text, at)
                if m:
                    self.open = m[1]
                    at = self._close(text, m.end())
                else:
                    m = self.bare.match(text, at)
                    self.open, at = m[0], m.end()
            else:
                at = self._close(text, 0)
            if at < 0:
                return rows
            self.cells.append(self.open)
            fresh, self.open = True, ""
            if at < len(text) and text[at] == self.delimiter:
                at += 1
                continue
            rows.append((self.start, self.cells))
            self.cells = []
            self.line += 1
            self.start = self.line
            if at + 1 >= len(text):
                return rows
            at += 1

    def finish(self) -> list[tuple[int, list[str]]]:
        """The row of a quoted cell that the text ends within."""
        return [(self.start, [*self.cells, self.open.removesuffix("\n")])] if self.inside else []


def csv_rows(text: str, delimiter: str) -> list[tuple[int, list[str]]]:
    """(physical first line, cells) of each row of a whole text."""
    reader = RowReader(delimiter)
    lines = text.removeprefix("\ufeff").split("\n")
    if not lines[-1]:
        lines.pop()
    return [row for line in lines for row in reader.feed(line)] + reader.finish()


def blank(cell: str | None) -> bool:
    return not (cell or "").strip()


@functools.lru_cache(1 << 14)
def is_label(cell: str) -> bool:
    s = cell.strip()
    digits = sum(ch.isdigit() for ch in s)
    return 0 < len(s) <= 40 and any(ch.isalpha() for ch in s) and digits <= 0.25 * len(s) and not NUMERIC.match(s) and not DATE_SHAPE.match(s)


def _filled(row: list[str]) -> list[str]:
    return [c for c in row if not blank(c)]


@functools.lru_cache(1 << 14)
def _number(cell: str) -> bool:
    return NUMERIC.match(cell.strip()) is not None


def _numeric(row: list[str]) -> bool:
    return any(map(_number, _filled(row)))


def header_score(rows: list[list[str]], i: int) -> float:
    cells = _filled(rows[i])
    n = len(cells)
    if n < 2 or sum(map(is_label, cells)) < 0.6 * n:
        return 0.0
    below = [r for r in rows[i + 1 :] if _filled(r)][:5]
    alike = sum(len(_filled(r)) >= max(2, 0.5 * n) for r in below) / len(below) if below else 0.3
    data = sum(map(_numeric, below)) / len(below) if below else 0.3
    words = sum(bool(HEADER_WORDS & set(normal(c).split(" "))) for c in cells)
    return n * (sum(map(is_label, cells)) / n) * (len({normal(c) for c in cells}) / n) * (0.4 + 0.6 * alike) * (0.5 + 0.5 * data) + 0.75 * words


def locate_header(rows: list[list[str]]) -> int:
    """The best of the first rows, -1 if none looks like a header; a repeated row never beats its first occurrence."""
    best, top, seen = -1, 0.0, set()
    for i, row in enumerate(rows):
        mark = tuple(map(normal, row))
        if mark not in seen:
            seen.add(mark)
            score = header_score(rows, i)
            if score > top + 1e-9:
                best, top = i, score
    return best


def _gap(top: list[str], bottom: list[str]) -> bool:
    return any(blank(a) and not blank(b) for a, b in zip(top, bottom, strict=False))


def _labels(row: list[str]) -> bool:
    cells = _filled(row)
    return len(cells) >= 2 and all(map(is_label, cells))


@functools.lru_cache(1 << 14)
def header_name(cell: str | None) -> str:
    s = re.sub(r"\s+", " ", (cell or "").replace(" ", " ")).strip()
    return re.sub(r"[.:\s]*[.:]$", "", s)


def column_names(group: list[str] | None, header: list[str]) -> list[str]:
    """Unique names; a group label carries right over the columns below it."""
    names, carried = [], ""
    for i in range(max(len(header), len(group or []))):
        own = header_name(header[i] if i < len(header) else "")
        above = header_name(group[i] if i < len(group) else "") if group else ""
        carried = above or (carried if own else "")
        over = carried if group else ""
        name = own if not over or (own and normal(over) == normal(own)) else f"{over} {own}".strip()
        names.append(name or f"column_{i + 1}")
    out, seen = [], set()
    for name in names:
        unique, n = name, 2
        while unique.lower() in seen:
            unique, n = f"{name} ({n})", n + 1
        seen.add(unique.lower())
        out.append(unique)
    return out


@dataclass(frozen=True)
class Heading:
    """Names of a table's columns, the normalised cells of its header row, and the number of its last line (0 where there is none)."""

    names: list[str]
    keys: list[str]
    last: int

    def record(self, cells: list[str]) -> dict[str, str] | None:
        """The fields of a row below the header; None for blank rows, footers and repeated headers."""
        filled = _filled(cells)
        if not filled or FOOTER.match(filled[0].strip()):
            return None
        compared = [(k, c) for k, c in zip(self.keys, cells, strict=False) if k]
        if len(compared) >= 2 and sum(k == normal(c) for k, c in compared) >= 0.8 * len(compared):
            return None
        fields, n = {}, len(self.names)
        for i in range(max(n, len(cells))):
            value = (cells[i] if i < len(cells) else "").replace("\u00a0", " ").strip()
            if i < n or value:
                fields[self.names[i] if i < n else f"column_{i + 1}"] = value
        return fields


def heading(rows: list[tuple[int, list[str]]], header_row: int | None = None) -> Heading:
    """The heading of a table, from its first HEADER_ROWS rows."""
    rows = rows[:HEADER_ROWS]
    head = [cells for _, cells in rows]
    at = next((i for i, (n, _) in enumerate(rows) if n == header_row), -1) if header_row is not None else locate_header(head)
    if at < 0:
        return Heading([f"column_{i + 1}" for i in range(max(map(len, head), default=0))], [], 0)
    header, group, last = head[at], None, at
    follows = next((r for r in head[at + 2 :] if _filled(r)), None)
    if at + 1 < len(head) and _labels(head[at + 1]) and _gap(header, head[at + 1]) and follows is not None and _numeric(follows):
        header, group, last = head[at + 1], header, at + 1
    elif at and _labels(head[at - 1]) and all(len(c.strip()) <= 25 for c in _filled(head[at - 1])) and _gap(head[at - 1], header):
        group = head[at - 1]
    return Heading(column_names(group, header), [normal(c) for c in header], rows[last][0])


def tabular(rows: list[tuple[int, list[str]]], header_row: int | None = None) -> Parsed:
    """Records below the header; blank rows, footers and repeated headers are left out."""
    top = heading(rows, header_row)
    out = Parsed(columns=list(top.names))
    for number, cells in rows:
        fields = top.record(cells) if number > top.last else None
        if fields is not None:
            out.records.append((number, fields))
            out.columns += [c for c in fields if c not in out.columns]
    return out


def read_csv(data: bytes, o: ReaderOptions) -> Parsed:
    text = data.decode(o.charset, "replace").removeprefix("﻿")
    return tabular(csv_rows(text, o.delimiter or sniff_delimiter(text.splitlines())), o.header_row)


# ---- spreadsheets, from the parts of the zip archive

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _shown(value: str, code: str) -> str:
    """A number as its cell shows it, for plain, grouped, fixed-decimal, percent and date formats."""
    try:
        number = Decimal(value)
    except ArithmeticError:
        return value
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower()
    if re.search("[dmy]", bare) and bare != "general":
        import datetime

        day = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(number))
        parts = {"yyyy": "%Y", "yy": "%y", "mmmm": "%B", "mmm": "%b", "mm": "%m", "m": str(day.month), "dd": "%d", "d": str(day.day)}
        return day.strftime(re.sub("y{2,4}|m{1,4}|d{1,2}", lambda m: parts.get(m[0], m[0]), bare.split(";")[0]))
    section = bare.split(";")[0]
    percent = "%" in section
    number = number * 100 if percent else number
    if section in ("general", "@", "") or not re.search("[0#]", section):
        shown = format(number.normalize(), "f")
    else:
        places = len(m[1]) if (m := re.search(r"\.([0#]+)", section)) else 0
        shown = f"{number:,.{places}f}" if "," in section else f"{number:.{places}f}"
    return shown + "%" * percent


def xlsx_rows(data: bytes, sheet: str | None) -> list[tuple[int, list[str]]]:
    """(row number, displayed cells) of the named or first sheet; formulas by their cached values."""
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ReadError(f"not a spreadsheet: {e}") from None
    load = lambda name: ElementTree.fromstring(book.read(name))
    names = set(book.namelist())
    shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in load("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
    codes: dict[int, str] = {14: "m/d/yyyy", 9: "0%", 10: "0.00%", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 49: "@"}
    styles: list[str] = []
    if "xl/styles.xml" in names:
        root = load("xl/styles.xml")
        codes |= {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
        styles = [codes.get(int(x.get("numFmtId", 0)), "general") for x in root.iterfind("m:cellXfs/m:xf", _NS)]
    links = {r.get("Id"): r.get("Target") for r in load("xl/_rels/workbook.xml.rels")}
    sheets = [(s.get("name"), links[s.get(f"{{{_NS['r']}}}id")]) for s in load("xl/workbook.xml").iterfind("m:sheets/m:sheet", _NS)]
    target = next((t for n, t in sheets if n == sheet), None) if sheet else (sheets[0][1] if sheets else None)
    if target is None:
        raise ReadError(f"no sheet named '{sheet}'")
    out = []
    for row in load("xl/" + target.removeprefix("/xl/")).iterfind("m:sheetData/m:row", _NS):
        cells: list[str] = []
        for c in row.findall("m:c", _NS):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (at + 1 - len(cells))
            value, kind = c.findtext("m:v", "", _NS), c.get("t")
            if kind == "s":
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif kind == "b":
                value = "TRUE" if value == "1" else "FALSE"
            elif value and kind not in ("str", "e"):
                style = int(c.get("s", 0))
                value = _shown(value, styles[style] if style < len(styles) else "general")
            cells[at] = value
        out.append((int(row.get("r", len(out) + 1)), cells))
    return out


# ---- fixed width

def detail_type(o: ReaderOptions) -> str:
    return o.detail or (next(iter(o.layouts)) if len(o.layouts) == 1 else "D")


def line_type(o: ReaderOptions):  # noqa: ANN201
    """A function that tells the record type of a line: the longest that it starts with, None for blank and other lines."""
    kinds = sorted(o.layouts, key=len, reverse=True)
    return lambda line: None if blank(line) else next((k for k in kinds if line.startswith(k)), None)


def cut_fields(o: ReaderOptions, kind: str, line: str) -> dict[str, str]:
    return {c.name: line[c.start - 1 : c.start - 1 + c.length].strip() for c in o.layouts[kind]}


def header_fields(o: ReaderOptions, kind: str, line: str) -> dict[str, str]:
    return {f"{kind}.{n}": v for n, v in cut_fields(o, kind, line).items()}


def read_fixed(data: bytes, o: ReaderOptions) -> Parsed:
    """Detail lines with the header fields above them carried down as ``TYPE.NAME``."""
    if not o.layouts:
        raise ReadError("fixed-width files need a record layout in the mapping spec")
    detail, type_of = detail_type(o), line_type(o)
    out = Parsed(columns=[c.name if t == detail else f"{t}.{c.name}" for t, cs in o.layouts.items() for c in cs])
    held: dict[str, dict[str, str]] = {}
    declared = None
    for number, line in enumerate(re.split(r"\r\n|\n|\r", data.decode(o.charset, "replace")), 1):
        kind = type_of(line)
        if kind == detail:
            out.records.append((number, {n: v for vs in held.values() for n, v in vs.items()} | cut_fields(o, kind, line)))
        elif kind is not None and kind == o.trailer:
            if count := cut_fields(o, kind, line).get("RECORD_COUNT"):
                declared = (declared or 0) + int(count)
        elif kind is not None:
            held[kind] = header_fields(o, kind, line)
    if declared is not None:
        out.totals["lineCount"] = str(declared)
    return out


# ---- trees

def _scalar(v: object) -> str:
    return "" if v is None else ("true" if v else "false") if isinstance(v, bool) else format(v, "f") if isinstance(v, Decimal) else str(v)


def _flatten(v: object, path: str, out: dict[str, str]) -> None:
    if isinstance(v, dict):
        for k, x in v.items():
            _flatten(x, f"{path}/{k}" if path else k, out)
    elif isinstance(v, list):
        for i, x in enumerate(v, 1):
            _flatten(x, f"{path}[{i}]", out)
    else:
        out[path or "value"] = _scalar(v)


def read_json(data: bytes, o: ReaderOptions) -> Parsed:
    """Items of the first filled array of the record name, or of a root array; all scalars outside are context."""
    try:
        root = json.loads(data.decode(o.charset, "replace").strip().removeprefix("﻿"), parse_float=Decimal, parse_int=Decimal)
    except json.JSONDecodeError as e:
        raise ReadError(f"invalid JSON at line {e.lineno}: {e.msg}") from None
    out, items = Parsed(), []

    def collect(node: dict, path: str) -> None:
        for k, v in node.items():
            here = f"{path}/{k}" if path else k
            if k == o.record_element and isinstance(v, list) and not items:
                items.extend(v)
            elif isinstance(v, dict):
                collect(v, here)
            elif not isinstance(v, list):
                out.context[here] = _scalar(v)

    if isinstance(root, dict):
        collect(root, "")
    elif isinstance(root, list):
        items.extend(root)
    for n, item in enumerate(items, 1):
        fields = dict(out.context)
        _flatten(item, "", fields)
        out.records.append((n, fields))
        out.columns += [c for c in fields if c not in out.columns]
    return out


class _Xml:
    """Events of one document: context outside records, paths inside them; a DTD's entities are refused."""

    def __init__(self, element: str):
        self.element, self.out, self.stack = element, Parsed(), []
        self.context: dict[str, str] = {}
        self.fields: dict[str, str] | None = None
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.start, self.end, self.text
        self.parser.EntityDeclHandler = self._refuse

    @staticmethod
    def _refuse(*_: object) -> None:
        raise ReadError("entities are not read")

    def start(self, name: str, attributes: dict[str, str]) -> None:
        name = name.rpartition(":")[2]
        attributes = {k.rpartition(":")[2]: v for k, v in attributes.items() if not k.startswith("xmlns")}
        if self.stack:
            self.stack[-1]["leaf"] = False
        key = name
        if self.fields is not None:
            path = "/".join(x for x in [self.stack[-1]["key"], name] if x)
            n = self.seen[path] = self.seen.get(path, 0) + 1
            key = path if n == 1 else f"{path}[{n}]"
            self.fields |= {f"{key}/@{a}": v for a, v in attributes.items()}
        elif name == self.element:
            self.fields, self.seen, self.line = dict(self.context), {}, self.parser.CurrentLineNumber
            self.fields |= {f"@{a}": v for a, v in attributes.items()}
            self.depth, key = len(self.stack), ""
        else:
            self.context |= {f"{name}/@{a}": v for a, v in attributes.items()}
        self.stack.append({"name": name, "key": key, "leaf": True, "text": []})

    def text(self, data: str) -> None:
        if self.stack:
            self.stack[-1]["text"].append(data)

    def end(self, _: str) -> None:
        top = self.stack.pop()
        value = "".join(top["text"]).strip()
        if self.fields is not None:
            if len(self.stack) == self.depth:
                self.out.records.append((self.line, self.fields))
                self.out.columns += [c for c in self.fields if c not in self.out.columns]
                self.fields = None
            elif top["leaf"]:
                self.fields[top["key"]] = value
        elif top["leaf"] and value:
            self.context[f"{self.stack[-1]['name']}/{top['name']}" if self.stack else top["name"]] = value


def read_xml(data: bytes, o: ReaderOptions) -> Parsed:
    if not o.record_element:
        raise ReadError("XML files need a record element in the mapping spec")
    x = _Xml(o.record_element)
    try:
        x.parser.Parse(data.lstrip(), True)
    except expat.ExpatError as e:
        raise ReadError(f"malformed XML near line {e.lineno}: {e}") from None
    x.out.context = x.context
    return x.out


def read_x12(data: bytes, o: ReaderOptions) -> Parsed:
    from ..operators import edi

    return edi.records(edi.parse(data.decode(o.charset, "replace")), o.record_segment)


#: Readers by format; open for more.
READERS = {
    "CSV": read_csv, "XLSX": lambda d, o: tabular(xlsx_rows(d, o.sheet), o.header_row), "FIXED_WIDTH": read_fixed,
    "JSON": read_json, "XML": read_xml, "X12": read_x12,
}


def register(name: str, reader: object) -> None:
    READERS[name] = reader


def read(file_name: str, data: bytes, options: ReaderOptions, format: str = "UNKNOWN") -> Parsed:
    kind = format if format != "UNKNOWN" else sniff(file_name, data[:HEAD_BYTES])
    if kind not in READERS:
        raise ReadError(f"no reader for format {kind}")
    return READERS[kind](data, options)
