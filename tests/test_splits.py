"""Files read by many tasks against the parsers of whole files."""

import random

import pytest

from wharfline.plans.model import Layout, ReaderOptions
from wharfline.sources import parsers, splits


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few dozen bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "64"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _rows(df):
    return sorted(((r["line"], dict(r["fields"]), list(r["columns"])) for r in df.collect()), key=lambda r: r[0])


def _cell(rng):
    kind = rng.random()
    if kind < 0.5:
        return rng.choice(["plain", "12.50", "", " ", "x y", 'mid"dle', "é日本"])
    if kind < 0.8:
        return '"' + rng.choice(["a,b", 'q""uote', "two\nlines", "three\r\nlines\n", "", "lone\rreturn", "\n\n", 'end""', ",\n,", "x" * 90 + "\n" + "y" * 90]) + '"' + rng.choice(["", "", " tail", '"odd'])
    return rng.choice([' "spaced, quoted"', '\t"tab"', "'single'", "=1"])


def _text(rng, n):
    ends = rng.choice([["\n"], ["\r\n"], ["\n", "\r\n", "\r"]])
    body = [",".join(_cell(rng) for _ in range(rng.choice([3, 3, 3, 2, 5]))) for _ in range(n)]
    for i in rng.sample(range(n), n // 8):
        body[i] = rng.choice(["", ",,", "Total,,9", "Item No,Name,Qty", "end of report,,"])
    head = rng.choice(["", "Register of things\n\n", '"A preamble\nof two lines"\n'])
    return head + "Item No,Name,Qty\n" + "".join(x + rng.choice(ends) for x in body)


@pytest.mark.parametrize("seed", range(6))
def test_delimited_blocks_equal_whole_files(spark, small_blocks, tmp_path, seed):
    rng = random.Random(seed)
    text = _text(rng, 60)
    text = text + rng.choice(["", "last,one,1", 'open,"never closed\nto the end', '"', "a,b\r"])
    text = ("﻿" if seed % 2 else "") + text
    (tmp_path / "one file.csv").write_bytes(text.encode())
    want = parsers.read_csv(text.encode(), ReaderOptions())
    got = _rows(splits.csv_records(spark, str(tmp_path)))
    assert got == [(n, f, list(f)) for n, f in want.records] and len(got) > 20
    states = splits.quote_states(splits.lines(spark, splits.files_of(spark, str(tmp_path))), ",", "utf-8")
    assert states.select("block").distinct().count() > 5


def test_several_files_and_delimiters(spark, small_blocks, tmp_path):
    texts = {
        "a.csv": "Item No,Name,Qty\n1,x,2\n2,y,3\n3,z,4\n", "b.csv": 'Item No;Name;Qty\n1;"x;\n;y";2\n2;"y";3\n' * 1, "empty.csv": "",
        "c.csv": "Group,,Other,\nItem No,Name,Qty,Rate\n1,x,2,9\n2,y,3,9\n", "latin.csv": "Item No,Name,Qty\n1,caf\xe9,2\n2,y,3\n",
    }
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode("latin-1"))
    o = ReaderOptions(charset="latin-1")
    rows = splits.csv_records(spark, str(tmp_path), o).collect()
    for name, t in texts.items():
        want = parsers.read_csv(t.encode("latin-1"), o)
        assert sorted((r["line"], dict(r["fields"])) for r in rows if r["file_id"].endswith("/" + name)) == want.records


def test_a_row_over_many_blocks(spark, small_blocks, tmp_path):
    long = "\n".join(f"line {i} of a long cell" for i in range(60))
    text = f'Item No,Name,Qty\n1,"{long}",2\n2,"{long}\n",3\n3,z,4\n'
    (tmp_path / "f.csv").write_text(text)
    rows = _rows(splits.csv_records(spark, str(tmp_path)))
    assert [r[0] for r in rows] == [2, 62, 123] and dict(rows[0][1])["Name"] == long and dict(rows[2][1])["Qty"] == "4"


def test_heading_beyond_the_first_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "HEAD", 16)
    text = "A long preamble that is longer than the first bytes\n\nItem No,Name,Qty\n" + "1,x,2\n" * 40
    (tmp_path / "f.csv").write_text(text)
    assert _rows(splits.csv_records(spark, str(tmp_path))) == [(n, f, list(f)) for n, f in parsers.read_csv(text.encode(), ReaderOptions()).records]
    monkeypatch.setattr(splits, "MOST_FILES", 0)
    with pytest.raises(ValueError):
        splits.files_of(spark, str(tmp_path))


def test_tokens():
    rows = lambda t, d=",": parsers.csv_rows(t, d)
    assert rows('a,"b ""c"" d",e\n') == [(1, ["a", 'b "c" d', "e"])]
    assert rows('  "a,b"x,c"d"\r\n\ne,') == [(1, ["  a,bx", 'c"d"']), (2, [""]), (3, ["e", ""])]
    assert rows('a,"b\nc"\rd\n') == [(1, ["a", "b\nc"]), (3, ["d"])]
    assert rows('a\t"b\tc"', "\t") == [(1, ["a", "b\tc"])]
    assert rows('a,"b\nc') == [(1, ["a", "b\nc"])] and rows("") == [] and rows('""') == [(1, [""])] and rows('a,"\n') == [(1, ["a", ""])]


LAYOUTS = ReaderOptions(detail="D", trailer="T", layouts={
    "H": (Layout("INV", 2, 6),), "HX": (Layout("CODE", 3, 4),), "D": (Layout("PART", 2, 5), Layout("QTY", 7, 3)), "T": (Layout("RECORD_COUNT", 2, 4),),
})


@pytest.mark.parametrize("seed", range(3))
def test_fixed_width_blocks_equal_whole_files(spark, small_blocks, tmp_path, seed):
    rng = random.Random(seed)
    files = {}
    for name in ("a.txt", "b.txt"):
        lines = [rng.choice(["H" + f"{i:06d}", "HX" + f"{i:04d}", "D" + f"P{i:04d}{i % 7:3d}", "D" + f"P{i:04d}{i % 7:3d}", "", "?", "D", "T0003"]) for i in range(120)]
        files[name] = rng.choice(["", "\n"]) + "".join(x + rng.choice(["\n", "\r\n", "\r", "\n"]) for x in lines)
        (tmp_path / name).write_bytes(files[name].encode())
    rows = splits.fixed_records(spark, str(tmp_path), LAYOUTS).collect()
    for name, t in files.items():
        want = parsers.read_fixed(t.encode(), LAYOUTS).records
        assert sorted((r["line"], dict(r["fields"])) for r in rows if r["file_id"].endswith("/" + name)) == want and len(want) > 20
