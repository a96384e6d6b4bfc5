"""The format ``partner`` in batches and streams against the reader of files."""

import os

import pytest
from test_engine import CSV, X12

from wharfline.plans.model import ReaderOptions
from wharfline.sources import reader
from wharfline.sources.datasource import PartnerFiles


@pytest.fixture
def inbox(spark, tmp_path):
    spark.dataSource.register(PartnerFiles)
    folder = tmp_path / "in"
    (folder / "acme").mkdir(parents=True)
    for i in range(6):
        (folder / "acme" / f"a {i}.csv").write_bytes(CSV)
    (folder / "b.edi").write_text(X12.format(9))
    (folder / "c.json").write_text('[{"q": 1}, {"q": 2}]')
    (folder / "broken.json").write_text("{")
    (folder / ".hidden.csv").write_bytes(CSV)
    return folder


def _rows(df):
    return sorted((r["file_id"].removeprefix("file:").lstrip("/"), r["seq"], r["line"], sorted(r["fields"].items()), list(r["columns"])) for r in df.collect())


def test_batch_equals_the_reader_of_files(spark, inbox):
    want = _rows(reader.read_files(reader.binary_files(spark, str(inbox)), ReaderOptions()))
    for size in ("1", "1000000"):
        df = spark.read.format("partner").option("partitionBytes", size).load(str(inbox))
        assert _rows(df) == want and len(want) > 10
        assert df.rdd.getNumPartitions() == (9 if size == "1" else 1)
    assert _rows(spark.read.format("partner").load(f"file://{inbox}")) == want
    assert spark.read.format("partner").load(str(inbox / "c.json")).count() == 2
    only = spark.read.format("partner").options(pattern="*.csv", columns="line, file_id", reader='{"headerRow": 1}').load(str(inbox))
    assert only.columns == ["line", "file_id"] and {r["file_id"][-3:] for r in only.collect()} == {"csv"}
    assert spark.read.format("partner").option("pattern", "none*").load(str(inbox)).count() == 0
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("partner").option("columns", "colour").load(str(inbox)).count()


def test_stream_takes_each_file_once(spark, inbox, tmp_path):
    for i, f in enumerate(sorted(p for p in inbox.rglob("*") if p.is_file())):
        os.utime(f, (1000 + i // 2, 1000 + i // 2))

    def run():
        stream = spark.readStream.format("partner").option("filesPerBatch", "3").load(str(inbox))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        return _rows(spark.read.parquet(str(tmp_path / "out")))

    want = _rows(spark.read.format("partner").load(str(inbox)))
    assert run() == want
    (inbox / "late.csv").write_bytes(CSV)
    again = run()
    assert len(again) == len(want) + sum("late" in r[0] for r in again) and again == _rows(spark.read.format("partner").load(str(inbox)))
