"""What the fourth review found: a file that cannot be read left no trace in the result."""

import pytest
from pyspark.sql import functions as F

from wharfline import catalog
from wharfline.plans import model
from wharfline.sources import reader

SF = "/root/testdata/sf0.001"


def test_a_nation_that_cannot_be_read_ends_the_job(spark, monkeypatch):
    """its customers were missing, and the rest looked like the whole result."""
    whole = catalog._as_files
    torn = F.when(F.col("file_id") == "NATION_7", F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    monkeypatch.setattr(catalog, "_as_files", lambda docs, suffix: whole(docs.withColumn("text", torn), suffix))
    with pytest.raises(Exception, match="NATION_7: invalid JSON at line 1"):
        catalog.json_records(spark, SF).collect()


def test_strict_reading_names_the_file_and_the_reason(spark):
    """files are left out only for those who read the reasons beside them."""
    rows = [("a", "a.json", b'[{"q": 1}]'), ("b", "b.json", b"{"), ("c", "c.xml", b"<a/>"), ("d", "d.json", b"[]")]
    files = spark.createDataFrame([(i, n, bytearray(c)) for i, n, c in rows], "file_id string, file_name string, content binary")
    ids = lambda df: [r["file_id"] for r in df.collect()]
    assert ids(reader.read_files(files, model.ReaderOptions())) == ["a"]
    assert {r["file_id"] for r in reader.read_meta(files, model.ReaderOptions()).where("error is not null").collect()} == {"b", "c"}
    assert ids(reader.read_files(files.where("file_id in ('a', 'd')"), model.ReaderOptions(), strict=True)) == ["a"]  # without records, but read
    for file_id, reason in (("b", "invalid JSON at line 1"), ("c", "XML files need a record element")):
        with pytest.raises(Exception, match=f"{file_id}: {reason}"):
            reader.read_files(files.where(F.col("file_id") == file_id), model.ReaderOptions(), strict=True).collect()
