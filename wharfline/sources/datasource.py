"""Partner files as a Spark data source, for batches and streams.

    spark.dataSource.register(PartnerFiles)
    spark.read.format("partner").option("reader", '{"delimiter": ";"}').load("/inbox/acme")
    spark.readStream.format("partner").load("/inbox/acme")

Rows are those of :func:`.reader.read_files`. Options: ``path`` (a folder or file in any store that Arrow's file systems open, by its URI), ``pattern`` of file names
(``*``), ``format`` (sniffed for each file), ``reader`` (a spec's reader options as JSON), ``partitionBytes`` (files are dealt to tasks of about this size),
``columns`` (of the rows, comma-separated, where not all are needed: what is not asked for is not sent from the tasks) and, for
streams, ``filesPerBatch``. A file that cannot be read has no rows; :func:`.reader.read_meta` tells why.

A stream's offset is the time and name of the last file taken: files are taken in that order, each once, and a batch that is tried again has the same
files. A file is expected to appear whole (moved into the folder), with a later time than those before.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

RECORDS = "file_id string, seq long, line long, fields map<string,string>, columns array<string>"
ARROW = {"file_id": pa.string(), "seq": pa.int64(), "line": pa.int64(), "fields": pa.map_(pa.string(), pa.string()), "columns": pa.list_(pa.string())}
BATCH = 5000


class Files(InputPartition):
    """The files that one task reads."""

    def __init__(self, paths: tuple[str, ...]):
        self.paths = paths


class _Options:
    def __init__(self, options: dict[str, str], schema: StructType):
        from ..plans.model import load_reader

        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.format = options.get("format", "UNKNOWN")
        self.reader = load_reader(json.loads(options.get("reader", "{}")))
        self.size, self.files = int(options.get("partitionbytes", 128 << 20)), int(options.get("filesperbatch", 1000))
        self.names = schema.fieldNames()

    def system(self) -> tuple[fs.FileSystem, str, str]:
        """(file system, path on it, what stands before paths in ids)."""
        if "://" in self.path or self.path.startswith("file:"):
            system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
            return system, path, self.path.split("://")[0] + "://" if "://" in self.path else "file:"
        return fs.LocalFileSystem(), self.path, "file:"

    def listed(self) -> list[fs.FileInfo]:
        system, path, _ = self.system()
        top = system.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda f: any(p.startswith(("_", ".")) for p in f.path[len(path) :].split("/") if p)
        return [f for f in found if f.type == fs.FileType.File and not hidden(f) and fnmatch.fnmatch(f.base_name, self.pattern)]

    def dealt(self, files: list[fs.FileInfo]) -> Sequence[Files]:
        """Files in tasks of about ``size`` bytes, large ones first."""
        bins: list[tuple[int, list[str]]] = []
        for f in sorted(files, key=lambda f: (-f.size, f.path)):
            if bins and bins[-1][0] + f.size <= self.size:
                bins[-1] = (bins[-1][0] + f.size, [*bins[-1][1], f.path])
            else:
                bins.append((f.size, [f.path]))
        return [Files(tuple(paths)) for _, paths in bins]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        from .reader import _parse

        system, _, before = self.system()
        held: list[dict] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "fields" else r[n] for r in held], ARROW[n]) for n in self.names], names=self.names)
        for path in part.paths:
            with system.open_input_stream(path) as stream:
                content = stream.read()
            for seq, (line, fields) in enumerate(_parse(path.rpartition("/")[2], content, self.reader, self.format)[1].records):
                held.append({"file_id": before + path, "seq": seq, "line": line, "fields": fields, "columns": list(fields)})
                if len(held) == BATCH:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


class _Batch(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return self.options.dealt(self.options.listed()) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options, self.last = options, self.initialOffset()

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def _after(self, offset: dict) -> list[fs.FileInfo]:
        files = sorted(self.options.listed(), key=lambda f: (f.mtime_ns, f.path))
        return [f for f in files if (f.mtime_ns, f.path) > (offset["time"], offset["path"])]

    def latestOffset(self) -> dict:
        fresh = self._after(self.last)[: self.options.files]
        if fresh:
            self.last = {"time": fresh[-1].mtime_ns, "path": fresh[-1].path}
        return self.last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.last = max(self.last, end, key=lambda o: (o["time"], o["path"]))
        return self.options.dealt([f for f in self._after(start) if (f.mtime_ns, f.path) <= (end["time"], end["path"])])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)

    def commit(self, end: dict) -> None:
        pass


class PartnerFiles(DataSource):
    """The format ``partner``."""

    @classmethod
    def name(cls) -> str:
        return "partner"

    def schema(self) -> str:
        wanted = self.options.get("columns")
        if not wanted:
            return RECORDS
        of = {c.split(" ")[0]: c for c in RECORDS.split(", ")}
        unknown = [n for n in map(str.strip, wanted.split(",")) if n not in of]
        if unknown:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        return ", ".join(of[n.strip()] for n in wanted.split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Options(self.options, schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Options(self.options, schema))
