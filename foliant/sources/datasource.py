"""The format `office`: packages as a data source, and documents' files as a target.

    datasource.register(spark)
    spark.read.format("office").load("…/books")            # facts of all packages below
    df.write.format("office").mode("append").save("…/out") # rows of path and data become files

Reading: a file of up to `part_bytes` bytes (of XML) is a partition of its own together with others of its kind, a
larger one is split by its sheets, so that one large book is read by many tasks. The option `tables` lists the kinds to
read: parts that cannot hold any are not opened. Filters are not pushed down: Spark keeps one state of pushed filters for
all scans of a frame, so a frame joined with itself (as all results here are) would lose rows.

Writing: tasks write below a staging folder, under a name of their attempt; only when all have ended are their files
moved to where they belong, by the driver, so a repeated or lost task leaves nothing. Paths stay below the target.

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS), as driver and tasks of a Python data source
have no Hadoop client of their own.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import OfficeError
from .leaves import facts_of, unit_facts, units_of
from .package import Package

#: Kinds that the list of parts gives, and kinds that only the sheets themselves give.
MANIFEST, SHEET = {"format", "part", "rel"}, {"sheet_cell", "merge", "link", "error"}
FACTS = "doc_id string, kind string, part string, ord bigint, attrs map<string,string>"


def at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Files of a partition; unit: the only sheet or slide of the file to read, "" for all but those."""

    files: list[str]
    unit: str | None = None
    value: int = 0


class OfficeReader(DataSourceReader):
    def __init__(self, path: str, kinds: set[str] | None, part_bytes: int):
        self.path, self.kinds, self.part_bytes = path, kinds, part_bytes

    def partitions(self) -> list[Piece]:
        system, path = at(self.path)
        folder, _, pattern = path.rpartition("/")
        if any(c in pattern for c in "*?["):
            found = [i for i in system.get_file_info(fs.FileSelector(folder, recursive=False)) if fnmatch(i.base_name, pattern)]
        else:
            info = system.get_file_info(path)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        found = sorted((i for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        out, held, size = [], [], 0
        for i in found:
            if i.size > self.part_bytes:  # a large file by its sheets or slides, whose list is at its end
                with system.open_input_file(i.path) as stream:
                    try:
                        units = units_of(Package(stream))
                    except OfficeError:
                        units = []
                out += [Piece([i.path], u) for u in ["", *units]] if units else [Piece([i.path])]
                continue
            if held and size + i.size > self.part_bytes:
                out.append(Piece(held))
                held, size = [], 0
            held.append(i.path)
            size += i.size
        return [*out, *([Piece(held)] if held else [])] or [Piece([])]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = at(self.path)
        schema = pa.schema([("doc_id", pa.string()), ("kind", pa.string()), ("part", pa.string()), ("ord", pa.int64()), ("attrs", pa.map_(pa.string(), pa.string()))])
        needs = lambda kinds: self.kinds is None or not self.kinds.isdisjoint(kinds)
        listed = self.kinds is not None and self.kinds <= MANIFEST
        for path in piece.files:
            if piece.unit and not needs(SHEET):
                continue
            with system.open_input_file(path) as stream:
                found = unit_facts(stream, piece.unit) if piece.unit else facts_of(stream, listed, piece.unit == "" or not needs(SHEET))
                rows: list = []
                for r in found:
                    if self.kinds is None or r[0] in self.kinds:
                        rows.append(r)
                    if len(rows) == 8192:
                        yield self.batch(path, rows, schema)
                        rows = []
                if rows:
                    yield self.batch(path, rows, schema)

    @staticmethod
    def batch(path: str, rows: list, schema: pa.Schema) -> pa.RecordBatch:
        columns = [[path] * len(rows), *([r[i] for r in rows] for i in range(3)), [list(r[3].items()) for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task's files, their folders below the target, and 16 bytes for each file: the hash of its name.
    Names themselves stay with the files, as the driver may have millions to commit."""

    folder: str
    folders: list[str]
    names: bytes


class OfficeWriter(DataSourceWriter):
    """Rows of path and data (text or bytes) to files below the target."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.stage = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = at(self.path)
        folder = f"{root}/{self.stage}/{uuid.uuid4().hex}"  # of this attempt alone
        system.create_dir(folder, recursive=True)
        made, names = {""}, bytearray()
        for row in rows:
            name = posixpath.normpath(row["path"] or "")
            if name in ("", ".") or name.startswith(("/", "../")) or name == "..":
                raise ValueError(f"path outside the target: {row['path']!r}")
            data = row["data"]
            own, _, last = name.rpartition("/")
            if own not in made:
                system.create_dir(f"{folder}/{own}", recursive=True)
                made.add(own)
            names += blake2b(name.encode(), digest_size=16).digest()
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(data.encode() if isinstance(data, str) else bytes(data or b""))
        return Written(folder, sorted(made), bytes(names))

    def commit(self, messages: list) -> None:
        system, root = at(self.path)
        done = [m for m in messages if m is not None]
        names = np.sort(np.frombuffer(bytearray().join(m.names for m in done), [("a", ">u8"), ("b", ">u8")]), order=["a", "b"])
        if len(names) > 1 and (names[1:] == names[:-1]).any():
            self.abort(messages)
            raise ValueError("two rows for one path")
        del names
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name != self.stage:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        with ThreadPoolExecutor(32) as pool:  # each is a round trip to the store and no work
            for m in done:  # the files of a task's folder at a time
                for own in m.folders:
                    home = posixpath.join(root, own).rstrip("/")
                    system.create_dir(home, recursive=True)
                    found = system.get_file_info(fs.FileSelector(posixpath.join(m.folder, own).rstrip("/")))
                    for _ in pool.map(lambda i: system.move(i.path, f"{home}/{i.base_name}"), (i for i in found if i.type == fs.FileType.File)):  # noqa: B023
                        pass
        self.abort(messages)

    def abort(self, messages: list) -> None:
        system, root = at(self.path)
        if system.get_file_info(f"{root}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.stage}")


class OfficeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return FACTS

    def reader(self, schema) -> OfficeReader:
        kinds = self.options.get("tables")
        return OfficeReader(self.options["path"], set(kinds.split(",")) if kinds else None, int(self.options.get("part_bytes", 32 << 20)))

    def writer(self, schema, overwrite: bool) -> OfficeWriter:
        if not {"path", "data"} <= set(schema.fieldNames()):
            raise ValueError("rows to write have a path and data")
        return OfficeWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(OfficeSource)
