"""The store as a data source: ``spark.dataSource.register(StoreSource)``, then ``format("marlstone")``.

Options: ``path``, and ``table`` (pages, edges, facts, ...). Reading gives the table's log (with ``batch``) as of the last commit; with
``push`` bounds of ``batch`` choose the folders that are read. A stream reads commit by commit: its offset is a commit's number, so a micro-batch holds whole writes and is the same when
it is replayed. Writing appends rows as one commit, made when all tasks are done; a job that fails leaves nothing that readers see. Pages
are written by the store, as they bring their postings.

Spark runs these classes in Python workers without a session, so they read and write files with pyarrow; partitions are files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.operators.store import SCHEMAS


#: Arrow's types of the store's.
KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), os.path.abspath(path))


def _names(fs: pafs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if not f.base_name.startswith("."))


def _entry(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as stream:
        return json.loads(stream.read())


@dataclass
class FolderFile(InputPartition):
    path: str
    batch: int


class _Log:
    """The commits under a path, as seen without a session."""

    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "pages")
        self.fs, self.root = _open(self.path)

    def last(self) -> int:
        numbers = [int(n[:-5]) for n in _names(self.fs, f"{self.root}/_commits") if n.endswith(".json")]
        return max([0, *numbers, *(int(n[:20]) for n in _names(self.fs, f"{self.root}/_snapshots"))])

    def files(self, after: int, upto: int, whole: bool) -> list[FolderFile]:
        """Files of the commits in (after, upto]; ``whole``: or of the last snapshot in it and the commits after that."""
        folders = []
        snapshots = [n for n in _names(self.fs, f"{self.root}/_snapshots") if n.endswith(".json")]
        if snapshots and after < int(snapshots[-1][:20]) <= upto and (whole or not self._kept(after)):
            entry = _entry(self.fs, f"{self.root}/_snapshots/{snapshots[-1]}")
            after = entry["upto"]
            folders += [(f, after) for t, f in entry["folders"].items() if t == self.table]
        for name in _names(self.fs, f"{self.root}/_commits"):
            if name.endswith(".json") and after < int(name[:-5]) <= upto:
                folders += [(f, int(name[:-5])) for t, f in _entry(self.fs, f"{self.root}/_commits/{name}")["folders"].items() if t == self.table]
        return [FolderFile(f"{self.root}/{folder}/{n}", batch) for folder, batch in folders for n in _names(self.fs, f"{self.root}/{folder}") if n.endswith(".parquet")]

    def _kept(self, after: int) -> bool:
        """Whether the commit after this one is still there; else a stream begins with the snapshot."""
        return self.fs.get_file_info(f"{self.root}/_commits/{after + 1:020d}.json").type == pafs.FileType.File

    def rows(self, part: FolderFile, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        with self.fs.open_input_file(part.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=[n for n in schema.names if n != "batch"]):
                columns = [pa.array([part.batch] * batch.num_rows, pa.int64()) if f.name == "batch" else batch.column(f.name).cast(f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class StoreReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[FolderFile]:
        log = _Log(self.options)
        return [p for p in log.files(0, log.last(), True) if self.low <= p.batch <= self.high] or [FolderFile("", 0)]

    def read(self, partition: FolderFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _Log(self.options).rows(partition, to_arrow_schema(self.schema))


class PushingReader(StoreReader):
    """With the option ``push``, which needs the session's ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ``batch`` choose folders; Spark applies all filters itself as well."""
        for f in filters:
            if getattr(f, "attribute", None) == ("batch",):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f


class StoreStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema

    def initialOffset(self) -> dict:
        return {"commit": int(self.options.get("after", 0))}

    def latestOffset(self) -> dict:
        return {"commit": _Log(self.options).last()}

    def partitions(self, start: dict, end: dict) -> list[FolderFile]:
        return _Log(self.options).files(start["commit"], end["commit"], False) or [FolderFile("", 0)]

    def read(self, partition: FolderFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _Log(self.options).rows(partition, to_arrow_schema(self.schema))

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offset."""


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class StoreWriter(DataSourceWriter):
    """Each task writes a file to the write's folder; the commit names it."""

    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema, self.table = options, schema, options.get("table")
        if self.table not in SCHEMAS or self.table in ("pages", "postings"):
            raise ValueError("table has to be one of the store's, but for pages and postings, which the store writes itself")
        self.folder = f"data/{self.table}/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Written:
        from pyspark import TaskContext

        log, part = _Log(self.options), TaskContext.get().partitionId()
        full = pa.schema([(c.split()[0], KINDS[c.split()[1]]) for c in SCHEMAS[self.table].split(", ")])
        log.fs.create_dir(f"{log.root}/{self.folder}", recursive=True)
        writer, held, at = None, [], part << 33
        file = f"part-{part:05d}-{TaskContext.get().attemptNumber()}.parquet"

        def flush() -> None:
            nonlocal writer, held
            if writer is None:
                writer = pq.ParquetWriter(f"{log.root}/{self.folder}/{file}", full, filesystem=log.fs)
            writer.write_table(pa.Table.from_pylist(held, full))
            held = []

        for row in iterator:
            held.append({"row": at} | row.asDict())
            at += 1
            if len(held) >= 10_000:
                flush()
        if held:
            flush()
        if writer is not None:
            writer.close()
        return Written(None if writer is None else file)

    def commit(self, messages: list[Written | None]) -> None:
        log = _Log(self.options)
        good = {m.file for m in messages if m is not None}
        for name in _names(log.fs, f"{log.root}/{self.folder}"):
            if name not in good:  # of a task that was tried again
                log.fs.delete_file(f"{log.root}/{self.folder}/{name}")
        body = json.dumps({"folders": {self.table: self.folder}, "streams": {}}).encode()
        made = f"{log.root}/_written/{uuid.uuid4().hex}"
        for folder in ("_written", "_commits"):
            log.fs.create_dir(f"{log.root}/{folder}", recursive=True)
        with log.fs.open_output_stream(made) as out:
            out.write(body)
        while not _placed(log.fs, made, f"{log.root}/_commits/{log.last() + 1:020d}.json"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        log = _Log(self.options)
        if log.fs.get_file_info(f"{log.root}/{self.folder}").type == pafs.FileType.Directory:
            log.fs.delete_dir(f"{log.root}/{self.folder}")


def _placed(fs: pafs.FileSystem, made: str, to: str) -> bool:
    """Puts a commit in place under a free name, as ``commits`` does."""
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(made, to)
        except FileExistsError:
            return False
        os.unlink(made)
        return True
    if fs.get_file_info(to).type != pafs.FileType.NotFound:
        return False
    try:
        fs.move(made, to)
    except OSError:
        if fs.get_file_info(made).type == pafs.FileType.NotFound:
            raise
        return False
    return True


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marlstone"

    def schema(self) -> str:
        return f"{SCHEMAS[self.options.get('table', 'pages')]}, batch long"

    def reader(self, schema: T.StructType) -> StoreReader:
        kind = PushingReader if self.options.get("push") == "true" else StoreReader
        return kind(dict(self.options), schema)

    def streamReader(self, schema: T.StructType) -> StoreStream:
        return StoreStream(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> StoreWriter:
        if overwrite:
            raise ValueError("a store is only appended to")
        return StoreWriter(dict(self.options), schema)
