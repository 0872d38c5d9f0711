"""A source and sink of text records on Spark's Python data source API, in Arrow batches."""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shipping import ship

#: What a record's line has for characters that would end it, and for null.
_ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}
_PLAIN = {v[1]: k for k, v in _ESCAPES.items()}
_NULL = "\\N"
#: Bytes of records that a batch holds, about.
_BATCH = 1 << 20
_SCHEMA = pa.schema([("position", pa.int64()), ("text", pa.string())])


def escaped(text: str | None) -> str:
    return _NULL if text is None else re.sub(r"[\\\n\r]", lambda m: _ESCAPES[m[0]], text)


def restored(line: str) -> str | None:
    return None if line == _NULL else re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], line) if "\\" in line else line


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it: a local path, or the address of any store that Arrow reads."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class RecordSource(DataSource):
    """``spark.read.format("records")`` and ``df.write.format("records")``: texts, each on a line of its own with line ends and
    backslashes escaped, so that any text, a null one too, comes back as it was.

    Options: path (a file, or a folder of part files, in a store that all executors reach), splits (byte ranges of a file that are read
    apart). Read: position (a record's first byte in its file) and text. Written: the only column, or the one named text.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "position long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("splits", 4)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        names = schema.fieldNames()
        return _Writer(self.options["path"], names.index("text") if "text" in names else 0, overwrite)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, splits: int):
        self.path, self.splits = path, max(1, splits)

    def partitions(self) -> list[InputPartition]:
        store, path = _opened(self.path)
        top = store.get_file_info(path)
        files = [f for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")] if top.type == fs.FileType.Directory else [top]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            step = max(1, -(-f.size // self.splits))
            out += [_Range(f.path, s, min(f.size, s + step)) for s in range(0, f.size, step)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """The records that start in the range: those after a line end before its last byte."""
        if not partition.end:
            return
        store, _ = _opened(self.path)
        with store.open_input_file(partition.path) as raw, io.BufferedReader(raw, _BATCH) as file:
            at = partition.start
            if at:
                file.seek(at - 1)
                at += len(file.readline()) - 1
            positions, texts, held = [], [], 0
            while at < partition.end:
                line = file.readline()
                if not line:
                    break
                positions.append(at)
                texts.append(restored(line.removesuffix(b"\n").decode()))
                at += len(line)
                held += len(line)
                if held >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(positions, pa.int64()), pa.array(texts, pa.string())], schema=_SCHEMA)
                    positions, texts, held = [], [], 0
            if positions:
                yield pa.RecordBatch.from_arrays([pa.array(positions, pa.int64()), pa.array(texts, pa.string())], schema=_SCHEMA)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    """Tasks write to a folder that readers pass by; files move to their place when all tasks have ended well. What a task that failed, or
    ran twice, has left goes with that folder."""

    def __init__(self, path: str, column: int, overwrite: bool):
        self.path, self.column, self.overwrite = path.rstrip("/"), column, overwrite
        self.folder = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _opened(self.path)
        store.create_dir(f"{path}/{self.folder}", recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{path}/{self.folder}/{name}") as file:
            for b in iterator:
                file.write("".join(escaped(t) + "\n" for t in b.column(self.column).to_pylist()).encode())
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = _opened(self.path)
        store.create_dir(path, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.base_name.startswith("part-"):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(f"{path}/{self.folder}/{m.name}", f"{path}/{m.name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, path = _opened(self.path)
        if store.get_file_info(f"{path}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{self.folder}")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and its code to the session's workers."""
    ship(spark)
    spark.dataSource.register(RecordSource)


def write_records(texts: DataFrame, path: str) -> None:
    """Texts (one string column, or the one named text) as a folder of record files."""
    register(texts.sparkSession)
    texts.select(F.col("text" if "text" in texts.columns else texts.columns[0]).alias("text")).write.format("records").mode("append").option("path", path).save()


def read_records(spark: SparkSession, path: str, splits: int = 4) -> DataFrame:
    register(spark)
    return spark.read.format("records").option("path", path).option("splits", splits).load()
