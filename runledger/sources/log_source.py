"""A3, K1: trace logs that are appended to, as a data source with byte offsets, in batch and as a stream.

Spark's file streams take a file once; a log grows. This source keeps, per file, the byte behind the last whole line that was
read, in the stream's own checkpoint, and reads on from there. A last line without its line break is left for the next read: its
writer may not be done. Large stretches are dealt to tasks in pieces, each of the lines that begin in it. Files are opened
through pyarrow's file systems, so a path may be local, shared or of a store that these know.

A log file is append-only. One that has become shorter than what was read of it fails the stream rather than losing or repeating
lines; a file that is gone contributes nothing more. Rows: file, at (byte where the line begins), value (the line without its
break, ill-formed UTF-8 replaced). Blank lines are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import checker
from ..schemas import TRACE_EVENT

NAME = "trace_log"
SCHEMA = "file string, at long, value string"
#: Bytes of a log that a task reads at most, but for the end of its last line; and that are looked at together for a line's end.
PIECE, BLOCK = 64 << 20, 1 << 16


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin from `start` on and before `end`; `first` where the stretch begins, at a line's first byte."""

    file: str
    first: int
    start: int
    end: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Sizes of the files at a path, a file or a folder; hidden ones are left out, and a path that is not there has none."""
    system, place = _open(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return {place: info.size}
    found = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    return {i.path: i.size for i in found if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))}


def whole_lines(system: fs.FileSystem, file: str, size: int, known: int = 0) -> int:
    """The byte behind the last line break before `size`; `known` if there is none behind that."""
    if size <= known:
        return known
    with system.open_input_file(file) as f:
        end = size
        while end > known:
            start = max(known, end - BLOCK)
            at = f.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


def _pieces(file: str, start: int, end: int, size: int) -> list[Piece]:
    return [Piece(file, start, at, min(at + size, end)) for at in range(start, end, size)]


def _lines(path: str, piece: Piece | None) -> Iterator[pa.RecordBatch]:
    if piece is None:  # what Spark asks for where a batch has no partition at all
        return
    system, _ = _open(path)
    with system.open_input_file(piece.file) as raw:
        at = piece.start
        if at > piece.first:  # a line that began before the piece is not its own
            raw.seek(at - 1)
            at += len(_readline(raw)) - 1
        raw.seek(at)
        places, values, held = [], [], 0
        for line in _each_line(raw):
            if at >= piece.end:
                break
            text = line.rstrip(b"\r\n")
            if text.strip():
                places.append(at)
                values.append(text.decode("utf-8", "replace"))
                held += len(text)
            at += len(line)
            if held > PIECE >> 4:
                yield _batch(piece.file, places, values)
                places, values, held = [], [], 0
        if places:
            yield _batch(piece.file, places, values)


def _each_line(raw) -> Iterator[bytes]:
    """Lines with their breaks, from the file's position on; only whole ones."""
    rest = b""
    while block := raw.read(BLOCK):
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            yield line + b"\n"


def _readline(raw) -> bytes:
    """The rest of the line at the file's position, with its break."""
    return next(_each_line(raw), b"")


def _batch(file: str, places: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(places)), pa.array(places, pa.int64()), pa.array(values)], ["file", "at", "value"])


class _Batch(DataSourceReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece = path, piece

    def partitions(self) -> list[Piece]:
        system, _ = _open(self.path)
        return [p for file, size in sorted(_files(self.path).items()) for p in _pieces(file, 0, whole_lines(system, file, size), self.piece)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, piece: int):
        self.path, self.piece, self.seen = path, piece, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _open(self.path)
        sizes = _files(self.path)
        # What was seen of a file is not looked at again; a file that is gone keeps its place.
        self.seen |= {file: whole_lines(system, file, size, self.seen.get(file, 0)) for file, size in sorted(sizes.items())}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        sizes = _files(self.path)
        out = []
        for file, to in sorted(end.items()):
            since = start.get(file, 0)
            if file in sizes and sizes[file] < to:
                raise ValueError(f"{file} has {sizes[file]} bytes, of which {to} were read: a log is only appended to")
            out += _pieces(file, since, to, self.piece) if file in sizes else []
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _lines(self.path, partition)


class TraceLog(DataSource):
    """Options: path, and pieceBytes for the stretch of one task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _piece(self) -> int:
        return int(self.options.get("pieceBytes", PIECE))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], self._piece())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._piece())


def lines(spark: SparkSession, path: str, stream: bool = False, piece: int = PIECE) -> DataFrame:
    """The whole lines of a log (file, at, value), as a table or as a stream of what is appended."""
    spark.dataSource.register(TraceLog)
    return (spark.readStream if stream else spark.read).format(NAME).option("pieceBytes", piece).load(path)


def events(rows: DataFrame, schema: str = TRACE_EVENT) -> DataFrame:
    """Lines as trace events: file, at, the event's fields, and `malformed`: the line where it is no JSON object, whose fields are then null."""
    good = F.try_parse_json("value").isNotNull() & checker.strip(F.col("value")).startswith("{")
    found = rows.withColumn("e", F.when(good, F.from_json("value", schema)))
    return found.select("file", "at", "e.*", F.when(~good, F.col("value")).alias("malformed"))
