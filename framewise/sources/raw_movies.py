"""Raw camera movies as a data source: frames of unsigned 16-bit pixels one after the other in a file, sessions put one after the other.

Files are read by ranges of bytes, so one file makes as many partitions as it has ranges, and a filter on ``at`` or ``session`` is pushed down
to the ranges that are read at all.  ``register(spark)`` makes it known; paths are what ``pyarrow.fs`` opens.

    spark.read.format("raw_movies").options(paths="a.raw\\nb.raw", height=64, width=128, drop=500).load().where("at between 1000 and 1999")
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "session long, frame long, at long, pixels array<int>"
#: Bytes of a partition and of a batch.
PARTITION, BATCH = 64 << 20, 4 << 20


def register(spark: SparkSession) -> None:
    """Makes the format ``raw_movies`` known to a session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawMovies)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    """Frames of a file: the first one's place in it, in its session and in all sessions, and their number."""

    path: str
    session: int
    skip: int
    frame: int
    at: int
    count: int


@dataclass
class Written(WriterCommitMessage):
    path: str


class RawMovies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_movies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawMovieReader:
        return RawMovieReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawMovieWriter:
        return RawMovieWriter(self.options)


class RawMovieReader(DataSourceReader):
    """Options: ``paths`` (files by line, or a folder whose files in order of names are the sessions), ``height``, ``width``, ``drop`` (frames left out at the start of each file), ``partition_bytes``."""

    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.pixels = int(options["height"]) * int(options["width"])
        self.drop, self.size = int(options.get("drop", 0)), int(options.get("partition_bytes", PARTITION))
        self.lo, self.hi, self.sessions = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("at",) and isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            elif name == ("at",) and isinstance(f, LessThanOrEqual | LessThan):
                self._under(f.value + isinstance(f, LessThanOrEqual))
            elif name == ("at",) and isinstance(f, EqualTo):
                self.lo = max(self.lo, f.value)
                self._under(f.value + 1)
            elif name == ("session",) and isinstance(f, EqualTo):
                self.sessions = {f.value} if self.sessions is None else self.sessions & {f.value}
            else:
                yield f

    def _under(self, end: int) -> None:
        self.hi = end if self.hi is None else min(self.hi, end)

    def _files(self) -> Iterator[tuple[str, int]]:
        for path in self.paths:
            system, inner = opened(path)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                for each in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda i: i.base_name):
                    if each.is_file and not each.base_name.startswith(("_", ".")):
                        yield (f"{path.rstrip('/')}/{each.base_name}", each.size)
            elif info.type == fs.FileType.File:
                yield path, info.size
            else:
                raise FileNotFoundError(path)

    def partitions(self) -> list[Stretch]:
        step, at, found = max(1, self.size // (2 * self.pixels)), 0, []
        for session, (path, size) in enumerate(self._files()):
            if size % (2 * self.pixels):
                raise ValueError(f"{path}: {size} bytes aren't whole frames of {self.pixels} pixels")
            n = max(0, size // (2 * self.pixels) - self.drop)
            first, last = max(0, self.lo - at), n if self.hi is None else min(n, self.hi - at)
            if self.sessions is None or session in self.sessions:
                found += [Stretch(path, session, self.drop + f, f, at + f, min(step, last - f)) for f in range(first, last, step)]
            at += n
        return found

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        system, inner = opened(part.path)
        step = max(1, BATCH // (2 * self.pixels))
        with system.open_input_file(inner) as f:
            f.seek(part.skip * 2 * self.pixels)
            for done in range(0, part.count, step):
                k = min(step, part.count - done)
                values = np.frombuffer(f.read(k * 2 * self.pixels), "<u2").astype(np.int32)
                pixels = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * self.pixels, pa.int32()), pa.array(values))
                frame = np.arange(done, done + k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, part.session, np.int64)), pa.array(part.frame + frame), pa.array(part.at + frame), pixels], schema=pa.schema([("session", pa.int64()), ("frame", pa.int64()), ("at", pa.int64()), ("pixels", pa.list_(pa.int32()))]))


class RawMovieWriter(DataSourceWriter):
    """Writes the ``pixels`` of each partition's rows, in their order, as a file of the folder ``path``; a task that runs again replaces its file."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> Written:
        context = TaskContext.get()
        name = f"{self.path}/part-{context.partitionId():05d}.raw"
        system, inner = opened(name)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        fresh = f"{inner.rsplit('/', 1)[0]}/.{context.taskAttemptId()}"
        with system.open_output_stream(fresh) as f:
            for row in rows:
                f.write(np.asarray(row["pixels"], "<u2").tobytes())
        system.move(fresh, inner)
        return Written(name)
