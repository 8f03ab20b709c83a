"""Files of any size in bounded memory, as Spark data sources: digests by blocks, raw frames by ranges, and a sink that pushes batches.

Paths are plain, or URIs of stores that pyarrow reaches (file, hdfs, s3, gs); they must be the same on driver and executors.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from ..shipping import ship

#: Fixed value: a digest is computed by blocks of so many bytes.
BLOCK = 4 << 20


def _store(path: str):
    """The file system of a path, and the path in it."""
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


def _files(path: str, pattern: str):
    """(path, size, mtime) of the files at or below a path whose names match, in order of path."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in store.get_file_info(stores.FileSelector(at, recursive=True)) if f.is_file]
    return sorted((f.path, f.size, f.mtime) for f in found if fnmatch(f.base_name, pattern))


def _named(path: str, inner: str) -> str:
    """A path of the store as a URI like that of the root, if the root was one."""
    return f"{path.split('://', 1)[0]}://{inner}" if "://" in path else inner


@dataclass
class OneFile(InputPartition):
    path: str
    size: int
    mtime: datetime | None


@dataclass
class Range(InputPartition):
    path: str
    size: int
    first: int
    frames: int


class Digests(DataSource):
    """SHA-256 of each file below ``path`` whose name matches ``pattern``; a partition a file, read by blocks of ``block`` bytes.

    A row each ``report`` blocks says how far the file is (done of size); the last of a file has its digest.
    """

    @classmethod
    def name(cls) -> str:
        return "digests"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp, done long, digest string"

    def reader(self, schema) -> DataSourceReader:
        return _DigestReader(self.options)


class _DigestReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.block, self.report = int(options.get("block", BLOCK)), int(options.get("report", 256))

    def partitions(self) -> list[InputPartition]:
        return [OneFile(*f) for f in _files(self.path, self.pattern)] or [OneFile("", -1, None)]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if partition.size < 0:
            return
        digest, done, blocks = hashlib.sha256(), 0, 0
        # naive timestamps are those of the session's clock to Spark, so moments carry their zone
        row = (_named(self.path, partition.path), partition.size, partition.mtime.astimezone(UTC) if partition.mtime else None)
        with _store(self.path)[0].open_input_stream(partition.path, buffer_size=0) as stream:
            while block := stream.read(self.block):
                digest.update(block)
                done, blocks = done + len(block), blocks + 1
                if blocks % self.report == 0 and done < partition.size:
                    yield (*row, done, None)
        if done != partition.size:
            raise OSError(f"{partition.path} had {partition.size} bytes when it was listed, {done} when it was read")
        yield (*row, done, digest.hexdigest())


class RawFrames(DataSource):
    """Frames of ``frame_bytes`` each from raw files: path, frame_number, content. A partition reads its range of frames alone.

    A file that ends within a frame is an error, which names the frame, raised by the partition that reaches it.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return "path string, frame_number long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FrameReader(self.options)


class _FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.bytes = int(options["frame_bytes"])
        self.frames = int(options.get("frames_a_partition", max(1, (128 << 20) // max(self.bytes, 1))))
        if self.bytes < 1 or self.frames < 1:
            raise ValueError("frame_bytes and frames_a_partition must be positive")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path, size, _ in _files(self.path, self.pattern):
            whole = -(-size // self.bytes)
            out += [Range(path, size, first, min(self.frames, whole - first)) for first in range(0, whole, self.frames)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.frames:
            return
        name = _named(self.path, partition.path)
        at_once = max(1, (8 << 20) // self.bytes)
        with _store(self.path)[0].open_input_file(partition.path) as file:
            file.seek(partition.first * self.bytes)
            for first in range(partition.first, partition.first + partition.frames, at_once):
                numbers = range(first, min(first + at_once, partition.first + partition.frames))
                content = []
                for number in numbers:
                    frame = file.read(self.bytes)
                    if len(frame) < self.bytes:
                        raise EOFError(f"frame {number} of {name} is cut off: {len(frame)} of {self.bytes} bytes")
                    content.append(frame)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(content), pa.string()), pa.array(numbers, pa.int64()), pa.array(content, pa.binary())], ["path", "frame_number", "content"])


class Pushed(DataSource):
    """A stream sink that appends batches as lines of JSON below ``path``: a batch appears whole, once, when it is committed.

    Tasks write files of their own; the commit of a batch names them in one small file, ``batches/<number>``. A batch
    that is run again finds its name taken and leaves what stands there; its own files go, as do those of an aborted one.
    """

    @classmethod
    def name(cls) -> str:
        return "pushed"

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:  # noqa: N802
        return _Pusher(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class _Pusher(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        store, root = _store(self.path)
        store.create_dir(f"{root}/files", recursive=True)
        name, n = f"files/{uuid.uuid4().hex}.json", 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for row in rows:
                out.write(json.dumps(row.asDict(recursive=True), default=str).encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = _store(self.path)
        target = f"{root}/batches/{batchId:012d}"
        if store.get_file_info(target).type != stores.FileType.NotFound:
            return self.abort(messages, batchId)
        store.create_dir(f"{root}/batches", recursive=True)
        fresh = f"{root}/batches/_{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as out:
            out.write("\n".join(m.name for m in messages if m and m.rows).encode())
        store.move(fresh, target)
        for m in messages:
            if m and not m.rows:
                store.delete_file(f"{root}/{m.name}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = _store(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")


def register(spark: SparkSession) -> None:
    """Make these sources known to the session."""
    ship(spark)
    for source in (Digests, RawFrames, Pushed):
        spark.dataSource.register(source)


def block_digests(spark: SparkSession, path: str, pattern: str = "*", block: int = BLOCK) -> DataFrame:
    """path, size, mtime, digest (SHA-256) of files of any size, each read by one task in blocks."""
    register(spark)
    return spark.read.format("digests").option("path", path).option("pattern", pattern).option("block", block).load().where("digest IS NOT NULL").drop("done")


def digest_progress(spark: SparkSession, path: str, pattern: str = "*", block: int = BLOCK, report: int = 256) -> DataFrame:
    """path, done, size, percent as files are read, a row each ``report`` blocks and one at the end of each."""
    register(spark)
    rows = spark.read.format("digests").option("path", path).option("pattern", pattern).option("block", block).option("report", report).load()
    percent = F.when(F.col("size") > 0, F.floor(F.col("done") * 100 / F.col("size"))).otherwise(F.lit(100)).cast("int")
    return rows.select("path", "done", "size", percent.alias("percent"))


def raw_frames(spark: SparkSession, path: str, frame_bytes: int, pattern: str = "*", frames_a_partition: int | None = None) -> DataFrame:
    """path, frame_number, content of raw files of frames of one size."""
    register(spark)
    reader = spark.read.format("raw_frames").option("path", path).option("pattern", pattern).option("frame_bytes", frame_bytes)
    return (reader.option("frames_a_partition", frames_a_partition) if frames_a_partition else reader).load()


def pushed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed batches below a path, with the number of their batch."""
    store, root = _store(path)
    found = store.get_file_info(stores.FileSelector(f"{root}/batches", allow_not_found=True))
    batches = [f"{_named(path, f.path)}" for f in found if f.is_file and not f.base_name.startswith("_")]
    if not batches:
        return spark.createDataFrame([], f"{schema}, batch long")
    names = spark.read.text(batches).select(F.col("value").alias("_name"), F.substring_index(F.input_file_name(), "/", -1).cast("long").alias("batch"))
    lines = spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{path}/files").withColumn("_name", F.concat(F.lit("files/"), F.substring_index(F.input_file_name(), "/", -1)))
    return lines.join(names, "_name").drop("_name")
