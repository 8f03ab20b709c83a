"""Files of any size, raw frames, pushed batches, sets of tables, and frames for several sinks."""

import hashlib
import os
import resource

import pytest
from pyspark.sql import functions as F

from framewright.sources import blocks, snapshots
from framewright.streaming import queue


def test_digests_of_files(spark, tmp_path):
    wanted = {}
    for name, data in {"a.bin": b"abc", "b.bin": b"", "sub/c.bin": os.urandom(10_000), "d.txt": b"no"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
        wanted[str(tmp_path / name)] = (len(data), hashlib.sha256(data).hexdigest())
    del wanted[str(tmp_path / "d.txt")]
    got = blocks.block_digests(spark, str(tmp_path), "*.bin", block=512)
    assert {r["path"]: (r["size"], r["digest"]) for r in got.collect()} == wanted
    assert abs(got.agg(F.max(F.unix_seconds("mtime"))).first()[0] - os.stat(tmp_path / "a.bin").st_mtime) < 5
    assert blocks.block_digests(spark, f"file://{tmp_path}/a.bin").first()["digest"] == wanted[str(tmp_path / "a.bin")][1]
    assert blocks.block_digests(spark, str(tmp_path), "*.none").count() == 0


def test_progress_of_a_digest(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"x" * 1000)
    got = [(r["done"], r["percent"]) for r in blocks.digest_progress(spark, str(tmp_path), block=100, report=3).orderBy("done").collect()]
    assert got == [(300, 30), (600, 60), (900, 90), (1000, 100)]


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """A sparse file beyond what a row can hold, in the memory of a block."""
    size = 3 << 30
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)
    want = hashlib.sha256()
    for _ in range(size // blocks.BLOCK):
        want.update(bytes(blocks.BLOCK))
    reader = blocks._DigestReader({"path": str(tmp_path)})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (part,) = reader.partitions()
    rows = list(reader.read(part))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000, "KB"
    assert len(rows) == 3 and rows[-1][3] == size and rows[-1][4] == want.hexdigest()
    assert blocks.block_digests(spark, str(tmp_path)).first()["digest"] == want.hexdigest()


def test_raw_frames_by_ranges(spark, tmp_path):
    frame = lambda n: bytes([n % 251]) * 30
    (tmp_path / "v.raw").write_bytes(b"".join(map(frame, range(23))))
    (tmp_path / "w.raw").write_bytes(frame(7))
    (tmp_path / "none.raw").write_bytes(b"")
    df = blocks.raw_frames(spark, str(tmp_path), 30, frames_a_partition=5)
    assert df.rdd.getNumPartitions() == 6
    got = {(os.path.basename(r["path"]), r["frame_number"]): bytes(r["content"]) for r in df.collect()}
    assert got == {("v.raw", n): frame(n) for n in range(23)} | {("w.raw", 0): frame(7)}
    assert blocks.raw_frames(spark, str(tmp_path), 30, "*.none").count() == 0


def test_a_partition_reads_its_range_alone(tmp_path):
    (tmp_path / "v.raw").write_bytes(bytes(range(100)))
    reader = blocks._FrameReader({"path": str(tmp_path), "frame_bytes": "10", "frames_a_partition": "4"})
    parts = reader.partitions()
    assert [(p.first, p.frames) for p in parts] == [(0, 4), (4, 4), (8, 2)]
    (batch,) = reader.read(parts[1])
    assert batch.column(1).to_pylist() == [4, 5, 6, 7] and batch.column(2).to_pylist()[0] == bytes(range(40, 50))


def test_a_cut_frame_is_named(spark, tmp_path):
    (tmp_path / "v.raw").write_bytes(b"x" * 105)
    df = blocks.raw_frames(spark, str(tmp_path), 10, frames_a_partition=4)
    with pytest.raises(Exception, match="frame 10 of .*v.raw is cut off: 5 of 10 bytes"):
        df.count()
    with pytest.raises(ValueError, match="positive"):
        blocks._FrameReader({"path": str(tmp_path), "frame_bytes": "0"})


def test_pushed_batches_appear_once(spark, tmp_path):
    """Two batches through a stream; then the second is run again as after a crash between its commit and the stream's own note of it."""
    blocks.register(spark)
    for n in range(2):
        spark.range(n * 10, n * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = queue.source(spark, str(tmp_path / "in"), "id long")

    def run():
        stream.writeStream.format("pushed").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["batch"], r["id"]) for r in blocks.pushed(spark, str(tmp_path / "out"), "id long").collect())

    first = run()
    assert [i for _, i in first] == list(range(20)) and {b for b, _ in first} == {0, 1}
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "cp" / name).unlink(missing_ok=True)
    assert run() == first
    assert len(list((tmp_path / "out" / "files").glob("*.json"))) == 2


def test_aborted_batches_leave_nothing(spark, tmp_path):
    sink = blocks._Pusher(str(tmp_path / "out"))
    rows = spark.range(3).collect()
    sink.commit([sink.write(iter(rows)), sink.write(iter([])), None], 0)
    sink.abort([sink.write(iter(rows)), None], 1)
    sink.commit([sink.write(iter(rows))], 0)
    assert blocks.pushed(spark, str(tmp_path / "out"), "id long").count() == 3 and len(os.listdir(tmp_path / "out" / "files")) == 1
    assert blocks.pushed(spark, str(tmp_path / "nothing"), "id long").collect() == []


def sizes(spark, path):
    return {name: df.count() for name, df in snapshots.together(spark, path).items()}


def test_sets_of_tables(spark, tmp_path):
    path = f"{tmp_path}/set"
    with pytest.raises(FileNotFoundError):
        snapshots.together(spark, path)
    snapshots.publish_together({"scenes": spark.range(3), "shots": spark.range(5)}, path)
    begun = snapshots.together(spark, path)
    snapshots.publish_together({"scenes": spark.range(4), "faces": spark.range(1)}, path)
    assert sizes(spark, path) == {"scenes": 4, "shots": 5, "faces": 1}
    assert begun["scenes"].count() == 3, "who has begun with a set reads it to the end"
    snapshots.publish_together({"shots": spark.range(6)}, path)
    snapshots.publish_together({"scenes": spark.range(7)}, path)
    assert sizes(spark, path) == {"scenes": 7, "shots": 6, "faces": 1} and len(os.listdir(f"{path}/scenes")) == 2


@pytest.mark.parametrize("step", ["first table", "second table", "manifest", "cleaning"])
def test_a_crash_leaves_a_whole_set(spark, tmp_path, monkeypatch, step):
    path = f"{tmp_path}/set"
    for n in (2, 3):
        snapshots.publish_together({"scenes": spark.range(n), "shots": spark.range(n)}, path)
    broken = spark.range(1).select(F.raise_error(F.lit("crash")).cast("long").alias("id"))
    new = {"scenes": broken if step == "first table" else spark.range(9), "shots": broken if step == "second table" else spark.range(9)}
    if step in ("manifest", "cleaning"):
        def crash(*_):
            raise RuntimeError("crash")

        monkeypatch.setattr(snapshots, "move" if step == "manifest" else "delete", crash)
    with pytest.raises(Exception, match="crash"):
        snapshots.publish_together(new, path)
    monkeypatch.undo()
    n = 9 if step == "cleaning" else 3
    assert sizes(spark, path) == {"scenes": n, "shots": n}
    snapshots.publish_together({"scenes": spark.range(4), "shots": spark.range(4)}, path)
    assert sizes(spark, path) == {"scenes": 4, "shots": 4} and len(os.listdir(f"{path}/scenes")) == 2, "what the crash left is gone"


def test_every_sink_sees_every_frame(spark, tmp_path):
    frames = spark.range(500).select(F.lit(1).alias("id_videofile"), F.col("id").cast("int").alias("frame_number"), F.lit(b"x").alias("content")).repartition(3)
    to = lambda name: lambda df: df.write.parquet(f"{tmp_path}/{name}")
    per_frame = lambda df: df.select("id_videofile", "frame_number", F.length("content").alias("n"))
    boxes = lambda df: df.select("id_videofile", "frame_number", F.posexplode(F.sequence(F.lit(0), F.col("frame_number") % 3)).alias("i", "box")).withColumn("_first", F.col("i") == 0)
    key = ["id_videofile", "frame_number"]
    got = snapshots.fan_out(frames, {"sizes": (per_frame, to("sizes")), "boxes": (boxes, to("boxes"))}, f"{tmp_path}/frames", key)
    assert got == {"sizes": 500, "boxes": spark.read.parquet(f"{tmp_path}/boxes").count()} and got["boxes"] > 900
    assert "_first" not in spark.read.parquet(f"{tmp_path}/boxes").columns
    skips = lambda df: per_frame(df).where("frame_number <> 77")
    with pytest.raises(RuntimeError, match="saw 499 of 500 frames"):
        snapshots.fan_out(frames, {"skips": (skips, to("skips"))}, f"{tmp_path}/frames2", key)
    other = lambda df: per_frame(df).withColumn("frame_number", F.when(F.col("frame_number") == 77, 78).otherwise(F.col("frame_number")))
    with pytest.raises(RuntimeError, match="other frames"):
        snapshots.fan_out(frames, {"other": (other, to("other"))}, f"{tmp_path}/frames3", key)
    assert snapshots.fan_out(frames.limit(0), {"sizes": (per_frame, to("none"))}, f"{tmp_path}/frames4", key) == {"sizes": 0}
