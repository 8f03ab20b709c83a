"""Parsers of logs, snapshots, artifacts, hooks."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.sources import frames, logs, snapshots

FILES = "id_videofile long, frame_count int, time_base_num int, time_base_den int"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scores(spark):
    lines = spark.createDataFrame([(1, "x lavfi.scd.score: 12.5, lavfi.scd.time: 0.06"), (1, "lavfi.scd.score: 3, lavfi.scd.time: 0.059"), (1, "lavfi.scd.score: 3, lavfi.scd.time: 99"), (1, "noise"), (1, None)], "id_videofile long, value string")
    files = spark.createDataFrame([(1, 10, 1, 25)], FILES)
    assert rows(logs.scores(lines, files)) == [(1, 1, 3.0), (1, 2, 12.5)]


def test_progress(spark):
    lines = spark.createDataFrame([("frame= 12 / 88 fps=1 speed=2.5x",), ("frame=1/2",), ("frame=1",)], "value string")
    assert rows(logs.progress(lines).select("done", "total", "note")) == [(1, 2, ""), (12, 88, "speed 2.5x")]


def test_sections(spark):
    text = ["stray=1", "[STREAM]", "index=0", "codec_type=video", "[SIDE_DATA]", "codec_type=none", "[/SIDE_DATA]", "codec_name = h264", "[/STREAM]", "between=2", "[STREAM]", "index=1", "codec_type=audio", "codec_name=a=c", "[/STREAM]", "[FORMAT]", "size=5", "[/FORMAT]"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "path string, line int, value string")
    got = logs.sections(lines)
    assert {r["section_name"]: r["fields"] for r in got.where("section_name IN ('FORMAT', 'SIDE_DATA')").collect()} == {"FORMAT": {"size": "5"}, "SIDE_DATA": {"codec_type": "none"}}
    assert rows(logs.streams(got).select("track_index", "codec_type", "codec_name")) == [(0, "video", "h264"), (1, "audio", "a=c")]


def test_keyframes_and_counts(spark):
    files = spark.createDataFrame([(1, 10, 1, 25)], FILES)
    lines = spark.createDataFrame([(1, "0.000000,K__"), (1, "0.02"), (1, "0.02,"), (1, "N/A"), (1, "5")], "id_videofile long, value string")
    assert rows(logs.keyframes(lines, files)) == [(1, 0), (1, 1)]
    counts = spark.createDataFrame([("a", "7"), ("a", ""), ("b", "0")], "path string, value string")
    assert rows(logs.packet_counts(counts.where("path = 'a'"))) == [("a", 7)]
    with pytest.raises(Exception, match="no frames in b"):
        logs.packet_counts(counts).collect()


def test_legacy_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿uuid;n\nx;1\ny;2\n".encode())
    assert rows(logs.legacy_csv(spark, str(tmp_path / "a.csv"), "uuid string, n int")) == [("x", 1), ("y", 2)]
    digest = "0" * 64
    (tmp_path / "sums.txt").write_text(f"{digest}  dir/a b.mkv\nbad line\n")
    assert rows(logs.checksum_list(spark, str(tmp_path / "sums.txt"))) == [(digest, "dir/a b.mkv")]


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/t"
    snapshots.publish(spark.range(3), path)
    snapshots.publish(spark.range(5), path)
    assert spark.read.parquet(snapshots.current(spark, path)).count() == 5
    first = snapshots.current(spark, path)
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        snapshots.publish(bad, path)
    assert snapshots.current(spark, path) == first
    snapshots.publish(spark.range(6), path)
    assert spark.read.parquet(snapshots.current(spark, path)).count() == 6 and snapshots.exists(spark, first)
    with pytest.raises(FileNotFoundError):
        snapshots.current(spark, f"{tmp_path}/none")
    log = f"{tmp_path}/log"
    snapshots.append(spark.range(5), log)
    snapshots.append(spark.range(2), log)
    assert spark.read.parquet(log).count() == 7
    parts = f"{tmp_path}/p"
    both = spark.range(4).withColumn("part", F.col("id") % 2)
    snapshots.replace_partitions(both, parts, "part")
    snapshots.replace_partitions(spark.range(10, 11).withColumn("part", F.lit(1)), parts, "part")
    assert sorted(r[0] for r in spark.read.parquet(parts).select("id").collect()) == [0, 2, 10]


def test_scan_and_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert rows(snapshots.scan(spark, "SELECT name FROM {t} WHERE id = :id", {"id": 2}, t=df)) == [("b",)]
    assert snapshots.only(df.where("id = 9")) is None and snapshots.only(df.where("id = 1"))["name"] == "a"
    with pytest.raises(ValueError):
        snapshots.only(df)
    watched, watch = snapshots.observed(df, F.col("id") > 1)
    assert watched.count() == 2 and watch.get["affected"] == 1


def test_file_digests(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert rows(snapshots.file_digests(spark, str(tmp_path)).select("size", "digest")) == [(3, hashlib.sha256(b"abc").hexdigest())]


def test_artifacts(spark, tmp_path):
    store = snapshots.Artifacts(spark, str(tmp_path))
    assert store.write(spark.range(3), "RECIPE", "k")["state"] == "READY" and store.read("RECIPE", "k").count() == 3
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    assert store.write(bad, "RECIPE", "bad")["state"] == "FAILED" and not store.exists("RECIPE", "bad")
    assert (store.state("RECIPE", "k"), store.state("RECIPE", "bad"), store.state("RECIPE", "none")) == ("READY", "FAILED", None)
    assert store.write(spark.range(2).select(F.col("id").cast("string").alias("t")), "RECIPE", "text", "t")["state"] == "READY" and spark.read.text(store.path("RECIPE", "text")).count() == 2
    assert store.delete("RECIPE", "k") and not store.exists("RECIPE", "k")


def test_hooks(spark):
    images = spark.createDataFrame([(1, 0, bytearray(b"x")), (1, 1, bytearray(b"yy"))], "id_videofile long, frame_number int, content binary")
    assert frames.detect(images).count() == 0
    found = frames.detect(images, lambda content: [[(0.0, 0.0, float(len(c)), 1.0, 0.5)] * len(c) for c in content])
    assert rows(found.select("frame_number", "face_index", "x2")) == [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 2.0)]
    faces = spark.createDataFrame([(1, bytearray(b"x"), 0, 0, 1, 1)], "face_id long, content binary, x1 int, y1 int, x2 int, y2 int")
    assert frames.embed(faces, lambda content, boxes: [np.array([3.0, 4.0]) for _ in content]).first()["vector"] == pytest.approx([0.6, 0.8])
