"""Images and the hooks for what looks at them.

Decoding and inference are outside of this library. A detector is a function from a batch of image bytes to boxes, an
embedder from a batch of images and boxes to vectors; both run in the tasks, over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import sheet_place

Detector = Callable[[Sequence[bytes]], Sequence[Sequence[tuple[float, float, float, float, float]]]]
Embedder = Callable[[Sequence[bytes], Sequence[Sequence[tuple]]], Sequence[np.ndarray]]


def images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, content of image files; the boundary at which frames enter."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def no_faces(content: Sequence[bytes]) -> list[list[tuple]]:
    """A detector that finds nothing."""
    return [[] for _ in content]


def detect(frames: DataFrame, detector: Detector = no_faces) -> DataFrame:
    """id_videofile, frame_number, face_index, x1, y1, x2, y2, score for each box found in frames (.., content)."""

    def run(batches):
        for pdf in batches:
            found = detector(pdf["content"].tolist())
            rows = [(v, n, i, *box) for v, n, boxes in zip(pdf["id_videofile"], pdf["frame_number"], found, strict=True) for i, box in enumerate(boxes)]
            yield pd.DataFrame(rows, columns=["id_videofile", "frame_number", "face_index", "x1", "y1", "x2", "y2", "score"])

    schema = "id_videofile long, frame_number int, face_index int, x1 double, y1 double, x2 double, y2 double, score double"
    return frames.select("id_videofile", "frame_number", "content").mapInPandas(run, schema)


def embed(faces: DataFrame, embedder: Embedder) -> DataFrame:
    """face_id, vector (float, length 1) of faces (face_id, content, x1 .. y2). Zero vectors are an error."""

    def run(batches):
        for pdf in batches:
            boxes = [[tuple(b)] for b in pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False)]
            out = []
            for v in embedder(pdf["content"].tolist(), boxes):
                v = np.asarray(v, dtype=np.float32)
                size = float(np.linalg.norm(v))
                if not size:
                    raise ValueError("the embedder gave a zero vector")
                out.append((v / np.float32(size)).tolist())
            yield pd.DataFrame({"face_id": pdf["face_id"], "vector": out})

    return faces.mapInPandas(run, "face_id long, vector array<float>")


def places(frames: DataFrame) -> DataFrame:
    """frames with their place on the preview sheets."""
    return frames.withColumn("place", sheet_place(F.col("frame_number")))
