"""Detections: suppression of overlapping boxes, regions, quality against truth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou
from ..shipping import ship

BOX = ["x1", "y1", "x2", "y2"]
FRAMES_A_BLOCK = 64


def _overlap(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Intersection over union of one box with many."""
    w = np.minimum(box[2], boxes[:, 2]) - np.maximum(box[0], boxes[:, 0])
    h = np.minimum(box[3], boxes[:, 3]) - np.maximum(box[1], boxes[:, 1])
    inter = np.maximum(w, 0) * np.maximum(h, 0)
    union = (box[2] - box[0]) * (box[3] - box[1]) + (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1]) - inter
    return np.divide(inter, union, out=np.zeros(len(boxes)), where=union > 0)


def suppressed(boxes: np.ndarray, score: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes stay: the best first, each takes away those it overlaps by more than the threshold. Ties: the first."""
    order = np.argsort(-score, kind="stable")
    stays = np.zeros(len(boxes), dtype=bool)
    while len(order):
        best, order = order[0], order[1:]
        stays[best] = True
        order = order[_overlap(boxes[best], boxes[order]) <= threshold]
    return stays


def top(detections: DataFrame, k: int, by: Sequence[str] = ("id_videofile", "frame_number")) -> DataFrame:
    """The k best detections of each frame; ties by detection_id."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "detection_id"))
    return detections.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _sorted(detections: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows dealt by blocks of FRAMES_A_BLOCK frames, so that a long file is spread, and sorted by frame inside a task."""
    ship(detections.sparkSession)
    return detections.repartition(*by[:-1], F.floor(F.col(by[-1]) / FRAMES_A_BLOCK)).sortWithinPartitions(*by, "detection_id")


def _cuts(piece: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """Where frames begin in rows sorted by frame, and the end. Null is a frame of its own."""
    new = np.zeros(len(piece) - 1, dtype=bool)
    for c in by:
        values, null = piece[c].to_numpy(), piece[c].isna().to_numpy()
        new |= (values[1:] != values[:-1]) & ~(null[1:] & null[:-1])
    return np.flatnonzero(np.concatenate([[True], new, [True]]))


def _whole_frames(pieces: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[tuple[pd.DataFrame, list[slice]]]:
    """Pieces of a sorted partition cut between frames, with a slice for each frame: a frame that a piece ends in waits for the next."""
    rest = None
    for piece in pieces:
        block = piece if rest is None else pd.concat([rest, piece], ignore_index=True)
        if not len(block):
            continue
        cut = _cuts(block, by)
        rest = block.iloc[cut[-2] :].reset_index(drop=True)
        if len(cut) > 2:
            yield block.iloc[: cut[-2]], [slice(i, j) for i, j in zip(cut[:-2], cut[1:-1], strict=True)]
    if rest is not None:
        yield rest, [slice(0, len(rest))]


def non_maximum(detections: DataFrame, threshold: float, by: Sequence[str] = ("id_videofile", "frame_number")) -> DataFrame:
    """Detections that stay, columns unchanged. A frame's boxes are a bounded group; cut it with ``top`` first."""

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, frames in _whole_frames(pieces, by):
            b, score = block[BOX].to_numpy(dtype=np.float64), block["score"].to_numpy(dtype=np.float64)
            yield block[np.concatenate([suppressed(b[f], score[f], threshold) for f in frames])]

    return _sorted(detections, by).mapInPandas(run, detections.schema)


def detect(candidates: DataFrame, score_threshold: float, nms_threshold: float, k: int, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """Candidates to faces: threshold, best k, scale to the source's size, clip, suppression, whole numbers, no empty box.

    candidates: id_videofile, frame_number, detection_id, score, x1 .. y2 in the detector's pixels, width, height of the source.
    """
    some = top(candidates.where(F.col("score") > score_threshold), k)
    limit = {"x1": "width", "x2": "width", "y1": "height", "y2": "height"}
    for c in BOX:
        some = some.withColumn(c, F.least(F.greatest(F.col(c).cast("double") * (scale_x if c[0] == "x" else scale_y), F.lit(0.0)), F.col(limit[c]).cast("double")))
    kept = non_maximum(some, nms_threshold)
    for c in BOX:
        kept = kept.withColumn(c, F.bround(c).cast("int"))
    return kept.where("x2 > x1 AND y2 > y1")


def linked(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """The group of each box, numbered by first members: boxes that overlap by at least the threshold are linked."""
    group = np.full(len(boxes), -1)
    n = 0
    for i in range(len(boxes)):
        if group[i] >= 0:
            continue
        group[i], queue = n, [i]
        while queue:
            at = queue.pop()
            free = np.flatnonzero(group < 0)
            near = free[_overlap(boxes[at], boxes[free]) >= threshold]
            group[near] = n
            queue.extend(near.tolist())
        n += 1
    return group


def regions(boxes: DataFrame, threshold: float, by: Sequence[str] = ("id_videofile", "frame_number")) -> DataFrame:
    """One row for each group of boxes of a frame linked by overlaps of at least the threshold: region, x1 .. y2, boxes."""

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, frames in _whole_frames(pieces, by):
            b = block[BOX].to_numpy(dtype=np.float64)
            numbered = block.assign(region=np.concatenate([linked(b[f], threshold) for f in frames]))
            out = numbered.groupby([*by, "region"], as_index=False, dropna=False).agg(x1=("x1", "min"), y1=("y1", "min"), x2=("x2", "max"), y2=("y2", "max"), boxes=("detection_id", "size"))
            yield out[[*by, "region", *BOX, "boxes"]]

    kinds = dict(boxes.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "region long", *[f"{c} {kinds[c]}" for c in BOX], "boxes long"])
    return _sorted(boxes, by).mapInPandas(run, schema)


def overlaps(boxes: DataFrame, by: Sequence[str] = ("id_videofile", "frame_number")) -> DataFrame:
    """a, b, iou of the boxes of each frame that overlap; a < b. Compares all pairs of a frame: bound its boxes with ``top`` first."""
    left, right = boxes.select(*by, F.col("detection_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in BOX]), boxes.select(*by, F.col("detection_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    met = left.join(right, list(by)).where("a < b AND a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2")
    return met.select("a", "b", iou([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX]).alias("iou"))


def quality(detections: DataFrame, faces: DataFrame, undecidable: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ("id_videofile", "frame_number")) -> DataFrame:
    """threshold, detections, found, total, recall, false_positives, on_undecidable at each score threshold.

    A detection is true if its middle lies in a face region of its frame, undecidable if in an undecidable one only.
    """
    mid = detections.select(*by, "detection_id", "score", ((F.col("x1") + F.col("x2")) / 2.0).alias("_x"), ((F.col("y1") + F.col("y2")) / 2.0).alias("_y"))

    def hits(of: DataFrame, name: str) -> DataFrame:
        met = mid.join(of.select(*by, F.col("region").alias("_region"), *[F.col(c).alias(f"_{c}") for c in BOX]), list(by))
        return met.where("_x BETWEEN _x1 AND _x2 AND _y BETWEEN _y1 AND _y2").groupBy("detection_id").agg(F.collect_set(F.struct(*by, "_region")).alias(name))

    # thresholds only cut by score, so a region is found from the best score that hits it downwards
    each = mid.join(hits(faces, "_f"), "detection_id", "left").join(hits(undecidable, "_u").withColumn("_u", F.lit(True)), "detection_id", "left")
    cut = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("score") >= t)
    counted = each.select("_f", "_u", F.explode(cut).alias("threshold")).groupBy("threshold").agg(
        F.count("*").alias("detections"),
        F.count_if(F.col("_f").isNull() & F.col("_u").isNull()).alias("false_positives"),
        F.count_if(F.col("_f").isNull() & F.col("_u").isNotNull()).alias("on_undecidable"),
    )
    best = each.select(F.explode("_f").alias("_r"), "score").groupBy("_r").agg(F.max("score").alias("score"))
    found = best.select(F.explode(cut).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("found"))
    total = faces.agg(F.count("*").alias("total"))
    every = detections.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = every.join(counted, "threshold", "left").join(found, "threshold", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("threshold", zero("detections"), zero("found"), "total", zero("false_positives"), zero("on_undecidable")).withColumn("recall", F.when(F.col("total") > 0, F.round(F.col("found") / F.col("total"), 4)).otherwise(F.lit(0.0)))


def throughput(runs: DataFrame) -> DataFrame:
    """model, frames, fps, ms_per_frame from runs (model, frames, seconds)."""
    t = runs.groupBy("model").agg(F.sum("frames").alias("frames"), F.sum("seconds").alias("_s"))
    return t.select("model", "frames", (F.col("frames") / F.col("_s")).alias("fps"), (F.col("_s") * 1000 / F.col("frames")).alias("ms_per_frame"))
