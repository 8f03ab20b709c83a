"""Boxes, shot sizes and preview sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timebase import div

# Fixed values.
SIZES = ("ECU", "BCU", "CU", "MCU", "MS", "MLS", "LS", "VLS", "XLS")
SIZE_THRESHOLDS = (0.35, 0.22, 0.13, 0.075, 0.04, 0.02, 0.009, 0.003)
CROP_MARGIN = 1.66


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1).cast("double") * (y2 - y1).cast("double")


def aspect(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Longer side by shorter side; null for an empty box."""
    w, h = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    return F.when((w > 0) & (h > 0), F.greatest(w, h) / F.least(w, h))


def in_frame(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    return (x1 >= 0) & (y1 >= 0) & (x1 < x2) & (y1 < y2) & (x2 <= width) & (y2 <= height)


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where they are apart."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = w.cast("double") * h
    union = area(*a) + area(*b) - inter
    return F.when((w > 0) & (h > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def size_of_share(share: Column, thresholds: Sequence[float] = SIZE_THRESHOLDS) -> Column:
    """Shot size from the largest face's share of the frame; NONE without a face. Thresholds fall strictly."""
    if any(a <= b for a, b in zip(thresholds, thresholds[1:], strict=False)):
        raise ValueError(f"thresholds must fall: {thresholds}")
    out = F.lit(SIZES[min(len(thresholds), len(SIZES) - 1)])
    for i in reversed(range(len(thresholds))):
        out = F.when(share >= thresholds[i], F.lit(SIZES[min(i, len(SIZES) - 1)])).otherwise(out)
    return F.when(share.isNull(), F.lit("NONE")).otherwise(out)


def crop(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float = CROP_MARGIN) -> Column:
    """struct<x, y, width, height>: the box made ``margin`` times as large around its middle, kept inside the frame."""
    zero = F.lit(0)

    def side(low: Column, high: Column, room: Column):
        size = F.greatest(F.lit(1), ((high - low) * margin).cast("int"))
        start = low - div((size - (high - low)).cast("long"), F.lit(2).cast("long")).cast("int")
        start = F.least(F.greatest(start, zero), F.greatest(room - size, zero))
        clipped = F.least(size, room)
        return F.least(start, room - clipped), clipped

    (x, w), (y, h) = side(x1, x2, width), side(y1, y2, height)
    return F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def sheet_count(frames: Column, columns: int = 16, rows: int = 16) -> Column:
    return F.ceil(frames / (columns * rows)).cast("int")


def sheet_place(frame: Column, columns: int = 16, rows: int = 16, cell_width: int = 135, cell_height: int = 75) -> Column:
    """struct<sheet, row, col, x, y>: where the preview sheets show a frame."""
    long = frame.cast("long")
    each = columns * rows
    at = long % each
    row, col = div(at, F.lit(columns).cast("long")).cast("int"), (at % columns).cast("int")
    return F.struct(div(long, F.lit(each).cast("long")).cast("int").alias("sheet"), row.alias("row"), col.alias("col"), (col * cell_width).alias("x"), (row * cell_height).alias("y"))


def sheet_key(videofile: Column, sheet: Column) -> Column:
    return F.format_string("videofile/%d/preview-sheets/v1/%06d", videofile, sheet)
