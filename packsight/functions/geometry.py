"""Geometry of lines, words, crops and tiles; boxes are structs of x, y, w, h or corner points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .text import WHITE


def height_frac(bbox: Column, img_h: Column) -> Column:
    """Height of a quadrilateral (array of points) as a share of the image's; 0 without a height."""
    ys = F.transform(bbox, lambda p: p["y"])
    return F.coalesce(F.try_divide(F.array_max(ys) - F.array_min(ys), img_h), F.lit(0.0))


def top_frac(bbox: Column, img_h: Column) -> Column:
    return F.coalesce(F.try_divide(F.array_min(F.transform(bbox, lambda p: p["y"])), img_h), F.lit(0.0))


def line_words(text: Column, bbox: Column) -> Column:
    """Words of a line with boxes, the line's width being shared out evenly: array<word,x0,y0,x1,y1>."""
    words = F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")
    xs, ys = F.transform(bbox, lambda p: p["x"]), F.transform(bbox, lambda p: p["y"])
    x0, span = F.array_min(xs), (F.array_max(xs) - F.array_min(xs)) / F.size(words)
    return F.transform(
        words,
        lambda w, i: F.struct(w.alias("word"), (x0 + i * span).cast("int").alias("x0"), F.array_min(ys).alias("y0"), (x0 + (i + 1) * span).cast("int").alias("x1"), F.array_max(ys).alias("y1")),
    )


def normalise(value: Column, size: Column) -> Column:
    """A coordinate in thousandths of the image, cut off at 0 and 1000."""
    return F.least(F.lit(1000), F.greatest(F.lit(0), F.coalesce(F.try_divide(1000 * value, size), F.lit(0)).cast("int")))


def resolution_scale(h: Column, w: Column, low: int = 900, high: int = 2200) -> Column:
    """The factor that brings a short side up to `low`, else a long side down to `high`; 1 near it."""
    short, long = F.least(h, w), F.greatest(h, w)
    scale = F.when(short < low, low / short).when(long > high, high / long).otherwise(1.0)
    return F.when(F.abs(scale - 1.0) < 0.01, 1.0).otherwise(scale)


def tiles(h: Column, w: Column, grid: int = 2, overlap: float = 0.15) -> Column:
    """The whole image and grid x grid overlapping tiles: array<struct<x0,y0,x1,y1>>."""
    th, tw = F.floor(h / grid), F.floor(w / grid)
    oh, ow = (F.floor(t * overlap) for t in (th, tw))
    whole = F.struct(F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), w.cast("long").alias("x1"), h.cast("long").alias("y1"))
    zero = F.lit(0).cast("long")
    cells = [
        F.struct(F.greatest(zero, j * tw - ow).alias("x0"), F.greatest(zero, i * th - oh).alias("y0"), F.least(w.cast("long"), (j + 1) * tw + ow).alias("x1"), F.least(h.cast("long"), (i + 1) * th + oh).alias("y1"))
        for i in range(grid)
        for j in range(grid)
    ]
    return F.array(whole, *cells)


BOXES = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "w", "h")]))


def merged_boxes(boxes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Boxes folded together until none strictly overlap, left to right.

    Overlap is transitive through the growing hull; a hull may come to overlap a box that none of
    its parts touched.
    """
    done: list[tuple[int, int, int, int]] = []
    for x, y, w, h in sorted(boxes):
        x2, y2 = x + w, y + h
        while True:
            hit = next((b for b in done if x < b[2] and b[0] < x2 and y < b[3] and b[1] < y2), None)
            if hit is None:
                break
            done.remove(hit)
            x, y, x2, y2 = min(x, hit[0]), min(y, hit[1]), max(x2, hit[2]), max(y2, hit[3])
        done.append((x, y, x2, y2))
    return sorted((x, y, x2 - x, y2 - y) for x, y, x2, y2 in done)


def merge_boxes(boxes: Column | str) -> Column:
    """merged_boxes of a column of boxes, in Arrow batches; null where there are no boxes to read."""
    ship(SparkSession.active())

    def run(rows: pd.Series) -> pd.Series:
        folded = [None if boxes is None else merged_boxes([(b["x"], b["y"], b["w"], b["h"]) for b in boxes]) for boxes in rows]
        return pd.Series([None if boxes is None else [dict(zip("xywh", b)) for b in boxes] for boxes in folded])

    return F.pandas_udf(run, BOXES)(boxes)
