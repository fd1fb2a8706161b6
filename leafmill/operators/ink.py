"""Ink: strokes of points to bounds, paths and pictures."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: HIMETRIC units to a pixel of 1/96 inch; what pictures may have at most: pixels in all and on a side; their scale.
UNITS, MOST_PIXELS, MOST_SIDE, SCALE = 2540.0 / 96.0, 24_000_000, 12_000, 2


def bounds(points: DataFrame, ink: str, width: Column) -> DataFrame:
    """(ink, x0, y0, x1, y1, width_px, height_px): the box of all points, wider by half the pen; at least one pixel."""
    pad = width / 2.0
    box = points.groupBy(ink).agg(F.min(F.col("x") - pad).alias("x0"), F.min(F.col("y") - pad).alias("y0"), F.max(F.col("x") + pad).alias("x1"), F.max(F.col("y") + pad).alias("y1"))
    side = lambda a, b: F.greatest(F.lit(1.0), (F.col(b) - F.col(a)) / UNITS)
    return box.withColumn("width_px", side("x0", "x1")).withColumn("height_px", side("y0", "y1"))


def fixed2(x: Column) -> Column:
    """Two decimals at most, without trailing zeros.  Rounds the exact binary value half to even, as C's printf does and
    ``format_string`` does not.  The product with 200 is had without error from two halves of the number's bits, and told
    from the odd number between both neighbours by its sign."""
    low = F.floor(x * 100.0)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    rest = (high * 200.0 - (low * 2 + 1)) + (x - high) * 200.0
    up = F.when(rest > 0, 1).when(rest < 0, 0).otherwise(F.pmod(low, F.lit(2)))
    whole = low + up
    sign, size = F.when(whole < 0, F.lit("-")).otherwise(F.lit("")), F.abs(whole)
    digits = F.concat(F.floor(size / 100).cast("string"), F.lit("."), F.lpad(F.pmod(size, F.lit(100)).cast("string"), 2, "0"))
    return F.concat(sign, F.regexp_replace(digits, r"\.?0+\z", ""))


def svg_paths(points: DataFrame, boxes: DataFrame, ink: str, order: str) -> DataFrame:
    """(ink, path): the path data of one stroke, from the box's corner, in pixels."""
    placed = points.join(boxes.select(ink, "x0", "y0"), ink)
    step = F.concat(fixed2((F.col("x") - F.col("x0")) / UNITS), F.lit(" "), fixed2((F.col("y") - F.col("y0")) / UNITS))
    steps = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), step.alias("s")))), lambda p: p["s"])
    path = F.concat(F.lit("M"), F.array_join(F.col("steps"), "L"), F.when(F.size("steps") == 1, F.lit("l0 0")).otherwise(F.lit("")))
    return placed.groupBy(ink).agg(steps.alias("steps")).select(ink, path.alias("path"))


def drawing(points: np.ndarray, width: float, color: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """RGB picture on white of one stroke, at double scale, within the limits of size."""
    low, high = points.min(0) - width / 2, points.max(0) + width / 2
    scale = SCALE / UNITS
    size = np.maximum(1, (high - low) * scale)
    scale *= min(1.0, MOST_SIDE / size.max(), float(np.sqrt(MOST_PIXELS / size.prod())))
    w, h = np.maximum(1, np.ceil((high - low) * scale)).astype(int)
    p, r = (points - low) * scale, max(0.5, width * scale / 2)
    ink = np.zeros((h, w), bool)
    for a, b in zip(p, p[1:] if len(p) > 1 else p, strict=False):
        x0, y0 = np.maximum(0, np.floor(np.minimum(a, b) - r)).astype(int)
        x1, y1 = np.ceil(np.maximum(a, b) + r).astype(int) + 1
        y, x = np.mgrid[y0 : min(h, y1), x0 : min(w, x1)] + 0.5
        d = b - a
        t = np.clip(((x - a[0]) * d[0] + (y - a[1]) * d[1]) / max(float(d @ d), 1e-12), 0, 1)
        ink[y0 : min(h, y1), x0 : min(w, x1)] |= (x - a[0] - t * d[0]) ** 2 + (y - a[1] - t * d[1]) ** 2 <= r * r
    out = np.full((h, w, 3), 255, np.uint8)
    out[ink] = color
    return out


def png(picture: np.ndarray) -> bytes:
    h, w, _ = picture.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), picture.reshape(h, -1)], 1).tobytes()
    per_metre = round(SCALE * 96 / 0.0254)
    head = part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1))
    return b"\x89PNG\r\n\x1a\n" + head + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def pictures(strokes: DataFrame, ink: str, points: str, width: float) -> DataFrame:
    """(ink, png) of rows with an array of struct<x, y>; rows are drawn where they are, without a shuffle."""
    kind = strokes.schema[ink].dataType.simpleString()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            shots = [png(drawing(np.array([[p["x"], p["y"]] for p in of], float), width)) for of in rows[points]]
            yield pd.DataFrame({ink: rows[ink], "png": shots})

    return strokes.filter(F.size(points) > 0).select(ink, points).mapInPandas(draw, f"{ink} {kind}, png binary")
