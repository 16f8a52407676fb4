"""Lines on a map: simplifying, joining rings, progress of stops along a shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_m


def keep_points(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line are needed for it to stay within tolerance (farthest-point splitting, without recursion)."""
    keep = np.zeros(len(xy), bool)
    if not len(xy):
        return keep
    keep[[0, -1]] = True
    todo = [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner, along = xy[a + 1 : b] - xy[a], xy[b] - xy[a]
        t = np.clip(inner @ along / max(float(along @ along), 1e-30), 0, 1)
        away = np.hypot(*(inner - t[:, None] * along).T)
        far = int(away.argmax())
        if away[far] > tolerance:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplify(lines: DataFrame, tolerance: float, *, digits: int = 5, column: str = "points") -> DataFrame:
    """lines with the array of (lat, lon) in column simplified and rounded. A null line stays null."""

    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def cut(values: pd.Series) -> pd.Series:
        def one(points):
            if points is None:
                return None
            xy = np.array([(p["lat"], p["lon"]) for p in points], float).reshape(-1, 2)
            return [{"lat": round(float(a), digits), "lon": round(float(b), digits)} for a, b in xy[keep_points(xy, tolerance)]]

        return values.map(one, na_action=None)

    return lines.withColumn(column, cut(F.col(column)))


def stitch(ways: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Ways that share end points joined to longer lines, rings where they close. One relation's ways at a time."""
    left = [list(w) for w in ways if len(w) > 1]
    out = []
    while left:
        line = left.pop(0)
        grown = True
        while grown and line[0] != line[-1]:
            grown = False
            for i, other in enumerate(left):
                if other[0] == line[-1]:
                    line += other[1:]
                elif other[-1] == line[-1]:
                    line += other[-2::-1]
                elif other[-1] == line[0]:
                    line = other[:-1] + line
                elif other[0] == line[0]:
                    line = other[:0:-1] + line
                else:
                    continue
                del left[i]
                grown = True
                break
        out.append(line)
    return out


def with_distance(shapes: DataFrame) -> DataFrame:
    """Points of shapes (shape_id, shape_pt_sequence, lat, lon) with the metres along the shape."""
    w = Window.partitionBy("shape_id").orderBy("shape_pt_sequence")
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon")
    return shapes.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("along_m", F.sum("_step").over(w)).drop("_step")


def stop_progress(stops: DataFrame, shapes: DataFrame) -> DataFrame:
    """Each stop (shape_id, stop_id, stop_lat, stop_lon) with the metres along its shape of the nearest point, and its share of the length."""
    points = with_distance(shapes)
    length = points.groupBy("shape_id").agg(F.max("along_m").alias("_length"))
    near = stops.join(points, "shape_id").withColumn("_d", haversine_m("stop_lat", "stop_lon", "lat", "lon"))
    best = near.groupBy("shape_id", "stop_id").agg(F.min(F.struct("_d", "along_m")).alias("_b"))
    return best.join(length, "shape_id").select("shape_id", "stop_id", F.col("_b.along_m").alias("along_m"), F.coalesce(F.try_divide("_b.along_m", "_length"), F.lit(0.0)).alias("progress"))
