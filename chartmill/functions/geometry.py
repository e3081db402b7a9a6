"""Column functions on the control polygon of a slider: its head and its anchors, all {x, y} structs."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "array<struct<x:int,y:int>>"


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot((ax - bx).cast("double"), (ay - by).cast("double"))


def polygon(x: str = "x", y: str = "y", anchors: str = "curve_points") -> Column:
    """Head and anchors as one array."""
    return F.concat(F.array(F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"))), F.col(anchors))


def legs(poly: Column) -> Column:
    """Lengths of the polygon's legs."""
    return F.zip_with(F.slice(poly, 1, F.size(poly) - 1), F.slice(poly, 2, F.size(poly)), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0.0), lambda s, v: s + v)


def chord(poly: Column) -> Column:
    first, last = F.element_at(poly, 1), F.element_at(poly, -1)
    return distance(first["x"], first["y"], last["x"], last["y"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sagitta(poly: Column) -> Column:
    """Largest distance of the polygon from its chord; from the head if there is no chord; 0 below three points."""

    def bow(p: Column) -> Column:
        first, last = F.element_at(p, 1), F.element_at(p, -1)
        leg = F.struct((last["x"] - first["x"]).alias("dx"), (last["y"] - first["y"]).alias("dy"), first["x"].alias("x"), first["y"].alias("y"))
        return let(leg, lambda v: let(F.hypot(v["dx"].cast("double"), v["dy"].cast("double")), lambda c: F.array_max(F.transform(p, lambda q: F.when(c < 1e-6, distance(q["x"], q["y"], v["x"], v["y"])).otherwise(F.abs((q["x"] - v["x"]) * v["dy"] - (q["y"] - v["y"]) * v["dx"]) / c)))))

    return let(poly, lambda p: F.when(F.size(p) < 3, 0.0).otherwise(bow(p)))


def anchor_min_gap(poly: Column) -> Column:
    """Least leg; infinite without anchors."""
    return let(poly, lambda p: F.when(F.size(p) < 2, F.lit(float("inf"))).otherwise(F.array_min(legs(p))))


def path_ratio(poly: Column) -> Column:
    """Path length over chord, 1 for a chord of at most a pixel."""
    return let(poly, lambda p: F.when(chord(p) <= 1, 1.0).otherwise(total(legs(p)) / chord(p)))


def has_red_points(poly: Column) -> Column:
    """Whether two neighbouring control points coincide."""
    return F.exists(F.zip_with(F.slice(poly, 1, F.size(poly) - 1), F.slice(poly, 2, F.size(poly)), lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])), lambda v: v)


def resampled(poly: Column, n: int) -> Column:
    """n + 1 points {px, py} at equal distances along the polygon, which has a leg at least.

    A point lies on the first leg whose end reaches its distance, else on the last.  The legs are measured once.
    """

    def point(p: Column, lengths: Column, ends: Column, target: Column) -> Column:
        def on(leg: Column) -> Column:
            length = F.get(lengths, leg)
            part = (target - (F.get(ends, leg) - length)) / F.when(length == 0, 1.0).otherwise(length)
            along = lambda c, s: (F.get(p, leg)[c] + s * (F.get(p, leg + 1)[c] - F.get(p, leg)[c])).alias(f"p{c}")
            return let(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part)), lambda s: F.struct(along("x", s), along("y", s)))

        return let(F.size(F.filter(F.slice(ends, 1, F.size(ends) - 1), lambda e: e < target)), on)

    def points(p: Column, lengths: Column, ends: Column) -> Column:
        whole = F.element_at(ends, -1)
        targets = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.when(whole == 0, 1.0).otherwise(whole) * k / n)
        return F.transform(targets, lambda target: point(p, lengths, ends, target))

    ends_of = lambda lengths: F.transform(F.sequence(F.lit(1), F.size(lengths)), lambda i: total(F.slice(lengths, 1, i)))
    return let(poly, lambda p: let(legs(p), lambda lengths: let(ends_of(lengths), lambda ends: points(p, lengths, ends))))


def circle_radius(cs: Column) -> Column:
    return 54.4 - 4.48 * cs


def simplify(poly: Column, limit: float = 18.0) -> Column:
    """Ramer-Douglas-Peucker on each polygon (array of {x, y}): points within limit px of a chord go.

    The recursion has no column form; polygons have tens of points, and come and go in Arrow batches.
    """

    def keep(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
        chosen, open_ = {0, len(points) - 1}, [(0, len(points) - 1)]
        while open_:
            i, j = open_.pop()
            (ax, ay), (bx, by) = points[i], points[j]
            dx, dy = bx - ax, by - ay
            norm = math.hypot(dx, dy) or 1.0
            far, at = max(((abs(dy * x - dx * y + bx * ay - by * ax) / norm, -k) for k, (x, y) in enumerate(points[i + 1 : j], i + 1)), default=(0.0, 0))
            if far > limit:
                chosen.add(-at)
                open_ += [(i, -at), (-at, j)]
        return [points[k] for k in sorted(chosen)]

    def batch(polygons: pd.Series) -> pd.Series:
        return polygons.map(lambda one: [{"x": x, "y": y} for x, y in keep([(p["x"], p["y"]) for p in one])] if one is not None and len(one) else [])

    # Called non-deterministic so that the optimizer leaves it where it is and runs it once a row.
    return F.pandas_udf(batch, POINTS).asNondeterministic()(poly)


#: Anchors that frames hold, their scales and limit, and when a slider is bent, how far, and angular.
ANCHORS, SPAN_X, SPAN_Y, OFFSET_LIMIT = 3, 512, 384, 1.2
BEND_PX, LEAST_BOW_PX, MOST_BOW_PX, BENT_RATIO = 6.0, 14.0, 130.0, 1.06
CORNER_CUE, CORNER_DEG = 0.25, 25.0


def within(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def anchor_offsets(poly: str, simple: str) -> Column:
    """The first ANCHORS simplified anchors as offsets from the head, x and y in turn, the last one repeated."""
    head = F.get(F.col(poly), F.lit(0))
    anchors = F.slice(simple, 2, F.size(simple))
    chosen = F.slice(F.concat(anchors, F.array_repeat(F.element_at(simple, -1), ANCHORS)), 1, ANCHORS)
    pair = lambda p: F.array(within((p["x"] - head["x"]) / F.lit(SPAN_X), -OFFSET_LIMIT, OFFSET_LIMIT), within((p["y"] - head["y"]) / F.lit(SPAN_Y), -OFFSET_LIMIT, OFFSET_LIMIT))
    return F.flatten(F.transform(chosen, pair))


def turn_degrees(a: Column, b: Column, c: Column) -> Column:
    """Turn at b on the way from a by b to c; 0 if a leg has no length."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
    size = F.hypot(ux.cast("double"), uy.cast("double")) * F.hypot(vx.cast("double"), vy.cast("double"))
    return F.when(size < 1e-6, 0.0).otherwise(F.degrees(F.acos(within((ux * vx + uy * vy) / size, -1.0, 1.0))))


def corners(poly: Column) -> Column:
    """The anchors of a polygon (head first), doubled where it turns sharply, or at the sharpest turn if none is sharp."""
    inner = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 2), lambda i: F.struct(turn_degrees(F.get(p, i - 1), F.get(p, i), F.get(p, i + 1)).alias("turn"), i.alias("i")))
    sharp = lambda turns: F.transform(F.when(F.exists(turns, lambda t: t["turn"] >= CORNER_DEG), F.filter(turns, lambda t: t["turn"] >= CORNER_DEG)).otherwise(F.array(F.array_max(turns))), lambda t: t["i"])
    doubled = lambda p: let(sharp(inner(p)), lambda at: F.flatten(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.array_repeat(F.get(p, i), F.when(F.array_contains(at, i), 2).otherwise(1)))))
    return let(poly, lambda p: F.when(F.size(p) < 3, F.slice(p, 2, F.size(p))).otherwise(doubled(p)))


def bow(poly: Column, px: Column) -> Column:
    """The anchors of a polygon (head first), the one farthest from the chord, or a new one at its middle, pushed until
    the bow is px, at most MOST_BOW_PX, within the playfield."""

    def pushed(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)), F.element_at(p, -1)
        size = F.hypot((b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double"))
        ux, uy = -(b["y"] - a["y"]) / size, (b["x"] - a["x"]) / size
        off = lambda q: (q["x"] - a["x"]) * ux + (q["y"] - a["y"]) * uy
        far = F.least(F.lit(MOST_BOW_PX), px)
        moved = lambda x, y, by: F.struct(within(x + ux * by, 0.0, SPAN_X).cast("int").alias("x"), within(y + uy * by, 0.0, SPAN_Y).cast("int").alias("y"))
        farthest = -F.array_max(F.transform(F.sequence(F.lit(1), F.size(p) - 2), lambda i: F.struct(F.abs(off(F.get(p, i))).alias("d"), (-i).alias("i"))))["i"]
        apex = F.transform(F.slice(p, 2, F.size(p)), lambda q, i: F.when(i + 1 == farthest, moved(q["x"], q["y"], F.when(off(q) >= 0, far).otherwise(-far) - off(q))).otherwise(q))
        middle = F.array(moved((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2, far), b)
        return F.when((size < 1e-6) | (px <= 0), F.slice(p, 2, F.size(p))).when(F.size(p) > 2, apex).otherwise(middle)

    return let(poly, pushed)


def slider_shape(rows: DataFrame, x: str, y: str, offsets: str, curve: str | None = None, corner: str | None = None) -> DataFrame:
    """rows with curve_type, curve_points and length of the slider from (x, y) with these mean anchor offsets.

    Anchors that fall together count once and the rest are simplified.  A corner cue makes a slider angular, a curve cue
    (the bow in px; without one, a path that is clearly longer than its chord) makes it bent, by LEAST_BOW_PX or more.
    """
    head = F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"))
    point = lambda i: F.struct(within(F.col(x) + F.get(offsets, 2 * i) * SPAN_X, 0.0, SPAN_X).cast("int").alias("x"), within(F.col(y) + F.get(offsets, 2 * i + 1) * SPAN_Y, 0.0, SPAN_Y).cast("int").alias("y"))
    all_ = F.concat(F.array(head), F.transform(F.sequence(F.lit(0), F.lit(ANCHORS - 1)), point))
    distinct = let(all_, lambda p: F.filter(p, lambda q, i: (i == 0) | (q != F.get(p, i - 1))))
    made = rows.withColumn("_raw", distinct).withColumn("_poly", simplify(F.col("_raw")))
    chord_, path = chord(F.col("_poly")), lambda p: total(legs(p))
    angular = F.lit(False) if corner is None else F.coalesce((F.col(corner) >= CORNER_CUE) & (F.size("_poly") >= 3), F.lit(False))
    bent = (F.size("_poly") >= 3) & (path(F.col("_poly")) > chord_ * BENT_RATIO) if curve is None else F.col(curve) >= BEND_PX
    target = F.lit(LEAST_BOW_PX) if curve is None else F.greatest(F.col(curve), F.lit(LEAST_BOW_PX))
    flat = F.slice("_poly", 2, F.size("_poly"))
    points = F.when(angular, corners(F.col("_poly"))).when(~bent, F.array(F.element_at("_poly", -1))).when(sagitta(F.col("_poly")) < target, bow(F.col("_poly"), target)).otherwise(flat)
    tiny = F.size("_raw") < 2
    side = F.array(F.struct(F.least(F.lit(SPAN_X), F.col(x) + 10).cast("int").alias("x"), F.col(y).cast("int").alias("y")))
    made = made.withColumns({"curve_type": F.when(~tiny & (angular | bent), "B").otherwise("L"), "curve_points": F.when(tiny, side).otherwise(points).cast(POINTS)})
    return made.withColumn("length", F.greatest(F.lit(10.0), F.when(tiny, 10.0).otherwise(path(F.concat(F.array(head), F.col("curve_points")))))).drop("_raw", "_poly")
