"""Polygon expressions over ``ARRAY<ARRAY<STRUCT<x,y>>>``.

A polygon is a list of closed rings, the first one the shell and the rest
holes. Coordinates are metres in one projected system.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

POLYGON = "array<array<struct<x:double,y:double>>>"


def point(x, y) -> Column:
    x = F.lit(x) if not isinstance(x, Column) else x
    y = F.lit(y) if not isinstance(y, Column) else y
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0, y0, x1, y1) -> Column:
    """Rectangle polygon with corners (x0, y0) and (x1, y1)."""
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _edges(ring: Column) -> Column:
    """Indexes of a ring's edges; empty for a ring with no edge."""
    n = F.size(ring)
    return F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))


def _ring_moments(ring: Column) -> Column:
    """Struct (a, mx, my): signed area and first moments relative to the first vertex."""
    o = F.get(ring, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        px, py, qx, qy = p["x"] - o["x"], p["y"] - o["y"], q["x"] - o["x"], q["y"] - o["y"]
        cross = px * qy - qx * py
        return F.struct(
            (acc["a"] + cross / 2.0).alias("a"),
            (acc["mx"] + (px + qx) * cross / 6.0).alias("mx"),
            (acc["my"] + (py + qy) * cross / 6.0).alias("my"),
        )

    return F.aggregate(_edges(ring), zero, step)


def area(rings: Column) -> Column:
    """Shell area minus hole areas, whatever the ring direction."""
    areas = F.transform(rings, lambda r: F.abs(_ring_moments(r)["a"]))
    return let(areas, lambda v: 2.0 * F.coalesce(F.get(v, F.lit(0)), F.lit(0.0)) - F.aggregate(
        v, F.lit(0.0), lambda s, a: s + a))


def perimeter(rings: Column) -> Column:
    def ring_length(r: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            p, q = F.get(r, i), F.get(r, i + 1)
            return acc + F.hypot(q["x"] - p["x"], q["y"] - p["y"])

        return F.aggregate(_edges(r), F.lit(0.0), step)

    return F.aggregate(F.transform(rings, ring_length), F.lit(0.0), lambda s, v: s + v)


def compactness(rings: Column) -> Column:
    """4 pi A / P^2: 1 for a circle, lower for long or ragged shapes."""
    return let(perimeter(rings), lambda p: F.when(
        p > 0, F.lit(4 * math.pi) * area(rings) / (p * p)).otherwise(F.lit(0.0)))


def centroid(rings: Column) -> Column:
    """Area centroid of shell minus holes as struct (x, y)."""
    shell_o = F.get(F.get(rings, F.lit(0)), F.lit(0))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def weighted(r: Column, k: Column) -> Column:
        o = F.get(r, F.lit(0))

        def shifted(m: Column) -> Column:
            sign = F.signum(m["a"]) * F.when(k == 0, 1.0).otherwise(-1.0)
            return F.struct(
                (sign * m["a"]).alias("a"),
                (sign * (m["mx"] + m["a"] * (o["x"] - shell_o["x"]))).alias("mx"),
                (sign * (m["my"] + m["a"] * (o["y"] - shell_o["y"]))).alias("my"),
            )

        return let(_ring_moments(r), shifted)

    return F.aggregate(
        F.transform(rings, weighted),
        zero,
        lambda s, m: F.struct(
            (s["a"] + m["a"]).alias("a"), (s["mx"] + m["mx"]).alias("mx"), (s["my"] + m["my"]).alias("my")
        ),
        lambda s: F.struct(
            (shell_o["x"] + F.coalesce(F.try_divide(s["mx"], s["a"]), F.lit(0.0))).alias("x"),
            (shell_o["y"] + F.coalesce(F.try_divide(s["my"], s["a"]), F.lit(0.0))).alias("y"),
        ),
    )


def contains(rings: Column, px: Column, py: Column) -> Column:
    """Even-odd test over all rings, so holes are outside."""

    def crossings(r: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            a, b = F.get(r, i), F.get(r, i + 1)
            spans = (a["y"] > py) != (b["y"] > py)
            turn = (b["x"] - a["x"]) * (py - a["y"]) - (px - a["x"]) * (b["y"] - a["y"])
            right = (turn > 0) == (b["y"] > a["y"])
            return acc + F.when(spans & right, 1).otherwise(0)

        return F.aggregate(_edges(r), F.lit(0), step)

    total = F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, c: s + c)
    return total % 2 == 1


def bounds(rings: Column) -> Column:
    """Struct (x0, y0, x1, y1) of the shell."""
    shell = F.get(rings, F.lit(0))
    xs, ys = F.transform(shell, lambda p: p["x"]), F.transform(shell, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
        F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
    )


def inner_point(rings: Column) -> Column:
    """A point inside the polygon: the centroid, else the middle of the widest
    run of the horizontal line through the middle of the bounding box."""
    def widest(y: Column) -> Column:
        def cut(r: Column) -> Column:
            def at(i: Column) -> Column:
                p, q = F.get(r, i), F.get(r, i + 1)
                crosses = (p["y"] > y) != (q["y"] > y)
                return F.when(crosses, p["x"] + F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]))

            return F.transform(_edges(r), at)

        def runs(xs: Column) -> Column:
            pairs = F.transform(
                F.sequence(F.lit(0), F.floor(F.size(xs) / 2).cast("int") - 1),
                lambda k: F.struct(
                    (F.get(xs, 2 * k + 1) - F.get(xs, 2 * k)).alias("w"),
                    ((F.get(xs, 2 * k + 1) + F.get(xs, 2 * k)) / 2.0).alias("x")))
            return F.when(F.size(xs) >= 2, F.array_max(pairs))

        xs = F.array_sort(F.array_compact(F.flatten(F.transform(rings, cut))))
        return let(xs, runs)

    def choose(c: Column) -> Column:
        def scan(y: Column) -> Column:
            return let(widest(y), lambda best: F.when(best.isNull(), c).otherwise(
                F.struct(best["x"].alias("x"), y.alias("y"))))

        middle = let(bounds(rings), lambda b: (b["y0"] + b["y1"]) / 2.0)
        return F.when(contains(rings, c["x"], c["y"]), c).otherwise(let(middle, scan))

    return let(centroid(rings), choose)


def boundary_segments(df: DataFrame, keep: list[str], rings: str = "rings") -> DataFrame:
    """One row per polygon edge: ``keep`` columns plus x1, y1, x2, y2."""
    def ring_edges(r: Column) -> Column:
        return F.transform(_edges(r), lambda i: F.struct(
            F.get(r, i)["x"].alias("x1"), F.get(r, i)["y"].alias("y1"),
            F.get(r, i + 1)["x"].alias("x2"), F.get(r, i + 1)["y"].alias("y2")))

    return df.select(*keep, F.inline(F.flatten(F.transform(F.col(rings), ring_edges))))


def segment_distance2(a: str, b: str) -> Column:
    """Squared distance of segments in columns {a}x1.. and {b}x1.. ."""
    def v(side: str, name: str) -> Column:
        return F.col(side + name)

    def to_segment(p: str, k: str, s: str) -> Column:
        px, py = v(p, "x" + k), v(p, "y" + k)
        dx, dy = v(s, "x2") - v(s, "x1"), v(s, "y2") - v(s, "y1")
        ex, ey = px - v(s, "x1"), py - v(s, "y1")
        u = F.least(F.greatest((ex * dx + ey * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300)),
                               F.lit(0.0)), F.lit(1.0))
        rx, ry = ex - u * dx, ey - u * dy
        return rx * rx + ry * ry

    def side_of(p: str, k: str, s: str) -> Column:
        return (v(s, "x2") - v(s, "x1")) * (v(p, "y" + k) - v(s, "y1")) - (
            v(s, "y2") - v(s, "y1")) * (v(p, "x" + k) - v(s, "x1"))

    crossing = (side_of(a, "1", b) * side_of(a, "2", b) < 0) & (side_of(b, "1", a) * side_of(b, "2", a) < 0)
    return F.when(crossing, F.lit(0.0)).otherwise(
        F.least(to_segment(a, "1", b), to_segment(a, "2", b), to_segment(b, "1", a), to_segment(b, "2", a))
    )
