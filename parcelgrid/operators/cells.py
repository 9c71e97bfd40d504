"""Spatial joins through grid cells: equi joins on cells, exact test as residual."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.functions import shapes
from parcelgrid.operators.keyed import first_per_key, salted_join
from parcelgrid.session import durable


def cell_of(v: Column, size) -> Column:
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    return F.floor(v / size).cast("long")


def _span(lo: Column, hi: Column, size) -> Column:
    return F.sequence(cell_of(lo, size), cell_of(hi, size))


def point_in_polygon(points: DataFrame, polygons: DataFrame, *, point_id: str,
                     base_m: float = 64.0) -> DataFrame:
    """Inner join of points (x, y) with the polygons (rings) that contain them.

    Polygons go to the grid level whose cell is at least as large as their
    box, so each lies in at most four cells however large it is. Points look
    up their own cell on every level in use (at most a few dozen).
    """
    b = shapes.bounds(F.col("rings"))
    leveled = polygons.withColumn("_b", b).withColumn(
        "_lvl",
        F.greatest(F.ceil(F.log2(F.greatest(
            F.col("_b.x1") - F.col("_b.x0"), F.col("_b.y1") - F.col("_b.y0"), F.lit(1e-9)) / base_m)),
            F.lit(0)).cast("int"),
    )
    levels = sorted(r[0] for r in leveled.select("_lvl").distinct().collect() if r[0] is not None)
    size = F.lit(base_m) * F.pow(F.lit(2.0), F.col("_lvl"))
    areas = (
        leveled.withColumn("_cx", F.explode(_span(F.col("_b.x0"), F.col("_b.x1"), size)))
        .withColumn("_cy", F.explode(_span(F.col("_b.y0"), F.col("_b.y1"), size)))
    )
    looked = points.withColumn("_lvl", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    looked = looked.withColumns({"_cx": cell_of(F.col("x"), size), "_cy": cell_of(F.col("y"), size)})
    inside = (
        F.col("x").between(F.col("_b.x0"), F.col("_b.x1"))
        & F.col("y").between(F.col("_b.y0"), F.col("_b.y1"))
        & shapes.contains(F.col("rings"), F.col("x"), F.col("y"))
    )
    pairs = salted_join(looked, areas, ["_lvl", "_cx", "_cy"], [point_id], heavy=True)
    return pairs.where(inside).drop("_lvl", "_cx", "_cy", "_b", "rings")


def radius_join(left: DataFrame, right: DataFrame, radius_m: float, *, left_id: str,
                right_x: str = "rx", right_y: str = "ry", strict: bool = False,
                on: list[str] | None = None) -> DataFrame:
    """Pairs of left points (x, y) and right points within ``radius_m``.

    Right rows are copied to the nine cells around them; ``dist2`` is the
    squared distance. The bound is inclusive unless ``strict``.
    """
    keys = [*(on or []), "_cx", "_cy"]
    lhs = left.withColumns({"_cx": cell_of(F.col("x"), radius_m), "_cy": cell_of(F.col("y"), radius_m)})
    near = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    rhs = (
        right.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
        .withColumns({"_cx": cell_of(F.col(right_x), radius_m) + F.col("_dx"),
                      "_cy": cell_of(F.col(right_y), radius_m) + F.col("_dy")})
        .drop("_dx", "_dy")
    )
    d2 = F.pow(F.col("x") - F.col(right_x), 2) + F.pow(F.col("y") - F.col(right_y), 2)
    r2 = F.lit(float(radius_m) ** 2)
    pairs = salted_join(lhs, rhs, keys, [left_id], heavy=True).withColumn("dist2", d2)
    return pairs.where(F.col("dist2") < r2 if strict else F.col("dist2") <= r2).drop("_cx", "_cy")


def nearest_site(points: DataFrame, sites: DataFrame, *, point_id: list[str], on: list[str] | None = None,
                 payload: list[str] | None = None, base_m: float = 250.0) -> DataFrame:
    """Exact nearest site (sx, sy) of each point (x, y); ``dist`` and the site's payload.

    Grid levels grow by four, up to a cell as wide as points and sites reach
    together. The level at which the 3 x 3 cells around a point first hold a
    site bounds the distance by 2.83 cells, so the 3 x 3 cells one level up
    must hold the nearest one. Both steps are equi joins; points without any
    site under ``on`` are dropped.
    """
    on, payload = on or [], payload or []
    reached = points.select("x", "y").union(sites.select("sx", "sy")).agg(
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("m")).first()["m"]
    top = max(1, math.ceil(math.log(max(reached or 0.0, base_m) / base_m, 4)))
    levels = F.array(*[F.lit(v) for v in range(top + 1)])
    size = F.lit(base_m) * F.pow(F.lit(4.0), F.col("_lvl"))
    near = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    spread = (
        sites.dropDuplicates([*on, "sx", "sy", *payload])
        .withColumn("_lvl", F.explode(levels))
        .withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
        .withColumns({"_cx": cell_of(F.col("sx"), size) + F.col("_dx"),
                      "_cy": cell_of(F.col("sy"), size) + F.col("_dy")})
        .drop("_dx", "_dy")
    )
    keys = [*on, "_lvl", "_cx", "_cy"]
    occupied = spread.select(*keys).distinct()
    fine = points.withColumns({"_fx": cell_of(F.col("x"), base_m), "_fy": cell_of(F.col("y"), base_m)})
    up = F.pow(F.lit(4.0), F.col("_lvl"))
    ladder = (
        fine.select(*on, "_fx", "_fy").distinct().withColumn("_lvl", F.explode(levels))
        .withColumns({"_cx": F.floor(F.col("_fx") / up).cast("long"),
                      "_cy": F.floor(F.col("_fy") / up).cast("long")})
    )
    reach = durable(
        ladder.join(occupied, keys, "left_semi")
        .groupBy(*on, "_fx", "_fy").agg(F.min("_lvl").alias("_found"))
        .withColumn("_lvl", F.least(F.col("_found") + 1, F.lit(top)))
        .drop("_found")
    )
    up2 = F.pow(F.lit(4.0), F.col("_lvl"))
    aimed = fine.join(reach, [*on, "_fx", "_fy"]).withColumns(
        {"_cx": F.floor(F.col("_fx") / up2).cast("long"), "_cy": F.floor(F.col("_fy") / up2).cast("long")}
    ).drop("_fx", "_fy")
    d2 = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2)
    pairs = salted_join(aimed, spread, keys, point_id).withColumn("_d2", d2)
    best = first_per_key(
        pairs.select(*point_id, "_d2", *payload), point_id,
        [F.col("_d2"), *[F.col(c) for c in payload]])
    return best.withColumn("dist", F.sqrt("_d2")).drop("_d2")


def _segment_cells(parcels: DataFrame, keep: list[str], cell_m: float, grow_m: float) -> DataFrame:
    """Boundary segments of polygons, one row per grid cell a piece of it reaches."""
    seg = shapes.boundary_segments(parcels, keep)
    n = F.greatest(F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / cell_m), F.lit(1))
    piece = seg.withColumn("_n", n.cast("int")).withColumn(
        "_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a: str, b: str, k: Column) -> Column:
        return F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")

    def span(a: str, b: str) -> Column:
        p, q = at(a, b, F.col("_k")), at(a, b, F.col("_k") + 1)
        return _span(F.least(p, q) - grow_m, F.greatest(p, q) + grow_m, cell_m)

    return (
        piece.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))
        .drop("_n", "_k")
    )


def close_pairs(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, within_m: float,
                on: list[str] | None = None, ordered: bool = False, cell_m: float = 32.0) -> DataFrame:
    """Distinct id pairs whose boundaries come within ``within_m`` of each other.

    Works on boundary segments, so a parcel of any length is spread over the
    cells it runs through instead of over its whole box.
    """
    on = on or []
    a = _segment_cells(left, [left_id, *on], cell_m, within_m)
    b = _segment_cells(right, [right_id, *on], cell_m, 1e-6)
    pts = ("x1", "y1", "x2", "y2")
    a = a.select(*on, "_cx", "_cy", left_id, *[F.col(c).alias(f"a_{c}") for c in pts])
    b = b.select(*on, "_cx", "_cy", right_id, *[F.col(c).alias(f"b_{c}") for c in pts])
    pairs = salted_join(a, b, [*on, "_cx", "_cy"], [left_id, "a_x1", "a_y1"], rows_per_task=50_000, heavy=True)
    pairs = pairs.where(F.col(left_id) < F.col(right_id) if ordered else F.col(left_id) != F.col(right_id))
    boxes = F.lit(True)
    for c in ("x", "y"):
        p, q = (F.col(f"a_{c}1"), F.col(f"a_{c}2")), (F.col(f"b_{c}1"), F.col(f"b_{c}2"))
        boxes = boxes & (F.least(*p) - within_m <= F.greatest(*q)) & (F.greatest(*p) + within_m >= F.least(*q))
    return pairs.where(boxes).where(
        shapes.segment_distance2("a_", "b_") <= F.lit(float(within_m) ** 2)
    ).select(left_id, right_id).distinct()


def polygon_overlap(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str,
                    cell_m: float = 256.0) -> DataFrame:
    """Distinct id pairs of polygons that intersect: boundaries meet, or one lies inside the other."""
    edges = close_pairs(left, right, left_id=left_id, right_id=right_id, within_m=1e-6, cell_m=cell_m)

    def corner(df: DataFrame, key: str) -> DataFrame:
        first = F.get(F.get(F.col("rings"), F.lit(0)), F.lit(0))
        return df.select(key, first["x"].alias("x"), first["y"].alias("y"))

    l_in_r = point_in_polygon(corner(left, left_id), right.select(right_id, "rings"), point_id=left_id)
    r_in_l = point_in_polygon(corner(right, right_id), left.select(left_id, "rings"), point_id=right_id)
    cols = [left_id, right_id]
    return edges.union(l_in_r.select(*cols)).union(r_in_l.select(*cols)).distinct()


def square_grid(points: DataFrame, size_m: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Grid squares that hold at least one point, as polygons with their cell number."""
    ox, oy = F.lit(float(origin[0])), F.lit(float(origin[1]))
    cells = points.select(
        cell_of(F.col("x") - ox, size_m).alias("gx"), cell_of(F.col("y") - oy, size_m).alias("gy")).distinct()
    x, y = ox + F.col("gx") * F.lit(float(size_m)), oy + F.col("gy") * F.lit(float(size_m))
    return cells.select(
        F.concat_ws("_", "gx", "gy").alias("gid"), "gx", "gy",
        shapes.box(x, y, x + size_m, y + size_m).alias("rings"),
    )
