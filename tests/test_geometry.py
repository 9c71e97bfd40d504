import math
import random

from pyspark.sql import functions as F

from parcelgrid.functions import project, shapes
from parcelgrid.operators import cells, graph as G

SCHEMA = f"id string, rings {shapes.POLYGON}"


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in (*pts, pts[0])]


def rect(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def inside(rings, x, y):
    hit = False
    for r in rings:
        for a, b in zip(r, r[1:]):
            if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                hit = not hit
    return hit


def test_shape_figures(spark):
    df = spark.createDataFrame([("sq", [rect(0, 0, 1, 1)]), ("bar", [rect(0, 0, 10, .1)]),
                                ("hole", [rect(0, 0, 10, 10), rect(4, 4, 8, 8)])], SCHEMA)
    out = {r["id"]: r for r in df.select("id", shapes.area(F.col("rings")).alias("a"), shapes.compactness(F.col("rings")).alias("c"),
                                          shapes.centroid(F.col("rings")).alias("m")).collect()}
    assert abs(out["sq"]["c"] - math.pi / 4) < 1e-9 and out["bar"]["c"] < 0.2
    assert abs(out["hole"]["a"] - 84) < 1e-9
    assert abs(out["hole"]["m"]["x"] - (100 * 5 - 16 * 6) / 84) < 1e-9


def stars(rng, n, size):
    """Star-shaped polygons, some with a hole."""
    out = []
    for i in range(n):
        cx, cy, rad = rng.uniform(0, size), rng.uniform(0, size), rng.choice([5, 20, 300])
        pts = [(cx + rad * rng.uniform(.4, 1) * math.cos(k * .7), cy + rad * rng.uniform(.4, 1) * math.sin(k * .7)) for k in range(9)]
        rings = [ring(*pts)]
        if i % 3 == 0:
            rings.append(rect(cx - rad * .1, cy - rad * .1, cx + rad * .1, cy + rad * .1))
        out.append((f"p{i}", rings))
    return out


def test_point_in_polygon_matches_brute_force(spark):
    rng = random.Random(3)
    polys = stars(rng, 40, 1000)
    pts = [(f"q{i}", rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(300)]
    got = cells.point_in_polygon(spark.createDataFrame(pts, "pt string, x double, y double"),
                                 spark.createDataFrame(polys, SCHEMA), point_id="pt")
    assert {(r["pt"], r["id"]) for r in got.collect()} == {(q, p) for q, x, y in pts for p, rings in polys if inside(rings, x, y)}


def test_radius_and_nearest_match_brute_force(spark):
    rng = random.Random(5)
    pts = [(f"a{i}", rng.uniform(0, 5000), rng.uniform(0, 5000)) for i in range(150)]
    sites = [(f"s{i}", rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(30)] + [("far", 90000.0, 90000.0)]
    left = spark.createDataFrame(pts, "a string, x double, y double")
    right = spark.createDataFrame(sites, "s string, rx double, ry double")
    got = {(r["a"], r["s"]) for r in cells.radius_join(left, right, 700.0, left_id="a").collect()}
    assert got == {(a, s) for a, x, y in pts for s, u, v in sites if math.hypot(x - u, y - v) <= 700}
    near = cells.nearest_site(left, right.select("s", F.col("rx").alias("sx"), F.col("ry").alias("sy")), point_id=["a"], payload=["s"])
    want = {a: min((math.hypot(x - u, y - v), s) for s, u, v in sites) for a, x, y in pts}
    rows = near.collect()
    assert len(rows) == len(pts)
    assert all(abs(r["dist"] - want[r["a"]][0]) < 1e-6 and r["s"] == want[r["a"]][1] for r in rows)


def test_hot_cell_is_split_without_changing_the_result(spark):
    from parcelgrid.operators.keyed import salted_join

    left = spark.range(5000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(20).select((F.col("id") % 4).alias("k"), F.col("id").alias("b"))
    plain = left.join(right, "k").groupBy().agg(F.count("*"), F.sum("a"), F.sum("b")).first()
    for heavy in (False, True):
        cut = salted_join(left, right, ["k"], ["a"], rows_per_task=100, heavy=heavy)
        assert tuple(cut.groupBy().agg(F.count("*"), F.sum("a"), F.sum("b")).first()) == tuple(plain)


def test_adjacency(spark):
    boxes = [("A", "1", "대", [rect(0, 0, 1, 1)]), ("B", "1", "대", [rect(1, 0, 2, 1)]), ("C", "1", "대", [rect(5, 5, 6, 6)]),
             ("D", "2", "대", [rect(0, 1, 1, 2)]), ("L", "1", "대", [rect(3, -500, 3.5, 900)])]
    df = spark.createDataFrame(boxes, f"pnu string, sigungu string, jimok string, rings {shapes.POLYGON}")
    strict = {tuple(r) for r in G.adjacency(df, buffer_m=0.0).collect()}
    assert strict == {("A", "B"), ("B", "A")}
    wide = {tuple(r) for r in G.adjacency(df, buffer_m=2.0).collect()}
    # A ends at x = 1 and L starts at x = 3: exactly the buffer, which is inclusive.
    linked = {("A", "B"), ("A", "L"), ("B", "L"), ("C", "L")}
    assert wide == linked | {(b, a) for a, b in linked}
    nested = spark.createDataFrame([("O", "1", "대", [rect(0, 0, 90, 90)]), ("I", "1", "대", [rect(40, 40, 50, 50)])], df.schema)
    assert {tuple(r) for r in G.adjacency(nested, buffer_m=2.0).collect()} == {("O", "I"), ("I", "O")}
    both = {tuple(r) for r in cells.polygon_overlap(
        df.select(F.col("pnu").alias("a"), "rings"), nested.select(F.col("pnu").alias("b"), "rings"), left_id="a", right_id="b").collect()}
    assert ("A", "O") in both and ("L", "O") in both and ("C", "O") in both and ("C", "I") not in both


def test_inner_point_of_a_u_shape(spark):
    u = ring((0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10))
    p = spark.createDataFrame([("u", [u])], SCHEMA).select(shapes.inner_point(F.col("rings")).alias("p")).first()["p"]
    assert inside([u], p["x"], p["y"])


def test_projection_centre_and_scale(spark):
    """The origin maps to the false origin; one degree north is one meridian degree."""
    df = spark.createDataFrame([(127.0, 38.0), (127.0, 39.0), (126.9784, 37.5667)], "x double, y double")
    out = [tuple(r) for r in project.to_target(df, 4326).collect()]
    assert abs(out[0][0] - 200000) < 1e-6 and abs(out[0][1] - 600000) < 1e-6
    a, e2 = 6378137.0, (2 - 1 / 298.257222101) / 298.257222101
    steps = 20000
    arc = sum(a * (1 - e2) / (1 - e2 * math.sin(math.radians(38 + (k + .5) / steps)) ** 2) ** 1.5 for k in range(steps)) * math.radians(1) / steps
    assert abs(out[1][1] - 600000 - arc) < 1e-3
    back = spark.createDataFrame([out[2]], "x double, y double").select(project.to_degrees(F.col("x"), F.col("y")).alias("d")).first()["d"]
    assert abs(back["lon"] - 126.9784) < 1e-9 and abs(back["lat"] - 37.5667) < 1e-9


def test_unknown_system_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        project.to_target(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), None)
