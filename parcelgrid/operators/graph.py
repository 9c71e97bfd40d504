"""Parcel adjacency: nodes, edges, neighbourhoods, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.functions import shapes
from parcelgrid.operators.cells import close_pairs, point_in_polygon
from parcelgrid.operators.keyed import salted_join
from parcelgrid.session import durable, release


def node_parcels(parcels: DataFrame, *, excluded: list[str] = S.EXCLUDED_LAND_CLASSES,
                 with_buildings: DataFrame | None = None) -> DataFrame:
    """Parcels whose land class may be redeveloped; built ones stay if asked."""
    drop = F.coalesce(F.col("jimok").isin(*excluded), F.lit(False))
    if with_buildings is None:
        return parcels.where(~drop)
    built = with_buildings.select("pnu").distinct().withColumn("_built", F.lit(True))
    return parcels.join(built, "pnu", "left").where(~drop | F.col("_built").isNotNull()).drop("_built")


def both_ways(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected pairs to distinct directed edges (src, dst)."""
    one = pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src <> dst").distinct()
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def adjacency(nodes: DataFrame, *, buffer_m: float = S.EDGE_BUFFER_M, by_district: bool = True,
              cell_m: float = 32.0) -> DataFrame:
    """Edges (src, dst), both directions, between parcels no more than ``buffer_m`` apart.

    With buffer 0 parcels must share boundary up to a tolerance. No edge
    crosses a district when ``by_district``.
    """
    on = ["sigungu"] if by_district else []
    reach = buffer_m if buffer_m > 0 else S.TOUCH_TOLERANCE_M
    a = nodes.select(*on, F.col("pnu").alias("a"), "rings")
    b = nodes.select(*on, F.col("pnu").alias("b"), "rings")
    pairs = close_pairs(a, b, left_id="a", right_id="b", within_m=reach, on=on, ordered=True, cell_m=cell_m)
    if buffer_m > 0:
        pairs = pairs.union(_nested(nodes, on))
    return both_ways(pairs)


def _nested(nodes: DataFrame, on: list[str]) -> DataFrame:
    """Parcels lying wholly inside another one."""
    corner = F.get(F.get(F.col("rings"), F.lit(0)), F.lit(0))
    pts = nodes.select(F.col("pnu").alias("a"), *[F.col(c).alias(f"_{c}") for c in on],
                       corner["x"].alias("x"), corner["y"].alias("y"))
    hit = point_in_polygon(pts, nodes.select(F.col("pnu").alias("b"), *on, "rings"), point_id="a")
    same = F.lit(True)
    for c in on:
        same = same & (F.col(f"_{c}") == F.col(c))
    return hit.where(same & (F.col("a") != F.col("b"))).select("a", "b")


def road_abutting(parcels: DataFrame, roads: DataFrame) -> DataFrame:
    """(pnu, road_abut): 1 when a parcel shares boundary with a road parcel."""
    touch = close_pairs(
        parcels.select(F.col("pnu").alias("a"), "rings"), roads.select(F.col("pnu").alias("b"), "rings"),
        left_id="a", right_id="b", within_m=S.TOUCH_TOLERANCE_M,
    ).select(F.col("a").alias("pnu")).distinct().withColumn("_r", F.lit(1))
    return parcels.select("pnu").join(touch, "pnu", "left").select(
        "pnu", F.coalesce("_r", F.lit(0)).alias("road_abut"))


def static_shape(parcels: DataFrame) -> DataFrame:
    """(pnu, area_m2, compactness, x, y) with the centroid."""
    c = shapes.centroid(F.col("rings"))
    return parcels.select(
        "pnu", shapes.area(F.col("rings")).alias("area_m2"),
        shapes.compactness(F.col("rings")).alias("compactness"), c.alias("_c"),
    ).select("pnu", "area_m2", "compactness", F.col("_c.x").alias("x"), F.col("_c.y").alias("y"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("pnu")).agg(F.count(F.lit(1)).alias("degree"))


def closure(seeds: DataFrame, edges: DataFrame, hops: int, *, on: list[str] | None = None) -> DataFrame:
    """Seeds and everything within ``hops`` edges, separately for each ``on`` key."""
    on = on or []
    keys = [*on, "pnu"]
    reached = seeds.select(*keys).distinct()
    for _ in range(hops):
        step = salted_join(
            edges, reached.withColumnRenamed("pnu", "src"), ["src"], ["dst"]
        ).select(*on, F.col("dst").alias("pnu"))
        reached = reached.unionByName(step).distinct()
    return reached


def neighbour_stats(values: DataFrame, edges: DataFrame, columns: list[str], *,
                    on: list[str] | None = None) -> DataFrame:
    """(src, on..) with mean_c and max_c over neighbours for every column c."""
    on = on or []
    far = values.select(F.col("pnu").alias("dst"), *on, *columns)
    return salted_join(edges, far, ["dst"], ["src"]).groupBy("src", *on).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns]
    ).withColumnRenamed("src", "pnu")


def neighbour_features(rows: DataFrame, values: DataFrame, edges: DataFrame, columns: list[str], *,
                       hops: int = 2, on: list[str] | None = None) -> DataFrame:
    """Rows plus nb{hop}_{mean|max}_{c}; hop 2 aggregates hop-1 means, no neighbour gives 0.

    ``values`` hold the columns of every (node, on) pair of the neighbourhood.
    """
    on = on or []
    keys = ["pnu", *on]
    out, level = rows, values
    for h in range(1, hops + 1):
        agg = neighbour_stats(level, edges, columns, on=on)
        if h < hops:
            agg = durable(agg)
        named = agg.select(
            *keys,
            *[F.col(f"mean_{c}").cast("double").alias(f"nb{h}_mean_{c}") for c in columns],
            *[F.col(f"max_{c}").cast("double").alias(f"nb{h}_max_{c}") for c in columns],
        )
        out = out.join(named, keys, "left")
        if h < hops:
            level = values.select(*keys).join(agg, keys, "left").select(
                *keys, *[F.coalesce(f"mean_{c}", F.lit(0.0)).alias(c) for c in columns])
    new = [f"nb{h}_{s}_{c}" for h in range(1, hops + 1) for s in ("mean", "max") for c in columns]
    return out.select(*rows.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in new])


def _followed(step: DataFrame) -> DataFrame:
    """Pointers (src, to) replaced by the end of their chain; chains only go down."""
    while True:
        hop = step.select(F.col("src").alias("to"), F.col("to").alias("_far"))
        longer = durable(step.join(hop, "to", "left").select("src", F.coalesce("_far", "to").alias("to"), "_far"))
        moved = not longer.where(F.col("_far").isNotNull()).isEmpty()
        release(step)
        step = longer.select("src", "to")
        if not moved:
            return step


def components(edges: DataFrame) -> DataFrame:
    """(pnu, component) of every node on an edge; the component is its smallest id.

    Each round points every label at its smallest neighbour label, follows the
    pointers to their ends by doubling and rewrites the edges; edges inside one
    label vanish. Rounds end when no edge is left.
    """
    live = durable(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = live.select(F.col("src").alias("pnu")).distinct().withColumn("component", F.col("pnu"))
    while not live.isEmpty():
        step = _followed(durable(
            live.groupBy("src").agg(F.min("dst").alias("to")).where(F.col("to") < F.col("src"))))
        nodes = nodes.join(step.withColumnRenamed("src", "component"), "component", "left").select(
            "pnu", F.coalesce("to", "component").alias("component"))
        ends = step.select(F.col("src").alias("dst"), F.col("to").alias("_dst"))
        moved = live.join(step, "src", "left").join(ends, "dst", "left").select(
            F.coalesce("to", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"))
        rest = durable(moved.where("src <> dst").distinct())
        live = rest
    return nodes


def with_min_size(members: DataFrame, group: str, min_nodes: int) -> DataFrame:
    """Members of groups that have at least ``min_nodes`` of them."""
    big = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_nodes).select(group)
    return members.join(big, group)


def _passing_components(flags: DataFrame, edges: DataFrame) -> DataFrame:
    """Components among passing nodes; a passing node without passing neighbours is its own."""
    ok = durable(flags.select("pnu"))
    kept = (
        edges.join(ok.withColumnRenamed("pnu", "src"), "src", "left_semi")
        .join(ok.withColumnRenamed("pnu", "dst"), "dst", "left_semi")
    )
    return durable(ok.join(components(kept), "pnu", "left").select(
        "pnu", F.coalesce("component", "pnu").alias("cluster_id")))


def candidate_clusters(scores: DataFrame, edges: DataFrame, *, threshold: float,
                       min_nodes: int = S.MIN_CLUSTER_NODES) -> DataFrame:
    """(cluster_id, pnu): connected parcels with score >= threshold."""
    high = scores.where(F.col("score") >= threshold)
    return with_min_size(_passing_components(high, edges), "cluster_id", min_nodes)


def region_grow(aging: DataFrame, edges: DataFrame, *, seed_cut: float = S.SEED_CUT,
                grow_cut: float = S.GROW_CUT, min_nodes: int = S.MIN_CLUSTER_NODES) -> DataFrame:
    """(cluster_id, pnu): connected old parcels that hold at least one seed."""
    grow = aging.where(F.col("aging") >= grow_cut)
    comp = _passing_components(grow, edges)
    seeded = comp.join(aging.where(F.col("aging") >= seed_cut).select("pnu"), "pnu", "left_semi").select(
        "cluster_id").distinct()
    return with_min_size(comp.join(seeded, "cluster_id"), "cluster_id", min_nodes)

