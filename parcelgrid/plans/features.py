"""Node features at (parcel, year), neighbour features and the training matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.functions.fields import zoning_ordinal
from parcelgrid.operators import asof, graph
from parcelgrid.operators.cells import point_in_polygon
from parcelgrid.operators.keyed import first_per_key, nulls_last
from parcelgrid.plans import labels as L
from parcelgrid.session import durable


@dataclass
class Tables:
    """Cleaned inputs a feature job reads."""

    parcels: DataFrame          # pnu, sigungu, jimok, rings
    stock: DataFrame            # asof.building_stock
    zoning: DataFrame           # a6, rings
    land_percentiles: DataFrame  # year, pnu, pct
    stations: DataFrame         # x, y, open_year, open_source


def zoning_at(points: DataFrame, zoning: DataFrame) -> DataFrame:
    """(pnu, zoning_ord, zoning_missing, zoning_name): the lowest mapped class covering a point."""
    hit = point_in_polygon(points.select("pnu", "x", "y"), zoning.select("a6", "rings"), point_id="pnu")
    mapped = F.when(zoning_ordinal(F.col("a6")) > 0, zoning_ordinal(F.col("a6")))
    first = first_per_key(hit.select("pnu", "a6"), ["pnu"], [*nulls_last(mapped), F.col("a6")])
    return points.select("pnu").join(first, "pnu", "left").select(
        "pnu",
        F.when(F.col("a6").isNotNull(), zoning_ordinal(F.col("a6"))).otherwise(float(S.ZONING_DEFAULT)).alias("zoning_ord"),
        F.col("a6").isNull().cast("int").alias("zoning_missing"),
        F.col("a6").alias("zoning_name"))


def static_features(parcels: DataFrame, every: DataFrame, zoning: DataFrame) -> DataFrame:
    """Features of ``parcels`` that do not depend on the year; roads come from ``every``."""
    shape = graph.static_shape(parcels)
    roads = every.where(F.col("jimok") == S.ROAD_CLASS)
    abut = graph.road_abutting(parcels, roads)
    zone = zoning_at(durable(L.inner_points(parcels)), zoning).drop("zoning_name")
    return shape.join(abut, "pnu").join(zone, "pnu")


def node_features(rows: DataFrame, tables: Tables, *, current_year: int = S.CURRENT_YEAR) -> DataFrame:
    """(pnu, t) plus the ten node features; nothing later than t is visible at t."""
    asked = durable(rows.select("pnu", "t").distinct())
    here = tables.parcels.join(asked.select("pnu").distinct(), "pnu", "left_semi")
    static = durable(static_features(here, tables.parcels, tables.zoning))
    built = asof.stock_as_of(tables.stock, asked).select(
        "pnu", "t", asof.area_ratio().alias("aging"), "n_existing")
    base = asked.join(static, "pnu", "left").join(built, ["pnu", "t"], "left")
    land = asof.land_price_as_of(base, tables.land_percentiles, current_year=current_year)
    rail = asof.rail_as_of(asked, static.select("pnu", "x", "y"), tables.stations, current_year=current_year)
    out = land.join(rail.select("pnu", "t", "rail_prox"), ["pnu", "t"], "left")
    density = F.try_divide(F.col("n_existing"), F.col("area_m2")) * 10000.0
    return out.select(
        "pnu", "t",
        F.coalesce("aging", F.lit(0.0)).alias("aging"), "area_m2", "compactness",
        F.coalesce(density, F.lit(0.0)).alias("bldg_density"),
        F.col("road_abut").cast("double").alias("road_abut"),
        F.col("land_pct").cast("double").alias("land_pct"), F.col("land_missing").cast("double").alias("land_missing"),
        F.coalesce("zoning_ord", F.lit(0.0)).alias("zoning_ord"),
        F.coalesce(F.col("zoning_missing").cast("double"), F.lit(1.0)).alias("zoning_missing"),
        F.col("rail_prox").alias("rail_prox"))


def with_neighbours(rows: DataFrame, edges: DataFrame, tables: Tables, *, hops: int = 2,
                    current_year: int = S.CURRENT_YEAR) -> DataFrame:
    """(pnu, t) rows plus own and neighbour features, each neighbour seen at the row's own year.

    Only the ``hops`` neighbourhood of the asked rows is described, for all
    years in one pass.
    """
    asked = rows.select("pnu", "t").distinct()
    around = graph.closure(asked, edges, hops, on=["t"])
    values = durable(node_features(around, tables, current_year=current_year))
    own = asked.join(values, ["pnu", "t"])
    return graph.neighbour_features(own, values, edges, S.NODE_FEATURES, hops=hops, on=["t"])


def all_node_features(nodes: DataFrame, edges: DataFrame, tables: Tables, *,
                      year: int = S.CURRENT_YEAR) -> DataFrame:
    """Features of every node at the current year."""
    rows = nodes.select("pnu", F.lit(year).alias("t"))
    values = durable(node_features(rows, tables, current_year=year))
    out = graph.neighbour_features(values, values, edges, S.NODE_FEATURES, on=["t"])
    return out.withColumn("sigungu", F.substring("pnu", 1, 5))


def training_matrix(labels: DataFrame, nodes: DataFrame, edges: DataFrame, tables: Tables, *,
                    hops: int = 2) -> DataFrame:
    """Trainable label rows inside the graph with centroid, own and neighbour features."""
    rows = L.trainable(L.in_graph(labels, nodes)).select(
        "pnu", "t", F.col("label").alias("y"), "certainty", "neg_reason", "zone_id",
        F.substring("pnu", 1, 5).alias("sigungu"))
    where = graph.static_shape(tables.parcels).select(
        "pnu", F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"))
    feats = with_neighbours(rows, edges, tables, hops=hops)
    return rows.join(where, "pnu").join(feats, ["pnu", "t"])


def matrix_report(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: what reconciliation and filtering dropped, class balance."""
    inside = labels.join(nodes.select("pnu", F.lit(True).alias("_in")), "pnu", "left")
    ok = F.coalesce("_in", F.lit(False))
    left = ok & ~F.col("contaminated") & (F.col("certainty") != "uncertain")

    def n(cond):
        return F.count(F.when(cond, 1))

    out = inside.agg(
        n(ok).alias("reconciled_rows"), n(~ok).alias("dropped_non_node"),
        n(ok & F.col("contaminated")).alias("dropped_contaminated"),
        n(ok & ~F.col("contaminated") & (F.col("certainty") == "uncertain")).alias("dropped_uncertain"),
        n(left).alias("final_rows"), n(left & (F.col("label") == 1)).alias("positives"),
        n(left & (F.col("label") == 0)).alias("negatives"))
    return out.withColumn("neg_per_pos", F.round(F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")), 1))
