"""(parcel, year) label table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.functions import shapes
from parcelgrid.operators.asof import old_ratio_by_parcel
from parcelgrid.operators.cells import point_in_polygon
from parcelgrid.operators.keyed import first_per_key, nulls_last

LABEL_COLUMNS = ["pnu", "t", "t_date", "t_source", "t_alt", "label", "certainty", "source",
                 "neg_reason", "zone_id", "zone_type", "contaminated"]


def inner_points(parcels: DataFrame) -> DataFrame:
    """(pnu, x, y) of a point inside each parcel."""
    p = shapes.inner_point(F.col("rings"))
    return parcels.select("pnu", p.alias("_p")).select("pnu", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


def zone_members(zones: DataFrame, points: DataFrame) -> DataFrame:
    """(pnu, zone columns): every zone a parcel point lies in."""
    return point_in_polygon(points.select("pnu", "x", "y"), zones, point_id="pnu").drop("x", "y")


def dissolve_zones(parts: DataFrame, columns: list[str]) -> DataFrame:
    """One row per zone: attributes of its first part, number of parts and total area.

    Shapes stay one row per part; a zone of any size never becomes one value.
    """
    row = F.struct(*columns)
    return parts.groupBy("zone_id").agg(
        F.min_by(row, F.col("part_no")).alias("_r"), F.count(F.lit(1)).alias("n_parts"),
        F.sum(shapes.area(F.col("rings"))).alias("area_m2"),
    ).select("zone_id", *[F.col(f"_r.{c}").alias(c) for c in columns], "n_parts", "area_m2")


def positives(zones: DataFrame, points: DataFrame) -> DataFrame:
    """Label rows of parcels inside zones; the earliest year wins."""
    hit = zone_members(zones.select("zone_id", "t", "t_date", "t_source", "t_alt", "zone_type", "rings"), points)
    first = first_per_key(hit, ["pnu"], [*nulls_last(F.col("t")), F.col("zone_id")])
    none = F.lit(None).cast("string")
    return first.select(
        "pnu", F.col("t").cast("int").alias("t"), "t_date", "t_source", "t_alt", F.lit(1).alias("label"),
        F.lit("positive").alias("certainty"), F.lit("의제처리").alias("source"), none.alias("neg_reason"),
        "zone_id", "zone_type", F.lit(False).alias("contaminated"))


def flag_contamination(pos: DataFrame, current_ratio: DataFrame, *,
                       cut: float = S.MIN_OLD_RATIO_FOR_POSITIVE) -> DataFrame:
    """Flag all parcels of zones whose mean current old ratio is below the cut (already rebuilt)."""
    done = (
        pos.select("pnu", "zone_id").join(current_ratio, "pnu")
        .groupBy("zone_id").agg(F.avg("old_ratio").alias("_now")).where(F.col("_now") < cut)
        .select("zone_id", F.lit(True).alias("_done"))
    )
    flagged = pos.join(done, "zone_id", "left")
    return flagged.withColumn("contaminated", F.coalesce("_done", F.lit(False))).select(*pos.columns)


def derived_negatives(current_ratio: DataFrame, pos: DataFrame, *, current_year: int = S.CURRENT_YEAR,
                      newbuild_cut: float = S.NEWBUILD_MAX_OLD_RATIO,
                      old_cut: float = S.UNDESIGNATED_MIN_OLD_RATIO) -> DataFrame:
    """New-built reliable negatives and old undesignated rows; the band between is left out."""
    free = current_ratio.where(F.col("old_ratio").isNotNull()).join(pos.select("pnu"), "pnu", "left_anti")
    new, old = F.col("old_ratio") < newbuild_cut, F.col("old_ratio") >= old_cut
    none = F.lit(None).cast("string")
    return free.where(new | old).select(
        "pnu", F.lit(current_year).alias("t"), F.lit(f"{current_year}-01-01").alias("t_date"),
        F.lit("derived_current").alias("t_source"), none.alias("t_alt"), F.lit(0).alias("label"),
        F.when(new, "reliable_negative").otherwise("uncertain").alias("certainty"),
        F.when(new, "신축파생").otherwise("노후미지정").alias("source"),
        F.when(new, "new_construction").otherwise("not_yet").alias("neg_reason"),
        none.alias("zone_id"), none.alias("zone_type"), F.lit(False).alias("contaminated"))


def aligned(rows: DataFrame) -> DataFrame:
    """Rows of any label source brought to the label columns."""
    kinds = {"t": "int", "label": "int", "contaminated": "boolean"}
    have = set(rows.columns)
    return rows.select(*[
        (F.col(c) if c in have else F.lit(False) if c == "contaminated" else F.lit(None))
        .cast(kinds.get(c, "string")).alias(c) for c in LABEL_COLUMNS])


def priority() -> Column:
    order = F.lit(9)
    for name, rank in S.CERTAINTY_PRIORITY.items():
        order = F.when(F.col("certainty") == name, rank).otherwise(order)
    return order


def resolve_conflicts(rows: DataFrame) -> DataFrame:
    """One row per (pnu, t): positive, then reliable negative, then uncertain."""
    return first_per_key(rows, ["pnu", "t"], [priority(), F.col("source"), F.col("zone_id")]).select(*rows.columns)


def label_table(zones: DataFrame, points: DataFrame, stock: DataFrame, cancelled: DataFrame, *,
                current_year: int = S.CURRENT_YEAR) -> DataFrame:
    """All label sources together; rows of one parcel at different years stay apart."""
    now = old_ratio_by_parcel(stock, current_year)
    pos = flag_contamination(positives(zones, points), now)
    every = pos.unionByName(aligned(cancelled)).unionByName(derived_negatives(now, pos, current_year=current_year))
    return resolve_conflicts(every)


def label_report(labels: DataFrame) -> DataFrame:
    """One row of load figures; parcels labelled at several years are counted too."""
    def n(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    per = labels.groupBy("pnu").agg(F.count(F.lit(1)).alias("_n"))
    doubles = per.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("double_rows"),
                      F.lit(1).alias("_k"))
    stats = labels.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[n(F.col("certainty") == c).alias(f"n_{c}") for c in S.CERTAINTY_PRIORITY],
        F.count_distinct(F.when(F.col("certainty") == "positive", F.col("zone_id"))).alias("positive_zones"),
        n(F.col("contaminated")).alias("contaminated"),
        n(F.col("source") == "해제").alias("cancelled_negatives"),
        n(F.col("source") == "신축파생").alias("newbuild_negatives"),
        F.lit(1).alias("_k"))
    return stats.join(doubles, "_k").drop("_k")


def in_graph(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    return labels.join(nodes.select("pnu"), "pnu", "left_semi")


def trainable(labels: DataFrame) -> DataFrame:
    """Rows a model may learn from: neither rebuilt nor uncertain."""
    return labels.where(~F.col("contaminated") & (F.col("certainty") != "uncertain"))
