"""Facts as known at a year: building stock, old ratios, yearly prices, stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.functions.fields import lookup, proximity
from parcelgrid.functions.ids import district_of
from parcelgrid.operators.cells import nearest_site
from parcelgrid.operators.ranks import with_percentile


def is_old(year: Column, structure: Column, t: Column) -> Column:
    limit = F.when(structure == "rc", S.RC_YEARS).otherwise(S.OTHER_YEARS)
    return t - year >= limit


def building_stock(buildings: DataFrame) -> DataFrame:
    """Buildings reduced to (pnu, approval_year, structure) counts and areas.

    A parcel keeps at most a few hundred rows, whatever number of buildings it
    has, and every as-of figure below can be read from it.
    """
    return buildings.groupBy("pnu", "approval_year", "structure").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("gross_floor_area").alias("n_area"),
        F.coalesce(F.sum("gross_floor_area"), F.lit(0.0)).alias("area"),
    )


def _stock_sums(t: Column) -> list[Column]:
    old = is_old(F.col("approval_year"), F.col("structure"), t)
    return [
        F.sum("n").alias("n_existing"),
        F.sum("n_area").alias("n_with_area"),
        F.sum("area").alias("area"),
        F.sum(F.when(old, F.col("n")).otherwise(0)).alias("n_old"),
        F.sum(F.when(old, F.col("area")).otherwise(0.0)).alias("old_area"),
    ]


def stock_at(stock: DataFrame, t: int) -> DataFrame:
    """Per parcel sums over buildings approved by year ``t``."""
    return stock.where(F.col("approval_year") <= t).groupBy("pnu").agg(*_stock_sums(F.lit(t)))


def stock_as_of(stock: DataFrame, requests: DataFrame) -> DataFrame:
    """The same sums for every requested (pnu, t); requests without buildings are absent."""
    req = requests.select("pnu", "t").distinct()
    return (
        req.join(stock, "pnu").where(F.col("approval_year") <= F.col("t"))
        .groupBy("pnu", "t").agg(*_stock_sums(F.col("t")))
    )


def area_ratio() -> Column:
    """Old floor area over floor area; unknown when there is none."""
    return F.try_divide(F.col("old_area"), F.col("area"))


def count_ratio() -> Column:
    return F.try_divide(F.col("n_old").cast("double"), F.col("n_existing").cast("double"))


def old_ratio_by_parcel(stock: DataFrame, t: int, *, weight: str = "area") -> DataFrame:
    """(pnu, old_ratio) at ``t``; a missing area weighs nothing."""
    ratio = area_ratio() if weight == "area" else count_ratio()
    return stock_at(stock, t).select("pnu", ratio.alias("old_ratio"))


def old_ratio_of_groups(stock: DataFrame, members: DataFrame, t: int, *, group: str = "group_id",
                        weight: str = "area") -> DataFrame:
    """(group, old_ratio) of parcel groups; counts decide when any area is missing."""
    sums = ["n_existing", "n_with_area", "area", "n_old", "old_area"]
    per = (
        members.select(group, "pnu").join(stock_at(stock, t), "pnu")
        .groupBy(group).agg(*[F.sum(c).alias(c) for c in sums])
    )
    by_area = F.lit(weight == "area") & (F.col("n_with_area") == F.col("n_existing"))
    ratio = per.select(group, F.when(by_area, area_ratio()).otherwise(count_ratio()).alias("old_ratio"))
    return members.select(group).distinct().join(ratio, group, "left")


def density_by_parcel(stock: DataFrame, areas: DataFrame, t: int) -> DataFrame:
    """Buildings per hectare at ``t``; 0 for a parcel without any."""
    return areas.select("pnu", "area_m2").join(stock_at(stock, t), "pnu", "left").select(
        "pnu",
        F.coalesce(F.try_divide(F.col("n_existing"), F.col("area_m2")) * 10000.0, F.lit(0.0)).alias("bldg_density"),
    )


def land_percentile(prices: DataFrame) -> DataFrame:
    """(year, pnu, pct): average-rank percentile of a price inside its year and district."""
    ranked = with_percentile(
        prices.where(F.col("price").isNotNull()).withColumn("_gu", district_of(F.col("pnu"))),
        ["year", "_gu"], "price", "pct")
    return ranked.select("year", "pnu", "pct")


def land_price_as_of(rows: DataFrame, percentiles: DataFrame, *,
                     current_year: int = S.CURRENT_YEAR) -> DataFrame:
    """(pnu, t) rows plus land_pct and land_missing, years beyond the current one clamped."""
    keyed = rows.withColumn("year", F.least(F.col("t"), F.lit(current_year)))
    return keyed.join(percentiles, ["pnu", "year"], "left").drop("year").withColumns({
        "land_missing": F.col("pct").isNull().cast("int"),
        "land_pct": F.coalesce(F.col("pct"), F.lit(0.5)),
    }).drop("pct")


def station_years(lines: Column) -> dict[str, Column]:
    """Opening year of a line with its source tag; unknown lines count as old."""
    known = lookup(S.LINE_OPEN_YEAR, lines)
    return {
        "open_year": F.coalesce(known, F.lit(S.DEFAULT_OPEN_YEAR)),
        "open_source": F.when(known.isNotNull(), "compiled").otherwise("pre2001"),
    }


def rail_as_of(rows: DataFrame, points: DataFrame, stations: DataFrame, *,
               current_year: int = S.CURRENT_YEAR, radius_m: float = S.RAIL_RADIUS_M) -> DataFrame:
    """(pnu, t) rows plus distance to the nearest station open by t, proximity and source.

    Each station is repeated for the years it is open in, so "open by t" is an
    equality; the fan-out is bounded by the calendar.
    """
    asked = rows.select("pnu", "t").distinct().withColumn("yr", F.least(F.col("t"), F.lit(current_year)))
    years = asked.select("yr").distinct()
    sites = (
        stations.where(F.col("open_year") <= current_year)
        .select(F.col("x").alias("sx"), F.col("y").alias("sy"), "open_source", "open_year")
        .withColumn("yr", F.explode(F.sequence(F.col("open_year"), F.lit(current_year))))
        .join(years, "yr", "left_semi").drop("open_year")
    )
    near = nearest_site(
        asked.join(points.select("pnu", "x", "y"), "pnu"), sites,
        point_id=["pnu", "t"], on=["yr"], payload=["open_source"])
    return rows.join(near, ["pnu", "t"], "left").select(
        *[F.col(c) for c in rows.columns],
        F.col("dist").alias("rail_dist_m"),
        proximity(F.col("dist"), radius_m).alias("rail_prox"),
        F.coalesce(F.col("open_source"), F.lit("none")).alias("rail_src"),
    )
