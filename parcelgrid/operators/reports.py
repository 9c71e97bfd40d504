"""Load reports, source comparisons and score profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.functions import titles as N
from parcelgrid.operators.cells import point_in_polygon, radius_join
from parcelgrid.operators.ranks import exact_quantiles


def share(hit: Column) -> Column:
    return F.avg(hit.cast("double"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def score_distribution(scores: DataFrame, *, cut: float = 0.5) -> DataFrame:
    """Per district: n, median, mean and share of scores >= cut."""
    base = scores.groupBy("sigungu").agg(F.avg("score").alias("mean"), share(F.col("score") >= cut).alias("high_share"))
    mid = exact_quantiles(scores, ["sigungu"], "score", {"median": 0.5})
    return base.join(mid, "sigungu")


def over_prediction(scores: DataFrame, threshold: float) -> DataFrame:
    """One row: share of scores at or above the threshold and the median score."""
    one = F.lit(1).alias("_k")
    a = scores.agg(F.count(F.lit(1)).alias("n_all"), share(F.col("score") >= threshold).alias("positive_share"))
    q = exact_quantiles(scores, [], "score", {"median": 0.5}).select("median", one)
    return a.select("*", one).join(q, "_k").drop("_k")


def zone_score_profile(members: DataFrame, scores: DataFrame, group: str) -> DataFrame:
    """Per group of designated parcels: median percentile and shares in the top 10 / 30 / 50 %."""
    m = members.join(scores.select("pnu", "score_pct"), "pnu")
    base = m.groupBy(group).agg(
        share(F.col("score_pct") >= 0.9).alias("top10"), share(F.col("score_pct") >= 0.7).alias("top30"),
        share(F.col("score_pct") >= 0.5).alias("top50"))
    return base.join(exact_quantiles(m, [group], "score_pct", {"median_pct": 0.5}), group)


def ratio_differences(a: DataFrame, b: DataFrame, value: str, key: str = "pnu") -> DataFrame:
    """One row comparing two sources of a per-key figure."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full")
    both = j.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).withColumn("_d", F.abs(F.col("_b") - F.col("_a")))
    stats = both.agg(
        F.count(F.lit(1)).alias("n_both"), F.avg("_d").alias("mean_diff"), F.max("_d").alias("max_diff"),
        share(F.col("_d") > 0.05).alias("over_5"), share(F.col("_d") > 0.10).alias("over_10"),
        share(F.col("_d") < 0.001).alias("same"), share(F.col("_b") < F.col("_a")).alias("b_lower"))
    cover = j.agg(
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"))
    mid = exact_quantiles(both, [], "_d", {"median_diff": 0.5}).select("median_diff")
    one = F.lit(1).alias("_k")
    return stats.select("*", one).join(cover.select("*", one), "_k").join(mid.select("*", one), "_k").drop("_k")


def lost_coverage(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Parcels of ``primary`` buildings that ``other`` lacks: (pnu, is_residential, n, gu)."""
    per = primary.groupBy("pnu").agg(
        F.bool_or(F.coalesce(F.col("use_type").isin(*S.RESIDENTIAL_USES), F.lit(False))).alias("is_residential"),
        F.count(F.lit(1)).alias("n_buildings"))
    return per.join(other.select("pnu").distinct(), "pnu", "left_anti").withColumn("gu", F.substring("pnu", 1, 5))


def loss_skew(lost: DataFrame, every: DataFrame) -> DataFrame:
    """Per district: share among lost parcels over share among all parcels."""
    a = lost.groupBy("gu").agg(F.count(F.lit(1)).alias("n_lost"), share(F.col("is_residential")).alias("residential_share"))
    b = every.select("pnu").distinct().groupBy(F.substring("pnu", 1, 5).alias("gu")).agg(F.count(F.lit(1)).alias("n_every"))
    totals = b.agg(F.sum("n_every").alias("_all"), F.lit(1).alias("_k"))
    lost_all = a.agg(F.sum("n_lost").alias("_lost"), F.lit(1).alias("_k"))
    j = b.join(a, "gu", "left").withColumn("_k", F.lit(1)).join(totals, "_k").join(lost_all, "_k")
    return j.select(
        "gu", "n_every", F.coalesce("n_lost", F.lit(0)).alias("n_lost"), "residential_share",
        (F.coalesce("n_lost", F.lit(0)) / F.col("n_every")).alias("loss_rate"),
        F.try_divide(F.coalesce("n_lost", F.lit(0)) / F.col("_lost"), F.col("n_every") / F.col("_all")).alias("skew"))


def zone_density(zones: DataFrame, points: DataFrame, *, weight: Column | None = None) -> DataFrame:
    """(zone_id, density): points (or their weight) per hectare in each zone."""
    p = points.withColumn("_w", (weight if weight is not None else F.lit(1)).cast("double"))
    hits = point_in_polygon(p.select("point_id", "x", "y", "_w"), zones.select("zone_id", "rings"), point_id="point_id")
    n = hits.groupBy("zone_id").agg(F.sum("_w").alias("_n"))
    return zones.select("zone_id", "area_ha").join(n, "zone_id", "left").select(
        "zone_id", (F.coalesce("_n", F.lit(0.0)) / F.col("area_ha")).alias("density"))


def dwelling_weight(use_is_shared: Column, floor_area: Column) -> Column:
    """Dwellings of a building: floor area / 70 but at least 1 for shared housing, else 1."""
    return F.when(use_is_shared, F.greatest(F.lit(1.0), floor_area / F.lit(S.UNIT_FLOOR_AREA_M2))).otherwise(F.lit(1.0))


def threshold_flips(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """One row: zones passing a density threshold in source a, in b, and flips between them."""
    j = a.select("zone_id", F.col("density").alias("_a")).join(b.select("zone_id", F.col("density").alias("_b")), "zone_id")
    pa, pb = F.col("_a") >= threshold, F.col("_b") >= threshold
    return j.agg(
        F.count(F.lit(1)).alias("n_zones"), F.count(F.when(pa, 1)).alias("pass_a"), F.count(F.when(pb, 1)).alias("pass_b"),
        F.count(F.when(pa & ~pb, 1)).alias("lost"), F.count(F.when(pb & ~pa, 1)).alias("gained"))


def control_points(points: DataFrame, zones: DataFrame, *, samples: int, order: str = "seq") -> DataFrame:
    """Evenly spaced points by ``order`` (0-based, gap free) that lie outside all zones."""
    n = points.count()
    step = max(n - 1, 0) / max(samples - 1, 1)
    # Position k of the even spacing is int(k * step); keep rows that are one.
    k = F.ceil(F.col(order) / F.lit(step)) if step > 0 else F.lit(0)
    picked = points.where(F.floor(k * F.lit(step)) == F.col(order)) if step > 1 else points
    inside = point_in_polygon(picked.select("point_id", "x", "y"), zones.select("zone_id", "rings"), point_id="point_id")
    return picked.join(inside.select("point_id").distinct(), "point_id", "left_anti")


def circle_density(centres: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """(point_id, density): points per hectare in a circle around each centre."""
    ha = 3.141592653589793 * radius_m * radius_m / 10000.0
    pairs = radius_join(centres.select("point_id", "x", "y"),
                        points.select(F.col("x").alias("rx"), F.col("y").alias("ry")), radius_m, left_id="point_id")
    n = pairs.groupBy("point_id").agg(F.count(F.lit(1)).alias("_n"))
    return centres.select("point_id").join(n, "point_id", "left").select(
        "point_id", (F.coalesce("_n", F.lit(0)) / F.lit(ha)).alias("density"))


def column_profile(df: DataFrame, columns: list[str], *, low: float, high: float) -> DataFrame:
    """(column, n, in_range, whole): shares over non-null numbers, all columns in one pass."""
    parts = []
    for c in columns:
        v = F.col(c).try_cast("double")
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v.between(low, high).cast("double")).alias("in_range"),
            F.avg((v == F.round(v)).cast("double")).alias("whole")))
    return df.agg(F.array(*parts).alias("_p")).select(F.inline("_p"))


def holdout_bias(zones: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Zones with the sources their name key occurs in and why a zone is left out.

    ``zones``: zone_id, sigungu, title, year; the sources: sigungu, name.
    """
    def keys(df: DataFrame, flag: str) -> DataFrame:
        return df.select(N.holdout_key(F.col("name"), F.col("sigungu")).alias("key")).where(
            F.col("key").isNotNull()).distinct().withColumn(flag, F.lit(True))

    z = zones.withColumn("key", N.holdout_key(F.col("title"), F.col("sigungu")))
    j = z.join(keys(first, "_a"), "key", "left").join(keys(second, "_b"), "key", "left")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    held = ~(a | b)
    return j.select(
        "zone_id", "sigungu", "year", a.alias("in_first"), b.alias("in_second"), held.alias("held"),
        F.when(held, F.when(F.col("key").isNull(), "no_key").when(F.col("year") >= 2022, "recent").otherwise("old"))
        .alias("reason"))


def holdout_rates(biased: DataFrame) -> DataFrame:
    """Per district: zones, held-back zones, rate, source overlap and reasons."""
    a, b, h = F.col("in_first"), F.col("in_second"), F.col("held")
    return biased.groupBy("sigungu").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(h, 1)).alias("n_held"), share(h).alias("held_rate"),
        F.count(F.when(a & ~b, 1)).alias("first_only"), F.count(F.when(b & ~a, 1)).alias("second_only"),
        F.count(F.when(a & b, 1)).alias("both"),
        *[F.count(F.when(F.col("reason") == r, 1)).alias(f"reason_{r}") for r in ("no_key", "recent", "old")])
