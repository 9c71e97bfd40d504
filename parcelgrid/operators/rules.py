"""Cluster metrics, redevelopment path rules, permit and stage look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.operators.asof import area_ratio, count_ratio, stock_at


def parcel_facts(parcels: DataFrame, stock: DataFrame, *, t: int = S.CURRENT_YEAR,
                 road_abut: DataFrame | None = None) -> DataFrame:
    """Per parcel sums that cluster metrics add up.

    ``parcels``: pnu, area_m2 and road_abut (or pass ``road_abut`` apart).
    """
    if road_abut is not None:
        parcels = parcels.join(road_abut, "pnu", "left")
    every = stock.groupBy("pnu").agg(F.sum("n").alias("n_buildings"), F.sum("area").alias("gfa"))
    return (
        parcels.select("pnu", "area_m2", "road_abut")
        .join(every, "pnu", "left").join(stock_at(stock, t), "pnu", "left")
    )


def cluster_metrics(members: DataFrame, facts: DataFrame, *, group: str = "cluster_id",
                    undersized_m2: float = S.UNDERSIZED_LOT_M2,
                    low_far: float = S.LOW_DENSITY_FAR) -> DataFrame:
    """Requirement figures of all clusters at once; what cannot be judged is null.

    ``members``: group, pnu. A parcel without buildings has floor ratio 0 and
    counts as low density.
    """
    far = F.coalesce(F.try_divide(F.coalesce("gfa", F.lit(0.0)), F.col("area_m2")), F.lit(0.0))
    sums = [F.sum(c).alias(c) for c in ("n_existing", "n_with_area", "area", "n_old", "old_area")]
    agg = members.select(group, "pnu").join(facts, "pnu").groupBy(group).agg(
        F.count(F.lit(1)).alias("n_parcels"),
        F.coalesce(F.sum("n_buildings"), F.lit(0)).cast("long").alias("n_buildings"),
        (F.sum("area_m2") / 10000.0).alias("_ha"),
        F.avg(F.col("road_abut").cast("double")).alias("abut_ratio"),
        F.avg((F.col("area_m2") < undersized_m2).cast("double")).alias("undersized_ratio"),
        F.avg((far < low_far).cast("double")).alias("low_density_ratio"),
        *sums,
    )
    by_area = F.col("n_with_area") == F.col("n_existing")
    return agg.select(
        group, "n_parcels", "n_buildings", F.round("_ha", 3).alias("area_ha"),
        F.when(by_area, area_ratio()).otherwise(count_ratio()).alias("old_area_ratio"),
        "abut_ratio",
        F.try_divide(F.col("n_buildings").cast("double"), F.col("_ha")).alias("house_density"),
        "undersized_ratio", "low_density_ratio",
    )


def _passes(value: Column, ok: Column) -> Column:
    return F.coalesce(value.isNotNull() & ok, F.lit(False))


def _shown(value: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f", F.bround(value, digits)), F.lit("NaN"))


def _reason(label: str, value: Column, ok: Column, sign: tuple[str, str], limit: float, digits: int = 2) -> Column:
    return F.concat(F.lit(label + " "), _shown(value, digits), F.when(ok, f" {sign[0]} ").otherwise(f" {sign[1]} "),
                    F.lit(f"{limit}"))


def classify(metrics: DataFrame, *, old_cut: float = S.HOUSING_OLD_AREA_RATIO,
             abut_cut: float = S.HOUSING_ABUT_RATIO_MAX, density_cut: int = S.HOUSING_DENSITY_MIN) -> DataFrame:
    """Metrics plus path, eligibility flags, reasons and caveats.

    Density is reported but does not decide the housing path.
    """
    oa, ab, hd = F.col("old_area_ratio"), F.col("abut_ratio"), F.col("house_density")
    us, ld = F.col("undersized_ratio"), F.col("low_density_ratio")
    old_ok, abut_ok = _passes(oa, oa >= old_cut), _passes(ab, ab <= abut_cut)
    dens_ok = _passes(hd, hd >= density_cut)
    c1, c2 = _passes(oa, oa >= S.URBAN_OLD_RATIO), _passes(us, us >= S.URBAN_UNDERSIZED_RATIO)
    c3 = _passes(ld, ld >= S.URBAN_LOW_DENSITY_RATIO)
    count = c1.cast("int") + c2.cast("int") + c3.cast("int")
    ge, le = ("≥", "<"), ("≤", ">")
    housing, urban = F.col("housing_eligible"), F.col("urban_eligible")
    return metrics.withColumns({
        "housing_eligible": old_ok & abut_ok,
        "urban_count": count,
        "urban_eligible": count >= S.URBAN_REQUIRED,
    }).withColumns({
        "path": F.when(housing | urban, S.PATH_REDEVELOPMENT)
        .when(_passes(oa, oa >= S.SMALL_SCALE_OLD_RATIO), S.PATH_SMALL_SCALE).otherwise(S.PATH_NONE),
        "housing_reasons": F.array(
            _reason("노후연면적", oa, old_ok, ge, old_cut), _reason("접도율", ab, abut_ok, le, abut_cut),
            _reason("호수밀도", hd, dens_ok, ge, density_cut, 0)),
        "urban_reasons": F.array(
            _reason("노후도", oa, c1, ge, S.URBAN_OLD_RATIO), _reason("과소필지", us, c2, ge, S.URBAN_UNDERSIZED_RATIO),
            _reason("저밀이용", ld, c3, ge, S.URBAN_LOW_DENSITY_RATIO),
            F.concat(F.lit("충족 "), count.cast("string"), F.lit(f"/{S.URBAN_REQUIRED}개"))),
        "caveats": F.array(*[F.lit(c) for c in S.RULE_CAVEATS]),
    })


def rule_change_impact(metrics: DataFrame) -> DataFrame:
    """Rule with the density branch (A) against the rule without it (B), per zone."""
    oa, ab, hd = F.col("old_area_ratio"), F.col("abut_ratio"), F.col("house_density")
    old_ok, abut_ok = _passes(oa, oa >= S.HOUSING_OLD_AREA_RATIO), _passes(ab, ab <= S.HOUSING_ABUT_RATIO_MAX)
    dens_ok = _passes(hd, hd >= S.HOUSING_DENSITY_MIN)
    both = classify(metrics)
    a = (old_ok & (abut_ok | dens_ok)) | F.col("urban_eligible")
    b = (old_ok & abut_ok) | F.col("urban_eligible")
    return both.withColumns({"pass_a": a, "pass_b": b, "rescued": a & ~b})


def permit_status(property_type: Column, *, in_complex: Column | None = None, applies_by_default: bool = True,
                  apartment_always: bool = True, villa_in_complex: bool = True,
                  residence_duty: bool = True) -> Column:
    """Struct of the land-permit rule by property type; unknown types count as restricted."""
    in_complex = F.lit(False) if in_complex is None else in_complex
    if not applies_by_default:
        applies = F.lit(False)
    else:
        applies = (
            F.when(property_type.isin(*S.APARTMENT_TYPES), F.lit(apartment_always))
            .when(property_type.isin(*S.VILLA_TYPES), F.lit(villa_in_complex) & in_complex)
            .otherwise(F.lit(True))
        )
    duty = applies & F.lit(residence_duty)
    return F.struct(
        applies.alias("permit_applies"), (~duty).alias("gap_investment_possible"), duty.alias("residence_duty"),
        F.lit(S.PERMIT_BASIS_DATE).alias("basis_date"),
        F.array(F.lit(S.PERMIT_CAVEAT)).alias("caveats"),
    )


def stage_remaining(stage: Column, in_zone: Column) -> Column:
    """Struct (stage, known, min, max, typical, note); years only inside a zone with a known stage."""
    table = F.create_map(*[v for k, (lo, hi, typ) in S.STAGE_REMAINING.items() for v in (
        F.lit(k), F.struct(F.lit(lo).alias("min"), F.lit(hi).alias("max"), F.lit(typ).alias("typical")))])
    given = stage.isNotNull() & (stage != "")
    hit = F.when(in_zone & given, F.try_element_at(table, stage))
    known = hit.isNotNull()
    return F.struct(
        F.when(in_zone & given, stage).alias("stage"), known.alias("known"),
        hit["min"].alias("min_years"), hit["max"].alias("max_years"), hit["typical"].alias("typical_years"),
        F.when(~in_zone, S.NOTE_OUTSIDE_ZONE).when(~given, S.NOTE_NO_STAGE)
        .when(~known, S.NOTE_UNKNOWN_STAGE).alias("note"),
        F.when(known, F.array(F.lit(S.STAGE_CAVEAT))).otherwise(F.array().cast("array<string>")).alias("caveats"),
    )


def entry_status(property_type: Column, stage: Column, in_zone: Column, *,
                 in_complex: Column | None = None) -> Column:
    """Present fact (permit) and future estimate (remaining years) kept apart."""
    return F.struct(permit_status(property_type, in_complex=in_complex).alias("permit"),
                    stage_remaining(stage, in_zone).alias("remaining"))


def land_provenance(level: Column, n: Column) -> Column:
    """Where a land-share price comes from and how many trades it rests on."""
    count = F.coalesce(n, F.lit(0)).cast("long").cast("string")
    return (
        F.when(level == "r50", F.concat(F.lit("반경 50m 실거래 "), count, F.lit("건")))
        .when(level == "r100", F.concat(F.lit("반경 100m 실거래 "), count, F.lit("건")))
        .when(level == "dong", F.concat(F.lit("주변 거래 부족 → 동 평균 "), count, F.lit("건")))
        .otherwise("거래 없음")
    )


def market_context(land: Column, newbuild: Column, level: Column, n_land: Column, n_new: Column) -> Column:
    """Two prices side by side with their provenance; they are never subtracted."""
    n = F.coalesce(n_new, F.lit(0))
    return F.struct(
        land.alias("land_share_pyung"), newbuild.alias("newbuild_pyung"),
        land_provenance(level, n_land).alias("land_provenance"),
        F.when(newbuild.isNotNull() & (n > 0), F.concat(F.lit("반경 1km 신축 "), n.cast("string"), F.lit("건")))
        .otherwise("거래 부족").alias("newbuild_provenance"),
        level.alias("agg_level"), n_land.alias("n_land"), n_new.alias("n_new"),
    )


def zone_type_pass_rates(classified: DataFrame) -> DataFrame:
    """Path shares by zone type and era, with subtotals over each (grouping sets)."""
    era = F.when(F.col("t") < 2010, "~2009").when(F.col("t") < 2020, "2010-19").otherwise("2020+")
    path = F.col("path")
    return (
        classified.withColumn("era", era).cube("zone_type", "era").agg(
            F.grouping_id().alias("level"),
            F.count(F.lit(1)).alias("n"),
            F.count(F.when(path == S.PATH_REDEVELOPMENT, 1)).alias("redevelopment"),
            F.count(F.when(path == S.PATH_SMALL_SCALE, 1)).alias("small_scale"),
            F.count(F.when(path == S.PATH_NONE, 1)).alias("none"),
        ).withColumn("pass_rate", F.col("redevelopment") / F.col("n"))
    )
