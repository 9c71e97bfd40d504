"""Raw source rows to clean tables, with one-row load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S
from parcelgrid.functions import address as A, fields as C, titles as N
from parcelgrid.functions.ids import normalized_id
from parcelgrid.functions.project import to_target
from parcelgrid.operators.asof import station_years
from parcelgrid.operators.matching import locate


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def clean_parcels(raw: DataFrame) -> DataFrame:
    """Parcels with normalised ids and land class; unusable ids are dropped."""
    keep = [c for c in raw.columns if c != "jimok_raw"]
    return raw.withColumn("pnu", normalized_id(raw, "pnu")).where(F.col("pnu").isNotNull()).select(
        *keep, A.land_class(F.col("jimok_raw")).alias("jimok"))


def parcel_report(raw: DataFrame) -> DataFrame:
    bad = normalized_id(raw, "pnu").isNull()
    return raw.agg(
        F.count(F.lit(1)).alias("total_rows"), _n(bad).alias("dropped_bad_pnu"), _n(~bad).alias("kept_rows"),
        _n(~bad & F.col("dong_addr").isNull()).alias("dong_missing"),
        _n(~bad & F.col("jibun").isNull()).alias("jibun_missing"),
        F.count_distinct("sigungu").alias("n_districts"))


def _parsed_buildings(raw: DataFrame) -> DataFrame:
    area = F.col("gross_floor_area")
    return raw.select(
        normalized_id(raw, "pnu").alias("pnu"),
        C.approval_year(F.col("approval_raw")).alias("approval_year"),
        C.structure_class(F.col("structure_raw")).alias("structure"),
        area.try_cast("double").alias("gross_floor_area"),
        (F.col("land_div") if "land_div" in raw.columns else F.lit(None).cast("string")).alias("land_div"),
        "sigungu")


def _empty_shape() -> Column:
    area = F.col("gross_floor_area")
    return (area.isNull() | (area <= 0)) & F.col("approval_year").isNull()


def clean_buildings(raw: DataFrame) -> DataFrame:
    """Buildings in the contract of the as-of operators.

    Rows without id go; rows with neither floor area nor approval year are
    empty shapes and go too.
    """
    return _parsed_buildings(raw).where(F.col("pnu").isNotNull() & ~_empty_shape())


def building_report(raw: DataFrame) -> DataFrame:
    b = _parsed_buildings(raw)
    ok = F.col("pnu").isNotNull()
    kept = ok & ~_empty_shape()
    return b.agg(
        F.count(F.lit(1)).alias("total_rows"), _n(~ok).alias("dropped_bad_pnu"),
        _n(ok & _empty_shape()).alias("dropped_empty_shape"), _n(kept).alias("kept_rows"),
        F.avg(F.when(kept, F.col("approval_year").isNull().cast("double"))).alias("year_missing_rate"),
        _n(kept & (F.col("structure") == "rc")).alias("n_rc"),
        F.count_distinct(F.when(kept, F.col("pnu"))).alias("n_parcels"))


def combined_buildings(general: DataFrame, collective: DataFrame, backfill: DataFrame | None = None) -> DataFrame:
    """Raw rows of both national files plus backfill of ids neither file has.

    ``backfill``: pnu, approval_year, gross_floor_area, structure.
    """
    df = general.unionByName(collective)
    if backfill is None:
        return df
    year = F.col("approval_year").cast("string")
    extra = backfill.where(F.length(year) == 4).select(
        F.lpad(F.col("pnu").cast("string"), S.PNU_LENGTH, "0").alias("pnu"), year.alias("approval_raw"),
        F.col("structure").alias("structure_raw"), F.col("gross_floor_area").cast("string").alias("gross_floor_area"))
    extra = extra.withColumn("sigungu", F.substring("pnu", 1, 5))
    missing = extra.join(df.select(F.col("pnu").cast("string").alias("pnu")).distinct(), "pnu", "left_anti")
    return df.withColumn("gross_floor_area", F.col("gross_floor_area").cast("string")).unionByName(missing)


def clean_prices(raw: DataFrame, order: str) -> DataFrame:
    """(year, pnu, price): 19-digit ids, numeric prices, the last duplicate wins."""
    ok = raw.where(F.length("pnu") == S.PNU_LENGTH).withColumn("price", F.col("price").try_cast("double"))
    return ok.where(F.col("price").isNotNull()).groupBy("year", "pnu").agg(F.max_by("price", order).alias("price"))


def clean_stations(raw: DataFrame, *, srid: int | None = 4326) -> DataFrame:
    """(name, line, x, y, open_year, open_source) in metres from text coordinates."""
    pts = raw.withColumns({"x": F.col("x").try_cast("double"), "y": F.col("y").try_cast("double")})
    moved = to_target(pts, srid)
    return moved.withColumns(station_years(F.col("line"))).select("name", "line", "x", "y", "open_year", "open_source")


def _trade_steps(items: DataFrame, index: DataFrame) -> DataFrame:
    """Live items with pnu and parsed numbers, nothing dropped yet."""
    live = items.where(~F.coalesce(F.trim("cdealType") == "O", F.lit(False))).withColumn("sigungu", F.trim("sggCd"))
    found = locate(live, index, F.concat(F.trim("umdNm"), F.trim("jibun")))
    amount = F.regexp_replace(F.trim("dealAmount"), ",", "")
    month = F.trim("dealMonth")
    return found.withColumns({
        "deal_amount": F.when(amount.rlike("^[0-9]+$"), amount).try_cast("long"),
        "area_m2": C.number_of(F.col("excluUseAr")), "land_share_m2": C.number_of(F.col("landAr")),
        "build_year": F.when(F.trim("buildYear").rlike("^[0-9]+$"), F.trim("buildYear")).try_cast("int"),
        "deal_ym": F.when(month.rlike("^[0-9]+$"), F.concat(F.trim("dealYear"), F.lpad(month, 2, "0"))),
    })


def clean_trades(items: DataFrame, index: DataFrame) -> DataFrame:
    """Trade rows located on a parcel; cancelled deals and unusable rows are gone."""
    t = _trade_steps(items, index).where(F.col("pnu").isNotNull() & F.col("deal_amount").isNotNull())
    return t.select("pnu", F.col("kind").alias("trade_type"), "deal_amount", "area_m2", "land_share_m2",
                    "build_year", "deal_ym", "sigungu")


def trade_report(items: DataFrame, index: DataFrame) -> DataFrame:
    t = _trade_steps(items, index)
    placed = F.col("pnu").isNotNull()
    ok = placed & F.col("deal_amount").isNotNull()
    villa = ok & (F.col("kind") == "villa")
    return t.agg(
        F.count(F.lit(1)).alias("api_rows"), _n(~placed).alias("pnu_miss"),
        _n(placed & F.col("deal_amount").isNull()).alias("amount_fail"), _n(ok).alias("matched"),
        F.round(F.try_divide(_n(ok).cast("double"), F.count(F.lit(1)).cast("double")), 3).alias("match_rate"),
        _n(villa).alias("villa_rows"), _n(villa & F.col("land_share_m2").isNull()).alias("villa_land_missing"))


def picked_columns(raw: DataFrame, names: dict[str, list[str]] = S.NOTICE_COLUMNS) -> DataFrame:
    """The first present alias of each wanted column; none gives null."""
    have = raw.columns
    cols = []
    for out, aliases in names.items():
        hit = next((a for a in aliases if a in have), None)
        cols.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(out))
    return raw.select(*cols)


def clean_notices(raw: DataFrame, *, one_per_number: bool = False) -> DataFrame:
    """(number, date, url, title); the same number of different offices is kept.

    ``one_per_number`` is for the paged source, which repeats its own rows.
    """
    n = picked_columns(raw).withColumns(
        {"number": N.notice_number(F.col("number")), "date": N.notice_date(F.col("date"))}
    ).where(F.col("number").isNotNull())
    if not one_per_number:
        return n
    return n.groupBy("number").agg(F.min(F.struct("date", "url", "title")).alias("_r")).select("number", "_r.*")


def crosscheck_dates(rows: DataFrame, *, latest: bool = True) -> DataFrame:
    """(sigungu, token, date) of a cross-check list (sigungu, name, date)."""
    t = rows.where(F.trim(F.coalesce("date", F.lit(""))) != "").select(
        "sigungu", F.explode(N.zone_tokens(F.col("name"))).alias("token"), F.substring("date", 1, 10).alias("date"))
    pick = F.max("date") if latest else F.min("date")
    return t.groupBy("sigungu", "token").agg(pick.alias("date"))


def cancelled_rows(raw: DataFrame, index: DataFrame, district_codes: dict[str, str]) -> DataFrame:
    """Cancelled zones located by their lot text; every in-scope row with what became of it.

    ``raw``: gu, zone_name, location, date. ``outcome`` is matched, recovered,
    parse_fail or lot_miss.
    """
    scoped = raw.withColumn("sigungu", C.lookup(district_codes, F.trim("gu"))).where(F.col("sigungu").isNotNull())
    found = locate(scoped, index, F.col("location"))
    day = F.substring("date", 1, 10)
    year = F.when(day.rlike("^[0-9]{4}"), F.substring(day, 1, 4)).try_cast("int")
    return found.select(
        "pnu", year.alias("t"), day.alias("t_date"), F.lit("cancel_date").alias("t_source"), F.lit(0).alias("label"),
        F.lit("reliable_negative").alias("certainty"), F.lit("해제").alias("source"),
        F.lit("cancelled").alias("neg_reason"), F.trim("zone_name").alias("zone_id"), "sigungu",
        F.when(F.col("dong").isNull(), "parse_fail").when(F.col("pnu").isNull(), "lot_miss")
        .when(F.col("by_legal"), "recovered").otherwise("matched").alias("outcome"))


def clean_cancelled(raw: DataFrame, index: DataFrame, district_codes: dict[str, str]) -> DataFrame:
    return cancelled_rows(raw, index, district_codes).where(F.col("pnu").isNotNull()).drop("outcome", "sigungu")


def cancelled_report(rows: DataFrame) -> DataFrame:
    hit = F.col("outcome").isin("matched", "recovered")
    return rows.agg(
        F.count(F.lit(1)).alias("in_scope_rows"), _n(hit).alias("matched_pnu"),
        F.round(F.avg(hit.cast("double")), 3).alias("match_rate"),
        *[_n(F.col("outcome") == o).alias(o) for o in ("parse_fail", "lot_miss", "recovered")])
