"""Single source fields: structure, year, numbers, prices, lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid import settings as S


def lookup(table: dict, key: Column) -> Column:
    """Value of a literal map, null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), key)


def structure_class(name: Column) -> Column:
    """'rc' for durable frames, else 'other'; a light frame beats a steel one."""
    durable = "|".join(re.escape(w) for w in S.DURABLE_WORDS)
    return (
        F.when(name.isNull() | name.contains(S.LIGHT_WORD), "other")
        .when(name.rlike(durable), "rc")
        .otherwise("other")
    )


def approval_year(text: Column) -> Column:
    """Year in the first four characters, null outside 1900..2100."""
    y = F.when(F.trim(text).rlike("^[0-9]{4}"), F.substring(F.trim(text), 1, 4)).try_cast("int")
    return F.when(y.between(S.YEAR_MIN, S.YEAR_MAX), y)


def number_of(text: Column) -> Column:
    """Number text with thousands commas; blank, dash and junk give null."""
    s = F.regexp_replace(F.trim(text), ",", "")
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s).try_cast("double")


def within_window(df: DataFrame, current_ym: int, years: int, *, ym: str = "deal_ym") -> DataFrame:
    """Rows of the last ``years`` years, months as yyyymm integers."""
    cutoff = (current_ym // 100 - years) * 100 + current_ym % 100
    return df.where(F.col(ym) >= cutoff)


def price_per_pyeong(amount: Column, area_m2: Column) -> Column:
    return F.try_divide(amount, area_m2 / F.lit(S.PYEONG_M2))


def villa_unit_prices(trades: DataFrame) -> DataFrame:
    """Villa trades with a usable land share, priced per pyeong of it."""
    return trades.where(
        (F.col("trade_type") == "villa") & (F.col("land_share_m2") > 0)
    ).withColumn("pyung", price_per_pyeong(F.col("deal_amount"), F.col("land_share_m2")))


def zoning_ordinal(name: Column) -> Column:
    return F.coalesce(lookup(S.ZONING_ORDINAL, name), F.lit(S.ZONING_DEFAULT)).cast("double")


def far_limit(name: Column) -> Column:
    return lookup(S.ZONING_FAR_LIMIT, name)


def proximity(distance: Column, radius: float = S.RAIL_RADIUS_M) -> Column:
    """1 at the site, falling linearly to 0 at ``radius``."""
    return 1.0 - F.least(F.greatest(distance / F.lit(float(radius)), F.lit(0.0)), F.lit(1.0))


def confidence(score: Column, threshold: Column, margin: float = S.CONFIDENCE_MARGIN) -> Column:
    """High when the score lies at least ``margin`` from the threshold."""
    return F.when(F.abs(score - threshold) >= F.lit(margin), S.HIGH_CONFIDENCE).otherwise(S.LOW_CONFIDENCE)


def rank_phrase(pct: Column) -> Column:
    """'상위 p%' up to 50, '하위 (100-p)%' above."""
    low = F.round(F.lit(100.0) - pct, 1)
    return F.when(pct <= 50, F.concat(F.lit("상위 "), pct.cast("string"), F.lit("%"))).otherwise(
        F.concat(F.lit("하위 "), low.cast("string"), F.lit("%"))
    )


def neighbour_columns(hops: int, features: list[str] = S.NODE_FEATURES) -> list[str]:
    return [f"nb{h}_{s}_{c}" for h in range(1, hops + 1) for s in ("mean", "max") for c in features]


def feature_sets(columns: list[str]) -> dict[str, list[str]]:
    """Column lists of the one-hop and two-hop models."""
    one = [c for c in columns if c.startswith("nb1_")]
    two = [c for c in columns if c.startswith("nb2_")]
    return {"B1": S.NODE_FEATURES + one, "B1+": S.NODE_FEATURES + one + two}


def production_features(columns: list[str]) -> list[str]:
    """Two-hop set without any zoning column."""
    return [c for c in feature_sets(columns)["B1+"] if "zoning" not in c]
