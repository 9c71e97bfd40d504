"""The 19-digit parcel id: normalise, check, take apart, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def normalized_id(df: DataFrame, name: str) -> Column:
    """Id column padded to 19 digits; null when it cannot be an id.

    Floats have already lost their last digits, so a column that is neither
    text nor whole numbers is refused when the plan is built.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.StringType, *_WHOLE)):
        raise TypeError(f"column {name} is {kind.simpleString()}; read parcel ids as strings")
    digits = F.regexp_extract(F.col(name).cast("string"), r"^\s*([0-9]{1,19})\s*$", 1)
    return F.when(digits != "", F.lpad(digits, 19, "0"))


def is_valid_id(pnu: Column) -> Column:
    """19 digits whose register digit says land (1) or mountain (2)."""
    return F.coalesce(pnu.rlike("^[0-9]{10}[12][0-9]{8}$"), F.lit(False))


def id_parts(pnu: Column) -> Column:
    """Struct of the codes inside a valid id; null for anything else."""
    return F.when(
        is_valid_id(pnu),
        F.struct(
            F.substring(pnu, 1, 10).alias("dong_code"),
            F.substring(pnu, 1, 5).alias("sigungu"),
            F.substring(pnu, 11, 1).alias("register"),
            (F.substring(pnu, 11, 1) == "2").alias("is_mountain"),
            F.substring(pnu, 12, 4).cast("int").alias("main_no"),
            F.substring(pnu, 16, 4).cast("int").alias("sub_no"),
        ),
    )


def district_of(pnu: Column) -> Column:
    return F.substring(pnu, 1, 5)


def in_districts(df: DataFrame, codes: list[str], *, pnu: str = "pnu") -> DataFrame:
    """Rows whose id lies in the configured districts, ids normalised."""
    return df.withColumn(pnu, normalized_id(df, pnu)).where(district_of(F.col(pnu)).isin(*codes))
