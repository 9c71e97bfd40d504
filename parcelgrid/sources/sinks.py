"""Materialised tables and the zone attribute store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelgrid import settings as S
from parcelgrid.functions.text import value_token
from parcelgrid.operators.keyed import first_per_key, new_rows, nulls_last

GRADE_ORDER = ["verified", "manual_verified", "flagged", S.OCR_GRADE]
ATTRS_TYPE = "map<string,struct<value:double,raw:string,label:string,grade:string>>"


def is_complete(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame], *,
                 partition_by: list[str] | None = None, force: bool = False) -> DataFrame:
    """The table at ``path``, built and written first when it is absent or ``force``.

    Rows are rebalanced on the partition columns: tasks write few files each,
    a large partition is written by as many tasks as its bytes ask for.
    """
    if force or not is_complete(spark, path):
        df = build()
        w = df.write.mode("overwrite")
        if partition_by:
            w = df.hint("rebalance", *[F.col(c) for c in partition_by]).write.mode("overwrite").partitionBy(*partition_by)
        w.parquet(path)
    # Partition values such as district codes stay text.
    old = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", old)


def _attribute_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One map per key. Of repeated attributes the better grade stays, then the smaller value and text."""
    grade = F.array_position(F.array(*[F.lit(g) for g in GRADE_ORDER]), F.col("grade"))
    one = first_per_key(rows.select(*keys, "attr", "value", "raw", "label", "grade"), [*keys, "attr"],
                        [grade, *nulls_last(F.col("value")), *nulls_last(F.col("raw")), *nulls_last(F.col("label"))])
    # At most one entry per attribute name, of which there are four.
    return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("attr"), F.struct("value", "raw", "label", "grade")))).alias("attrs"))


def store_entries(verified: DataFrame, keys: list[str]) -> DataFrame:
    """Graded attributes to one map per zone; missing and rejected ones are left out."""
    ok = verified.where(F.col("grade").isin("verified", "flagged", S.OCR_GRADE))
    packed = _attribute_map(ok, keys)
    return verified.select(*keys).distinct().join(packed, keys, "left").withColumn(
        "attrs", F.coalesce("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(
            "array<struct<value:double,raw:string,label:string,grade:string>>"))))


def manual_entries(rows: DataFrame) -> DataFrame:
    """Hand-entered values (zone_id, zone_name, attr, raw) graded by the range guard alone."""
    lows = F.create_map(*[F.lit(v) for k, r in S.ATTRIBUTE_RANGES.items() for v in (k, r[0])])
    highs = F.create_map(*[F.lit(v) for k, r in S.ATTRIBUTE_RANGES.items() for v in (k, r[1])])
    value = value_token(F.col("raw")).try_cast("double")
    lo, hi = F.try_element_at(lows, F.col("attr")), F.try_element_at(highs, F.col("attr"))
    ok = F.coalesce((value >= lo) & (value <= hi), F.lit(False))
    graded = rows.where(F.coalesce(F.col("raw") != "", F.lit(False))).select(
        "zone_id", "zone_name", "attr", "raw", value.alias("value"), F.col("attr").alias("label"),
        F.when(ok, "manual_verified").otherwise("flagged").alias("grade"))
    return _attribute_map(graded, ["zone_id", "zone_name"])


def pending(samples: DataFrame, store: DataFrame) -> DataFrame:
    """Samples whose zone is not in the store yet."""
    return new_rows(samples, store, ["zone_id"])


def upserted(store: DataFrame, entries: DataFrame, *, replace: bool = False) -> DataFrame:
    """Store plus entries; an existing zone is kept, or replaced when ``replace``."""
    a = store.withColumn("_p", F.lit(0))
    b = entries.withColumn("_p", F.lit(-1 if replace else 1))
    # A map cannot be ordered but its sorted entries can; they settle ties.
    order = [F.col("_p"), F.to_json(F.array_sort(F.map_entries("attrs")))]
    return first_per_key(a.unionByName(b), ["zone_id"], order).drop("_p").select(*store.columns)
