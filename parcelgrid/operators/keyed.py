"""Per-key picks and joins that stay even when one key holds a large share of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ROWS_PER_TASK = 500_000


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest ``order`` of each key.

    An aggregate rather than a window: candidates are reduced before the
    shuffle, so a key with very many rows does not fill one task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("_one"))
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def nulls_last(c: Column) -> list[Column]:
    """Order columns that put nulls after every value."""
    return [c.isNull().cast("int"), c]


def match_left(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str] | None = None) -> DataFrame:
    """Left equi join in which left rows with a null key are dealt over all tasks.

    Such rows match nothing; without care they all hash to one partition.
    ``spread`` are the left columns whose hash deals them, all others by default.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    by = spread or [c for c, kind in left.dtypes if c not in keys and not kind.startswith(("map", "struct", "array<map"))] or keys
    dealt = left.withColumn("_deal", F.when(known, F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.lit(4096)).cast("int")))
    # Always 0, but no literal: that would be folded away and the join be dealt by the keys alone.
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    return dealt.join(right.withColumn("_deal", zero), [*keys, "_deal"], "left").drop("_deal")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], *,
                how: str = "inner", rows_per_task: int = ROWS_PER_TASK, heavy: bool = False,
                counts: DataFrame | None = None) -> DataFrame:
    """Equi join whose left side may hold hot keys.

    Keys with more than ``rows_per_task`` left rows are cut into that many
    parts by a hash of ``spread``; matching right rows are repeated once per
    part. All other keys keep a single part. The table of hot keys has at most
    ``rows(left) / rows_per_task`` rows. ``left`` is read twice, so it should be
    cheap to read. With ``heavy`` the left rows are spread over all shuffle
    partitions even when they are few bytes: each pair costs much to test.
    """
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > rows_per_task).select(
        *keys, F.ceil(F.col("n") / rows_per_task).cast("int").alias("_parts"))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    lhs = left.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    if heavy:
        spark = left.sparkSession
        n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        lhs = lhs.repartition(n, *keys, "_salt")
    rhs = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return lhs.join(rhs, [*keys, "_salt"], how).drop("_salt")


def new_rows(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not yet known (skip-known merge, work backlog)."""
    return candidates.join(known.select(*keys).distinct(), keys, "left_anti")


def overlap_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row with the sizes of two id sets, their intersection and differences."""
    both = (
        a.select(key).distinct().withColumn("_a", F.lit(1))
        .join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    )
    one = F.lit(1)
    return both.agg(
        F.count(F.when(F.col("_a") == one, 1)).alias("n_a"),
        F.count(F.when(F.col("_b") == one, 1)).alias("n_b"),
        F.count(F.when((F.col("_a") == one) & (F.col("_b") == one), 1)).alias("n_both"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("only_a"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("only_b"),
    )
