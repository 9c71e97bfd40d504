"""Ranks, running totals and exact quantiles that never sort one group in one task.

Rows are first reduced to distinct (group, value) counts, written once. Values
are cut into buckets at a few hundred quantile edges, which are plain numbers.
A window then runs inside (group, bucket), and another one over the bucket
totals of a group. Edges only decide how work is split: any edges give the same
answer.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.operators.keyed import salted_join
from parcelgrid.session import durable

BUCKETS = 512


def value_edges(df: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """Distinct inner bucket edges; at most ``buckets`` numbers reach the driver."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(value).cast("double").alias(value)).approxQuantile(value, probs, 0.2 / buckets)
    return sorted({e for e in found})


def bucketed(df: DataFrame, value: str, edges: list[float], out: str = "_bucket") -> DataFrame:
    splits = [-float("inf"), *edges, float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


def running_totals(df: DataFrame, groups: list[str], value: str, sums: dict[str, Column], *,
                   descending: bool = False) -> DataFrame:
    """Distinct (group, value) rows with each sum up to and including the value.

    For every name in ``sums`` the result has ``name`` (at this value),
    ``cum_name`` (up to it, in the chosen direction) and ``all_name`` (group
    total). Null values are left out.
    """
    src = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    distinct = durable(src.groupBy(*groups, value).agg(*[c.alias(n) for n, c in sums.items()]))
    cut = bucketed(distinct, value, value_edges(distinct, value))

    def order(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    inside = Window.partitionBy(*groups, "_bucket").orderBy(order(value))
    local = cut.withColumns({
        f"cum_{n}": F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for n in sums})
    totals = cut.groupBy(*groups, "_bucket").agg(*[F.sum(n).alias(f"_b_{n}") for n in sums])
    # At most len(edges) + 1 rows per group.
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = over.orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_bucket",
        *[F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_b_{n}").over(over).alias(f"all_{n}") for n in sums],
    )
    joined = local.join(offsets, [*groups, "_bucket"])
    return joined.select(
        *groups, value,
        *[F.col(n) for n in sums],
        *[(F.col(f"cum_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in sums],
        *[F.col(f"all_{n}") for n in sums],
    )


def average_rank(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct (group, value) with n, n_below, n_all and the average rank of ties."""
    run = running_totals(df, groups, value, {"n": F.count(F.lit(1))})
    return run.select(
        *groups, value, "n",
        (F.col("cum_n") - F.col("n")).alias("n_below"),
        F.col("all_n").alias("n_all"),
        (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"),
    )


def with_percentile(df: DataFrame, groups: list[str], value: str, out: str, *,
                    scale: float = 1.0) -> DataFrame:
    """Rows plus average rank / n of ``value`` inside ``groups`` (nulls stay null)."""
    return with_rank_columns(df, groups, value, {out: F.col("avg_rank") / F.col("n_all") * F.lit(scale)})


def with_rank_columns(df: DataFrame, groups: list[str], value: str, columns: dict[str, Column], *, how: str = "left") -> DataFrame:
    """Rows plus columns made of ``average_rank`` of their value; a value that many rows share is salted."""
    ranks = durable(average_rank(df, groups, value))
    keys = [*groups, value]
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "struct", "array"))]
    return salted_join(df.withColumn(value, F.col(value).cast("double")), ranks.select(*keys, *[c.alias(n) for n, c in columns.items()]),
                       keys, plain, how=how, counts=ranks.select(*keys, "n"))


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation, plus ``n``.

    A group's values are never held together: bucket counts locate the two
    neighbouring order statistics, and only their buckets are looked at again.
    """
    src = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    distinct = durable(src.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_m")))
    cut = bucketed(distinct, value, value_edges(distinct, value))
    counts = cut.groupBy(*groups, "_bucket").agg(F.sum("_m").alias("_c"))
    wanted = locate_quantiles(counts, groups, probs)
    return pick_quantiles(cut.join(wanted, [*groups, "_bucket"]), groups, value, probs)


def _positions(p: float) -> tuple[Column, Column, Column]:
    h = (F.col("n") - 1) * F.lit(float(p))
    return F.floor(h), F.ceil(h), h


def _holds(at: Column, start: Column, count: Column) -> Column:
    return (at >= start) & (at < start + count)


def holds_quantile(probs: dict[str, float], start: Column, count: Column) -> Column:
    """Whether a wanted order statistic of ``n`` values is among the ``count`` after the first ``start``."""
    needed = F.lit(False)
    for p in probs.values():
        lo, hi, _ = _positions(p)
        needed = needed | _holds(lo, start, count) | _holds(hi, start, count)
    return needed


def locate_quantiles(counts: DataFrame, groups: list[str], probs: dict[str, float]) -> DataFrame:
    """Buckets that hold the wanted order statistics: (groups, _bucket, _before, n).

    ``counts`` has (groups, _bucket, _c), at most one row per bucket and group.
    """
    over = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    upto = over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(
        *groups, "_bucket", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), "_c",
        F.sum("_c").over(over).alias("n"),
    )
    return placed.where(holds_quantile(probs, F.col("_before"), F.col("_c"))).select(*groups, "_bucket", "_before", "n")


def pick_quantiles(near: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from the rows of the located buckets, each standing for ``_m`` values."""
    near = near.groupBy(*groups, "_bucket", "_before", "n", value).agg(F.sum("_m").alias("_c"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    seated = near.withColumn("_start", F.col("_before") + F.sum("_c").over(inside) - F.col("_c"))
    picks = []
    for name, p in probs.items():
        lo, hi, h = _positions(p)
        picks.append(F.max(F.when(_holds(lo, F.col("_start"), F.col("_c")), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.max(F.when(_holds(hi, F.col("_start"), F.col("_c")), F.col(value))).alias(f"_hi_{name}"))
        picks.append(F.max(h - lo).alias(f"_f_{name}"))
    out = seated.groupBy(*groups, "n").agg(*picks)
    return out.select(
        *groups, "n",
        *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_f_{k}")).alias(k) for k in probs],
    )


def top_percent(below: Column) -> Column:
    """100 * (1 - share of values below) to one decimal, rounded as the checking SQL does.

    Shares of counts often end in a half (54.95), which a double holds a hair
    off; scaled to tenths most are halves again, and those go up.
    """
    return F.round(100.0 * (1.0 - below) * 10.0) / 10.0


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k largest rows; Spark keeps k rows per partition and merges them."""
    return df.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def screen(scores: DataFrame, *, district: str | None = None, min_pct: float = 0.0,
           k: int = 50) -> DataFrame:
    """Highest scores of a district above a percentile, shown as 'top x %'."""
    df = scores.where(F.col("sigungu") == district) if district else scores
    best = top_k(df.where(F.col("score_pct") >= min_pct), "score", k, "pnu")
    shown = [c for c in ("pnu", "sigungu", "lon", "lat") if c in best.columns]
    return best.select(*shown, top_percent(F.col("score_pct")).alias("rank_pct"))


def extremes_per_group(df: DataFrame, group: str, value: str, tie: str, k: int, *,
                       largest: bool = False) -> DataFrame:
    """k smallest (or largest) rows per group.

    Each group is first cut into parts by a hash of the tie column and only k
    rows per part survive, so the last window sees few rows per group.
    """
    order = [F.col(value).desc() if largest else F.col(value), F.col(tie)]
    cut = df.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(256)))
    first = Window.partitionBy(group, "_part").orderBy(*order)
    last = Window.partitionBy(group).orderBy(*order)
    return (
        cut.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k)
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        .drop("_part", "_k")
    )
