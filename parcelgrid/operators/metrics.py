"""Evaluation metrics as grouped aggregates over a score column.

Curve metrics read running totals over distinct scores, so ties are one step
and no group is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.operators.ranks import exact_quantiles, running_totals, with_rank_columns


def curve(df: DataFrame, groups: list[str], *, y: str = "y", p: str = "p",
          weight: str | None = None) -> DataFrame:
    """Distinct scores, highest first, with running true positives and rows."""
    w = F.col(weight) if weight else F.lit(1)
    sums = {"tp": F.sum(F.when(F.col(y) == 1, w).otherwise(0)), "n": F.sum(w)}
    return running_totals(df, groups, p, sums, descending=True)


def average_precision(curve_rows: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, pr_auc): recall-weighted precision; null when one class is missing."""
    step = F.try_divide(F.col("tp"), F.col("all_tp")) * F.try_divide(F.col("cum_tp"), F.col("cum_n"))
    two = (F.max("all_tp") > 0) & (F.max("all_tp") < F.max("all_n"))
    return curve_rows.groupBy(*groups).agg(F.when(two, F.sum(step)).alias("pr_auc"))


def best_f1(curve_rows: DataFrame, groups: list[str], *, p: str = "p") -> DataFrame:
    """(groups, best_f1, best_thr): lowest threshold among equal best values."""
    precision = F.try_divide(F.col("cum_tp"), F.col("cum_n"))
    recall = F.try_divide(F.col("cum_tp"), F.col("all_tp"))
    f1 = 2 * precision * recall / (precision + recall + F.lit(1e-12))
    best = curve_rows.withColumn("_f1", f1).groupBy(*groups).agg(
        F.max_by(F.struct("_f1", p), F.struct("_f1", -F.col(p))).alias("_b"),
        ((F.max("all_tp") > 0) & (F.max("all_tp") < F.max("all_n"))).alias("_two"),
    )
    return best.select(
        *groups,
        F.when(F.col("_two"), F.col("_b._f1")).alias("best_f1"),
        F.when(F.col("_two"), F.col(f"_b.{p}")).otherwise(F.lit(0.5)).alias("best_thr"),
    )


def f1_at(threshold: float | Column, *, y: str = "y", p: str = "p") -> Column:
    """Aggregate: F1 of score >= threshold."""
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    tp = F.count(F.when(hit & pos, 1))
    wrong = F.count(F.when(hit != pos, 1))
    return F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + wrong), F.lit(0.0))


def share_when(hit: Column, mask: Column) -> Column:
    """Aggregate: share of ``mask`` rows with ``hit``; null when there is none."""
    return F.avg(F.when(mask, hit.cast("double")))


def battleground_recall(threshold: float | Column, *, y: str = "y", p: str = "p",
                        aging: str = "aging") -> tuple[Column, Column]:
    """Aggregates: recall on positives whose own age is 0, and their number."""
    mask = (F.col(y) == 1) & (F.col(aging) == 0.0)
    return share_when(F.col(p) >= threshold, mask), F.count(F.when(mask, 1))


def negative_split(df: DataFrame, threshold: float | Column, groups: list[str] | None = None) -> DataFrame:
    """False-positive rate and count of cancelled (hard) and new-built (easy) negatives."""
    groups = groups or []
    hit = F.col("p") >= threshold
    aggs = []
    for name, reason in (("hard", "cancelled"), ("easy", "new_construction")):
        mask = (F.col("y") == 0) & (F.col("neg_reason") == reason)
        aggs += [share_when(hit, mask).alias(f"{name}_fpr"), F.count(F.when(mask, 1)).alias(f"{name}_n")]
    return df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)


def evaluate(df: DataFrame, groups: list[str]) -> DataFrame:
    """Full report per group: PR-AUC, best F1 and, at its threshold, the hard cases."""
    c = curve(df, groups)
    best = best_f1(c, groups)
    if groups:
        at = df.join(best.select(*groups, "best_thr"), groups)
    else:
        # ``best`` is a single row.
        at = df.withColumn("_k", F.lit(1)).join(F.broadcast(best.select("best_thr", F.lit(1).alias("_k"))), "_k")
    recall, n = battleground_recall(F.col("best_thr"))
    report = at.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("y").alias("n_pos"),
        recall.alias("battleground_recall"), n.alias("battleground_n"),
    )
    split = negative_split(at, F.col("best_thr"), groups)
    ap = average_precision(c, groups)
    if groups:
        return report.join(ap, groups).join(best, groups).join(split, groups)
    one = F.lit(1).alias("_k")
    out = report.select("*", one)
    for part in (ap, best, split):
        out = out.join(part.select("*", one), "_k")
    return out.drop("_k")


def reliability_bins(df: DataFrame, *, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """(bin, n, conf, acc): mean score and hit rate per score bin."""
    step = 1.0 / bins
    reached = F.lit(-1)
    for i in range(bins + 1):
        reached = reached + (F.col(p) >= F.lit(i * step)).cast("int")
    b = F.least(F.greatest(reached, F.lit(0)), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: bin-size weighted gap between score and hit rate."""
    gap = F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc")))
    return bins.agg(F.try_divide(gap, F.sum("n").cast("double")).alias("ece"))


def topk_precision(df: DataFrame, shares: tuple[float, ...] = (0.1, 0.2, 0.5), *, key: str = "id",
                   y: str = "y", p: str = "p") -> DataFrame:
    """(share, k, precision) of the best int(share * n) rows, ties by ``key`` (a number)."""
    run = curve(df, [], y=y, p=p)
    cuts = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    k = F.greatest(F.lit(1), F.floor(F.col("share") * F.col("all_n"))).cast("long")
    edge = run.select("*", cuts).withColumn("k", k).where(
        (F.col("cum_n") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("cum_n")))
    edge = edge.select(
        "share", "k", p, (F.col("cum_tp") - F.col("tp")).alias("_above"),
        (F.col("k") - (F.col("cum_n") - F.col("n"))).alias("_need"))
    ties = df.withColumn(p, F.col(p).cast("double")).join(edge, p).select("share", "k", "_above", "_need", key, y)
    seated = running_totals(ties, ["share", "k", "_above", "_need"], key, {
        "tp": F.sum(F.col(y)), "n": F.count(F.lit(1))})
    hit = seated.where(F.col("cum_n") <= F.col("_need")).groupBy("share", "k", "_above").agg(
        F.max("cum_tp").alias("_tie"))
    return hit.select("share", "k", ((F.col("_above") + F.col("_tie")) / F.col("k")).alias("precision"))


def roc_auc(df: DataFrame, groups: list[str], *, y: str = "y", p: str = "p") -> DataFrame:
    """(groups, roc_auc) by the rank-sum formula with average ranks."""
    sums = {"pos": F.sum(F.col(y)), "n": F.count(F.lit(1))}
    r = running_totals(df, groups, p, sums)
    avg = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0
    agg = r.groupBy(*groups).agg(
        F.sum(avg * F.col("pos")).alias("_s"), F.max("all_pos").alias("_p"), F.max("all_n").alias("_n"))
    pos = F.col("_p").cast("double")
    return agg.select(*groups, F.try_divide(
        F.col("_s") - pos * (pos + 1) / 2, pos * (F.col("_n") - pos)).alias("roc_auc"))


def with_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows plus rank_c and pct_c (average rank, average rank / n) of each column."""
    for c in columns:
        df = with_rank_columns(df, [], c, {
            f"rank_{c}": F.col("avg_rank"), f"pct_{c}": F.col("avg_rank") / F.col("n_all")}, how="inner")
    return df


def scoring_agreement(df: DataFrame, a: str, b: str, *, top: float = 0.9) -> DataFrame:
    """One row: Spearman, median and p90 of the percentile shift, top retention."""
    r = with_ranks(df, [a, b]).withColumn("_shift", F.abs(F.col(f"pct_{a}") - F.col(f"pct_{b}")))
    q = exact_quantiles(r, [], "_shift", {"shift_median": 0.5, "shift_p90": 0.9})
    in_a, in_b = F.col(f"pct_{a}") > top, F.col(f"pct_{b}") > top
    stats = r.agg(
        F.corr(f"rank_{a}", f"rank_{b}").alias("spearman"),
        F.count(F.when(in_a, 1)).alias("n_top"),
        F.count(F.when(in_a & in_b, 1)).alias("n_top_kept"),
        F.count(F.when(in_a & ~in_b, 1)).alias("n_top_lost"),
    )
    one = F.lit(1).alias("_k")
    return stats.select("*", one).join(q.select("shift_median", "shift_p90", one), "_k").drop("_k")


def zone_matches(zones: DataFrame, clusters: DataFrame) -> DataFrame:
    """Best cluster of each zone: (zone_id, cluster_id, iou, core_capture).

    ``zones``: zone_id, pnu; ``clusters``: cluster_id, pnu. A zone no cluster
    touches gets 0 and 0; equal IoU falls to the smaller cluster id.
    """
    zone_n = zones.groupBy("zone_id").agg(F.count(F.lit(1)).alias("_zn"))
    cluster_n = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_cn"))
    shared = zones.select("zone_id", "pnu").join(clusters.select("cluster_id", "pnu"), "pnu")
    pair = shared.groupBy("zone_id", "cluster_id").agg(F.count(F.lit(1)).alias("_i"))
    sized = pair.join(cluster_n, "cluster_id").join(zone_n, "zone_id")
    iou = F.col("_i") / (F.col("_zn") + F.col("_cn") - F.col("_i"))
    best = sized.withColumn("iou", iou).withColumn("core_capture", F.col("_i") / F.col("_zn")).groupBy(
        "zone_id").agg(F.min(F.struct((-F.col("iou")).alias("_o"), "cluster_id", "iou", "core_capture")).alias("_b"))
    return zone_n.join(best, "zone_id", "left").select(
        "zone_id", F.col("_b.cluster_id").alias("cluster_id"),
        F.coalesce("_b.iou", F.lit(0.0)).alias("iou"),
        F.coalesce("_b.core_capture", F.lit(0.0)).alias("core_capture"))


def compare_methods(zones: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """One row per clustering method: mean IoU and core capture over zones, cluster sizes."""
    out = None
    for name, clusters in methods.items():
        m = zone_matches(zones, clusters).agg(
            F.round(F.avg("iou"), 3).alias("mean_iou"),
            F.round(F.avg("core_capture"), 3).alias("mean_core_capture"),
            F.count(F.lit(1)).alias("n_zones"))
        sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).agg(
            F.count(F.lit(1)).alias("n_clusters"),
            F.coalesce(F.round(F.avg("_n"), 0), F.lit(0.0)).alias("avg_cluster_size"))
        one = F.lit(name).alias("method")
        row = m.select(one, "*").join(sizes.select(one, "*"), "method")
        out = row if out is None else out.unionByName(row)
    return out
