"""Zone-block bootstrap of a PR-AUC difference.

Positives are resampled by zone, negatives by k-means blocks of about a zone's
size. The draws are a written table with one row per block; a task gets the
rows of one score bucket and the draws of the blocks in it, never all draws.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.operators.ranks import bucketed, value_edges
from parcelgrid.session import durable


#: Distinct places that are clustered together, on average; tiles follow a Z-order curve.
TILE = 2048
#: Bits of a coordinate on that curve.
BITS = 20


def _along_curve(spots: DataFrame) -> Column:
    """Place of (cx, cy) on a Z-order curve over the box of all spots."""
    box = spots.agg(F.min("cx").alias("x"), F.min("cy").alias("y"), F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).alias("side")).first()
    step = (box["side"] or 1.0) / (1 << BITS)
    x, y = (F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(step)), F.lit((1 << BITS) - 1)) for c, low in (("cx", box["x"]), ("cy", box["y"])))
    bits = [F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("bigint")), 2 * b + odd) for b in range(BITS) for v, odd in ((y, 0), (x, 1))]
    # Summed in pairs: a chain of 40 sums would nest as deep.
    while len(bits) > 1:
        bits = [a + b for a, b in zip(bits[::2], bits[1::2])] + bits[len(bits) & ~1:]
    return bits[0].cast("double")


def k_means(at: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """Cluster of each of a few thousand weighted points; centres start apart (k-means++)."""
    chosen = [int(rng.choice(len(at), p=weight / weight.sum()))]
    far = ((at - at[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and (chance := far * weight).sum() > 0:
        chosen.append(int(rng.choice(len(at), p=chance / chance.sum())))
        far = np.minimum(far, ((at - at[chosen[-1]]) ** 2).sum(1))
    centres, label = at[chosen], None
    for _ in range(rounds):
        gaps = (at[:, :1] - centres[:, 0]) ** 2 + (at[:, 1:] - centres[:, 1]) ** 2
        last, label = label, gaps.argmin(1)
        if last is not None and (last == label).all():
            break
        total = np.bincount(label, weight, len(centres))
        some = total > 0
        for axis in (0, 1):
            centres[some, axis] = np.bincount(label, weight * at[:, axis], len(centres))[some] / total[some]
    return label


def _place_blocks(spots: DataFrame, per_row: float, seed: int) -> DataFrame:
    """(cx, cy, _k) of every spot; each tile has its rows times ``per_row`` clusters, one at least."""
    z = spots.withColumn("_z", _along_curve(spots))
    tiles = max(1, spots.count() // TILE)
    dealt = bucketed(z, "_z", value_edges(z, "_z", tiles) if tiles > 1 else [], "_tile")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cx", "cy"])
        tile, weight = int(pdf["_tile"].iloc[0]), pdf["_n"].to_numpy()
        label = k_means(pdf[["cx", "cy"]].to_numpy(copy=True), weight, max(1, round(weight.sum() * per_row)), np.random.default_rng([seed, tile]))
        return pd.DataFrame({"cx": pdf["cx"], "cy": pdf["cy"], "_k": [f"{tile} {k}" for k in label]})

    return dealt.select("_tile", "cx", "cy", "_n").groupBy("_tile").applyInPandas(cut, "cx double, cy double, _k string")


def spatial_blocks(rows: DataFrame, *, seed: int = 0) -> DataFrame:
    """Rows plus ``block``: the zone of a positive, a k-means block of centroids for a negative.

    ``rows``: row_id, y, zone_id, cx, cy. The number of negative blocks is about
    the number of negatives over the mean number of rows of a zone. Positives
    without a zone are blocks of their own row; rows without a place share one
    block. Distinct centroids, weighted by their rows, are clustered inside
    tiles of about ``TILE`` of them: all centres against all rows would cost
    the square of the table. Only tile edges reach the driver.
    """
    zoned = (F.col("y") == 1) & F.col("zone_id").isNotNull()
    n = rows.agg(F.count(F.when(zoned, 1)).alias("pos"), F.count_distinct(F.when(zoned, F.col("zone_id"))).alias("zones")).first()
    placed = rows.where("y = 0 AND cx IS NOT NULL AND cy IS NOT NULL").groupBy("cx", "cy").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    spots = durable(placed)
    cluster = _place_blocks(spots, n["zones"] / n["pos"] if n["pos"] else 0.0, seed)
    own = F.when(zoned, F.concat(F.lit("zone "), F.col("zone_id").cast("string"))).when(
        F.col("y") == 1, F.concat(F.lit("row "), F.col("row_id").cast("string"))).when(
        F.col("_k").isNotNull(), F.concat(F.lit("place "), F.col("_k").cast("string"))).otherwise("no place")
    return rows.join(cluster, ["cx", "cy"], "left").select(*rows.columns, own.alias("block"))


def block_index(rows: DataFrame) -> DataFrame:
    """(y, block, idx, n_blocks): blocks of each class numbered from 0 in the order of their MD5.

    Windows hold the blocks of one of 4096 digest prefixes, or one row per prefix.
    """
    blocks = rows.select("y", "block").distinct().withColumn("_h", F.md5(F.col("block").cast("string"))).withColumn("_part", F.substring("_h", 1, 3))
    over = Window.partitionBy("y").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("y", "_part").agg(F.count(F.lit(1)).alias("_c")).select(
        "y", "_part", F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy("y")).alias("n_blocks"))
    inside = F.row_number().over(Window.partitionBy("y", "_part").orderBy("_h", "block")) - 1
    return blocks.withColumn("_i", inside).join(starts, ["y", "_part"]).select("y", "block", (F.col("_start") + F.col("_i")).alias("idx"), "n_blocks")


def _pick(seed: int) -> Column:
    """The block that a draw takes: 48 bits of an MD5 of seed, class, replicate and number of the draw."""
    text = F.concat_ws("|", F.lit(seed), F.col("y").cast("int"), F.col("replicate"), F.col("idx"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.col("n_blocks"))


def draw_table(rows: DataFrame, *, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(y, block, replicate, times), the last two arrays: in which replicates a block is drawn and how often.

    Each replicate draws as many blocks of a class as it has, with
    replacement. Written once, one row per block; a block never drawn is absent.
    """
    index = durable(block_index(rows))
    draws = index.select("y", "idx", "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    taken = draws.select("y", "replicate", _pick(seed).alias("idx")).groupBy("y", "idx", "replicate").agg(F.count(F.lit(1)).cast("int").alias("n"))
    # At most one entry per replicate.
    per = taken.groupBy("y", "idx").agg(F.array_sort(F.collect_list(F.struct("replicate", "n"))).alias("_d"))
    return durable(per.join(index, ["y", "idx"]).select("y", "block", F.col("_d.replicate").alias("replicate"), F.col("_d.n").alias("times")))


def _score_edges(rows: DataFrame, score: str, n: int, rows_per_bucket: int) -> list[float]:
    """Bucket edges; a score that fills a bucket alone gets one of its own, so that ties never need an order."""
    common = rows.groupBy(score).count().where(F.col("count") >= rows_per_bucket)
    hot = [r[0] for r in common.collect()]  # at most n / rows_per_bucket
    edges = value_edges(rows, score, max(8, n // rows_per_bucket))
    return sorted({*edges, *hot, *(float(np.nextafter(v, np.inf)) for v in hot)})


def replicate_scores(rows: DataFrame, score: str, draws: DataFrame, *, replicates: int = 1000, rows_per_bucket: int = 4000) -> DataFrame:
    """(replicate, pr_auc) of one score under the draws of ``draw_table``.

    ``rows``: y, block and the score. Rows stay in score buckets; each bucket
    reports its weighted counts per replicate (a crowded one in parts), running
    sums over buckets give the offsets, and a second pass adds up precision
    times recall steps where a bucket holds more than one score. Rows are never
    repeated per replicate. A replicate without a positive has no value.
    """
    src = rows.select("y", "block", F.col(score).cast("double").alias("p")).where("p IS NOT NULL")
    cut = durable(bucketed(src, "p", _score_edges(src, "p", src.count(), rows_per_bucket), "bucket")
                  .groupBy("bucket", "p", "y", "block").agg(F.count(F.lit(1)).alias("n")))
    sizes = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c"), (F.min("p") == F.max("p")).alias("tied"))
    parts = F.pmod(F.xxhash64("y", "block"), F.when(F.col("tied"), F.ceil(F.col("_c") / rows_per_bucket)).otherwise(1))
    dealt = durable(cut.join(sizes, "bucket").withColumn("part", parts).drop("_c"))

    def drawn(df: DataFrame) -> DataFrame:
        # Columns of their own: both sides of a cogroup stem from one table.
        keys = [F.col(c).alias(c) for c in ("bucket", "part", "y", "block")]
        return df.select(*keys).distinct().join(draws, ["y", "block"])

    def weighted(pdf: pd.DataFrame, table: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        at = {(y, b): i for i, (y, b) in enumerate(zip(table["y"], table["block"]))}
        times = np.zeros((len(at) + 1, replicates))
        for i, (r, w) in enumerate(zip(table["replicate"], table["times"])):
            times[i, r] = w
        row = np.fromiter((at.get(key, len(at)) for key in zip(pdf["y"], pdf["block"])), int, len(pdf))
        al = times[row] * pdf["n"].to_numpy()[:, None]
        return al * (pdf["y"].to_numpy() == 1)[:, None], al

    def totals(pdf: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"bucket": [], "tied": [], "replicate": [], "tp": [], "n": []})
        tp, al = weighted(pdf, table)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "tied": pdf["tied"].iloc[0], "replicate": np.arange(replicates),
                             "tp": tp.sum(0), "n": al.sum(0)})

    keys = ["bucket", "part"]
    some = dealt.groupBy(*keys).cogroup(drawn(dealt).groupBy(*keys)).applyInPandas(totals, "bucket double, tied boolean, replicate int, tp double, n double")
    sums = some.groupBy("bucket", "tied", "replicate").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    per = Window.partitionBy("replicate")
    before = per.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(sums.select(
        "bucket", "tied", "replicate", "tp", "n", F.coalesce(F.sum("tp").over(before), F.lit(0.0)).alias("tp0"),
        F.coalesce(F.sum("n").over(before), F.lit(0.0)).alias("n0"), F.sum("tp").over(per).alias("tp_all")))

    def steps(key, pdf: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        off, table = other[other["block"].isna()].sort_values("r"), other[other["block"].notna()]
        if pdf.empty:
            return pd.DataFrame({"replicate": [], "part": []})
        pdf = pdf.sort_values("p", ascending=False, kind="stable")
        tp, al = weighted(pdf, table)
        p = pdf["p"].to_numpy()
        last = np.r_[p[1:] != p[:-1], True]
        tp0, n0 = off["tp0"].to_numpy(), off["n0"].to_numpy()
        ctp, cn = np.cumsum(tp, 0)[last] + tp0, np.cumsum(al, 0)[last] + n0
        gain = np.diff(np.vstack([tp0[None, :], ctp]), axis=0)
        precision = np.divide(ctp, cn, out=np.zeros_like(ctp), where=cn > 0)
        return pd.DataFrame({"replicate": off["r"].to_numpy(), "part": (gain * precision).sum(0)})

    mixed = dealt.where("NOT tied")
    beside = drawn(mixed).drop("part").unionByName(
        offsets.where("NOT tied").select("bucket", F.col("replicate").alias("r"), "tp0", "n0"), allowMissingColumns=True)
    inner = mixed.groupBy("bucket").cogroup(beside.groupBy("bucket")).applyInPandas(steps, "replicate int, part double")
    alone = offsets.where("tied").select("replicate", F.coalesce(F.try_divide(
        F.col("tp") * (F.col("tp0") + F.col("tp")), F.col("n0") + F.col("n")), F.lit(0.0)).alias("part"))
    whole = offsets.groupBy("replicate").agg(F.max("tp_all").alias("tp_all"))
    return inner.unionByName(alone).groupBy("replicate").agg(F.sum("part").alias("s")).join(whole, "replicate").select(
        "replicate", F.try_divide(F.col("s"), F.col("tp_all")).alias("pr_auc"))


def difference_interval(rows: DataFrame, a: str, b: str, *, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """One row: median and 95 % interval of PR-AUC(a) - PR-AUC(b); both scores see the same draws."""
    draws = draw_table(rows, replicates=replicates, seed=seed)
    pa = replicate_scores(rows, a, draws, replicates=replicates).withColumnRenamed("pr_auc", "a")
    pb = replicate_scores(rows, b, draws, replicates=replicates).withColumnRenamed("pr_auc", "b")
    d = pa.join(pb, "replicate").select((F.col("a") - F.col("b")).alias("d"))
    # One value per replicate, a fixed number.
    q = d.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.count("d").alias("replicates"))
    out = q.select("replicates", F.col("q")[1].alias("median"), F.col("q")[0].alias("low"), F.col("q")[2].alias("high"))
    return out.withColumn("includes_zero", (F.col("low") <= 0) & (F.col("high") >= 0))
