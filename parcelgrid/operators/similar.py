"""Similar past zones: standardised vectors and exact cosine top-k."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from parcelgrid import settings as S
from parcelgrid.operators.keyed import first_per_key
from parcelgrid.session import durable

AXES = [a for a, _ in S.SIMILARITY_AXES]
AXIS_NAMES = [n for _, n in S.SIMILARITY_AXES]
#: Queries whose products with a block of cases a task takes together.
AT_ONCE = 512
#: Most bytes of vectors on one side of a task.
PART_BYTES = 32 << 20


def unit(vec: Column) -> Column:
    """Vector over its length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(vec, lambda v: v / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def axis_stats(zones: DataFrame, axes: list[str] = AXES) -> DataFrame:
    """One row: mean and population deviation per axis; a constant axis gets 1."""
    return zones.agg(
        *[F.avg(a).alias(f"m_{a}") for a in axes],
        *[F.when(F.coalesce(F.stddev_pop(a), F.lit(0.0)) == 0, 1.0).otherwise(F.stddev_pop(a)).alias(f"s_{a}")
          for a in axes],
    )


def standardized(rows: DataFrame, stats: DataFrame, axes: list[str] = AXES, out: str = "vec") -> DataFrame:
    """Rows plus a unit vector of standardised axes; unknown values sit at the mean.

    ``stats`` is the single row of ``axis_stats``.
    """
    one = F.lit(1).alias("_k")
    z = [F.coalesce((F.col(a) - F.col(f"m_{a}")) / F.col(f"s_{a}"), F.lit(0.0)) for a in axes]
    return rows.select("*", one).join(F.broadcast(stats.select("*", one)), "_k").select(
        *rows.columns, unit(F.array(*z)).alias(out))


def display_names(members: DataFrame, parcels: DataFrame, years: DataFrame) -> DataFrame:
    """(zone_id, display_name): most frequent address of a zone without the city, and its year.

    Equally frequent addresses fall to the first in text order.
    """
    addr = parcels.select("pnu", F.trim("dong_addr").alias("_a")).where("_a <> ''")
    counts = members.select("zone_id", "pnu").join(addr, "pnu").groupBy("zone_id", "_a").agg(
        F.count(F.lit(1)).alias("_n"))
    top = first_per_key(counts, ["zone_id"], [-F.col("_n"), F.col("_a")])
    label = F.when(F.col("_a").rlike("^서울"), F.regexp_replace("_a", r"^\S+\s*", "")).otherwise(F.col("_a"))
    return members.select("zone_id").distinct().join(top, "zone_id", "left").join(years, "zone_id", "left").select(
        "zone_id",
        F.when(F.col("_a").isNotNull(), F.concat(
            label, F.lit(" 일대"),
            F.when(F.col("t").isNotNull(), F.concat(F.lit(" ("), F.col("t").cast("string"), F.lit(")"))).otherwise(""),
        )).alias("display_name"))


def zone_vectors(metrics: DataFrame, *, completed_cut: float = S.MIN_OLD_RATIO_FOR_POSITIVE) -> DataFrame:
    """Zone metrics to (zone_id, vec, completed)."""
    done = F.coalesce(F.col("old_area_ratio") < completed_cut, F.lit(False))
    return standardized(metrics, axis_stats(metrics)).select("zone_id", "vec", done.alias("completed"))


def clustered(cases: DataFrame, clusters: int, *, fit_rows: int = 100_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((case_id, cv, cluster) of all cases, (cluster, axis, low, high, off, n) of the clusters that hold any).

    ``cases``: case_id, cv. ``clusters`` centres are fitted on at most about
    ``fit_rows`` cases picked by a hash; every case goes to one of them.
    ``axis`` is the centre's direction, ``low`` to ``high`` the members'
    lengths along it, ``off`` their longest distance from it and ``n`` their number.
    """
    share = min(1.0, fit_rows / max(cases.count(), 1))
    rows = cases.withColumn("_v", array_to_vector("cv"))
    picked = rows.where(F.pmod(F.xxhash64("case_id", F.lit(seed)), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    model = KMeans(k=clusters, seed=seed, maxIter=5, featuresCol="_v", predictionCol="cluster").fit(picked)
    placed = durable(model.transform(rows).select("case_id", "cv", "cluster"))
    centres = cases.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, axis array<double>")
    # One row per centre, of which there are ``clusters``.
    near = placed.join(F.broadcast(centres.withColumn("axis", unit(F.col("axis")))), "cluster")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    along = near.select("cluster", "axis", dot("axis", "cv").alias("_a"), dot("cv", "cv").alias("_n"))
    off = F.sqrt(F.greatest(F.col("_n") - F.col("_a") * F.col("_a"), F.lit(0.0)))
    return placed, along.groupBy("cluster", "axis").agg(F.min("_a").alias("low"), F.max("_a").alias("high"), F.max(off).alias("off"), F.count(F.lit(1)).alias("n"))


def bundles(shapes: list[Row], rows: int) -> list[int]:
    """Bundle of each cluster by its number: clusters side by side, of about ``rows`` cases together."""
    out, before = [0] * (1 + max(r["cluster"] for r in shapes)), 0
    for r in sorted(shapes, key=lambda r: list(r["axis"])):
        out[r["cluster"]] = before // rows
        before += r["n"]
    return out


def _with_seen(queries: DataFrame, shapes: list[Row], bundle: list[int]) -> DataFrame:
    """``queries`` (query_id, qv, floor) plus ``see``: the clusters to see, a list for each bundle that holds any."""
    shapes = sorted(shapes, key=lambda r: bundle[r["cluster"]])
    number = np.array([r["cluster"] for r in shapes], np.int32)
    at_bundle = np.array(bundle)[number]
    axis = np.array([r["axis"] for r in shapes], float)
    low, high, off = (np.array([r[c] for r in shapes], float) for c in ("low", "high", "off"))

    def split(mask: np.ndarray) -> list[np.ndarray]:
        mine, where = number[mask], at_bundle[mask]
        return np.split(mine, np.flatnonzero(where[1:] != where[:-1]) + 1) if len(mine) else []

    def seen(vec: pd.Series, floor: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(vec), 1024):
            q = np.stack(vec.iloc[at:at + 1024].to_numpy()).astype(float)
            least = floor.iloc[at:at + 1024].to_numpy(float)
            along = q @ axis.T
            home = along.argmax(axis=1)
            aside = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - along * along, 0.0))
            bound = np.maximum(along * low, along * high) + aside * off
            # The margin is far above rounding and only adds visits.
            reach = bound + 1e-6 >= least[:, None]
            reach[np.arange(len(q)), home] = False
            out += [[number[[h]]] if np.isnan(f) else split(r) for h, f, r in zip(home, least, reach)]
        return pd.Series(out)

    return queries.withColumn("see", F.pandas_udf(seen, "array<array<int>>")("qv", "floor")).drop("floor")


def cluster_visits(queries: DataFrame, shapes: list[Row]) -> DataFrame:
    """``queries`` (query_id, qv, floor) plus ``cluster``: a row for each cluster the query has to see.

    Without a floor that is its home, the cluster whose axis is nearest. With
    one it is each other cluster that may hold a case of at least that
    similarity: by Cauchy and Schwarz off the axis, no member's product is above
    (q . axis) times its length along the axis plus |q off axis| times ``off``.
    """
    seen = _with_seen(queries, shapes, [0] * (1 + max(r["cluster"] for r in shapes)))
    return seen.withColumn("cluster", F.explode(F.flatten("see"))).drop("see")


def _parts(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def _numbers(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _in_parts(q: DataFrame, c: DataFrame, bundle: list[int], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (bundle, qb, cb): each bundle's rows cut by a hash into parts of about ``rows``.

    ``q``: query_id, qv, see; ``c``: case_id, cv, cluster. A query is there once
    for each bundle it looks into (not once a cluster) and each part of it.
    """
    of = F.array(*[F.lit(b) for b in bundle])

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    q = q.withColumn("see", F.explode("see")).withColumn("bundle", F.get(of, F.get("see", F.lit(0))))
    c = c.withColumn("bundle", F.get(of, F.col("cluster")))
    # One row per bundle.
    sizes = F.broadcast(parts(q, "nq").join(parts(c, "nc"), "bundle"))
    nq, nc = F.col("nq"), F.col("nc")
    return (q.join(sizes, "bundle").select("query_id", "qv", "see", "bundle", _parts("query_id", nq).alias("qb"), _numbers(nc).alias("cb")),
            c.join(sizes, "bundle").select("case_id", "cv", "cluster", "bundle", _parts("case_id", nc).alias("cb"), _numbers(nq).alias("qb")))


def _best_in_parts(left: DataFrame, right: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, case_id, similarity): up to ``k`` best cases of a query in each part it meets.

    A part is large, so that few copies are shuffled; its products are taken
    for ``AT_ONCE`` queries and ``block`` cases of one cluster at a time.
    """
    def leading(row: np.ndarray, key: np.ndarray, tie: np.ndarray, count: int) -> np.ndarray:
        """Places of the ``count`` entries of each row with the largest key, the smaller tie first."""
        order = np.lexsort((tie, -key, row))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(row[order]) != 0))) if len(order) else np.zeros(0, int)
        number = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        return order[number < count]

    # What tasks use stands in here, so that workers need not import this module.
    at_once = AT_ONCE

    def best(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or cs.empty:
            return pd.DataFrame({"query_id": [], "case_id": [], "similarity": []})
        cs = cs.sort_values(["cluster", "case_id"], kind="stable")
        ids, cluster = cs["case_id"].to_numpy(), cs["cluster"].to_numpy()
        tie = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        held = np.stack(cs["cv"].to_numpy()).astype(float)
        first = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1])))
        cuts = [(cluster[a], s, min(s + block, b)) for a, b in zip(first, [*first[1:], len(cluster)]) for s in range(a, b, block)]
        done = []
        for at in range(0, len(qs), at_once):
            some = qs.iloc[at:at + at_once]
            vec = np.stack(some["qv"].to_numpy()).astype(float)
            flat = np.concatenate(some["see"].to_numpy())
            owner = np.repeat(np.arange(len(some)), some["see"].map(len).to_numpy())
            row, place, sim, key = [], [], [], []
            for number, a, b in cuts:
                mine = owner[flat == number]
                sims = vec[mine] @ held[a:b].T
                # Rounding makes ties exact before they are broken by id.
                keys = np.round(sims, 12)
                some_k = min(k, b - a)
                near = keys >= np.partition(keys, b - a - some_k, axis=1)[:, b - a - some_k, None]
                i, j = np.nonzero(near)
                i, j = (x[p] for x in (i, j) for p in [leading(i, keys[near], j, k)])
                row.append(mine[i])
                place.append(a + j)
                sim.append(sims[i, j])
                key.append(keys[i, j])
            row, place, sim, key = map(np.concatenate, (row, place, sim, key))
            lead = leading(row, key, tie[place], k)
            done.append((some["query_id"].to_numpy()[row[lead]], ids[place[lead]], sim[lead]))
        query, case, sim = map(np.concatenate, zip(*done))
        return pd.DataFrame({"query_id": query, "case_id": case, "similarity": sim})

    schema = T.StructType([left.schema["query_id"], right.schema["case_id"], T.StructField("similarity", T.DoubleType())])
    keys = ["bundle", "qb", "cb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query, with ``rank``."""
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 12).desc(), "case_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_topk(queries: DataFrame, cases: DataFrame, *, k: int = 3, block_rows: int = 4096, most_clusters: int = 1024) -> DataFrame:
    """(query_id, case_id, similarity, rank): exact best k cases of each query.

    ``vec`` must be unit vectors (or zero), ids unique. Cases are clustered by
    direction. A query first meets the cluster nearest to it, which gives it a
    k-th best similarity; of the others it meets only those that can hold a
    case as good (``cluster_visits``), so the answer is that of all pairs.
    Vectors without clusters make it meet them all. Clusters go to tasks in
    bundles, so a query is shuffled once for each bundle it looks into; a bundle
    has up to 16 times ``block_rows`` cases, fewer where that would leave
    executors idle or pass ``PART_BYTES``. Products are taken block by block and
    k rows kept per query, so pairs are never emitted. Up to ``block_rows``
    cases are one cluster; ``most_clusters`` bounds what reaches the driver, and
    larger clusters are cut into parts. Ties fall to the smaller case id. No
    cases or no queries give no rows.
    """
    # Own names on each side: both may stem from one table.
    q = queries.select("query_id", F.col("vec").alias("qv"))
    c = cases.select("case_id", F.col("vec").alias("cv"))
    n = c.count()
    clusters = min(most_clusters, -(-n // block_rows))
    if clusters < 2:
        nq, one = F.lit(max(1, -(-q.count() // block_rows))), F.lit(0)
        left = q.withColumns({"see": F.array(one), "bundle": one, "qb": _parts("query_id", nq), "cb": one})
        return _first_k(_best_in_parts(left, c.withColumns({"cluster": one, "bundle": one, "qb": _numbers(nq), "cb": one}), k, block_rows), k)
    placed, shapes = clustered(c, clusters)
    known = shapes.collect()
    sides = math.ceil(math.sqrt(4 * c.sparkSession.sparkContext.defaultParallelism))
    rows = max(block_rows, min(16 * block_rows, PART_BYTES // (8 * len(known[0]["axis"])), n // sides))
    bundle = bundles(known, rows)
    home = _with_seen(q.withColumn("floor", F.lit(None).cast("double")), known, bundle)
    first = durable(_first_k(_best_in_parts(*_in_parts(home, placed, bundle, rows), k, block_rows), k))
    # A home with fewer than k cases sets no floor: -2 is below any product of unit vectors.
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(-2.0)).alias("floor"))
    visits = durable(_with_seen(q.join(floors, "query_id"), known, bundle))
    others = _best_in_parts(*_in_parts(visits, placed, bundle, rows), k, block_rows)
    return _first_k(first.drop("rank").union(others), k)


def with_top_axes(matches: DataFrame, queries: DataFrame, cases: DataFrame, names: list[str] = AXIS_NAMES,
                  top: int = 2) -> DataFrame:
    """Matches plus the names of the axes that add most to the similarity."""
    m = matches.join(queries.select("query_id", F.col("vec").alias("_q")), "query_id").join(
        cases.select("case_id", F.col("vec").alias("_c")), "case_id")
    parts = F.zip_with("_q", "_c", lambda a, b: a * b)
    named = F.transform(parts, lambda v, i: F.struct((-v).alias("o"), i.alias("i")))
    best = F.slice(F.filter(F.array_sort(named), lambda s: s["o"] < 0), 1, top)
    labels = F.array(*[F.lit(n) for n in names])
    return m.withColumn("top_axes", F.transform(best, lambda s: F.get(labels, s["i"]))).drop("_q", "_c")


def by_recency(matches: DataFrame) -> DataFrame:
    """The same matches ordered newest first within a query, undated ones last."""
    w = Window.partitionBy("query_id").orderBy(F.col("t").desc_nulls_last(), F.col("rank"))
    return matches.withColumn("recency_rank", F.row_number().over(w))


def list_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two ranked lists (query_id, case_id, rank): overlap, same first, first difference.

    One row per query; ``diverges_at`` is null for equal lists.
    """
    both = a.select("query_id", "case_id", F.col("rank").alias("ra")).join(
        b.select("query_id", "case_id", F.col("rank").alias("rb")), ["query_id", "case_id"], "full")
    rank = F.least(F.coalesce("ra", "rb"), F.coalesce("rb", "ra"))
    differs = ~F.col("ra").eqNullSafe(F.col("rb"))
    return both.groupBy("query_id").agg(
        F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1)).alias("n_shared"),
        F.coalesce(F.max(((F.col("ra") == 1) & (F.col("rb") == 1)).cast("int")), F.lit(0)).alias("same_first"),
        F.min(F.when(differs, rank)).alias("diverges_at"),
    )


def vector_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """(zone_id, shift): Euclidean distance of a zone's vector between two builds."""
    both = a.select("zone_id", F.col("vec").alias("_a")).join(b.select("zone_id", F.col("vec").alias("_b")), "zone_id")
    return both.select("zone_id", F.sqrt(F.aggregate(
        F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)).alias("shift"))
