"""Cases of the findings of round 3."""

import os
import random
from functools import partial
from threading import Barrier

import duckdb
from pyspark.sql import functions as F

from parcelgrid.operators import similar as SI
from parcelgrid.plans import bootstrap as B
from parcelgrid.plans.assess import score_ranks
from parcelgrid.session import durable, side_by_side
from parcelgrid.standins import Tables


def test_repetitive_tables_are_not_broadcast_by_file_size(spark, tmp_path):
    Tables(spark, str(tmp_path))
    wide = durable(spark.range(100_000).select("id", F.lit("x" * 200).alias("v")))
    path = wide._durable_path.replace("file:", "", 1)
    assert sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path)) < 10 * 2**20
    joined = wide.join(wide.select("id", F.col("v").alias("w")), "id")
    assert joined.count() == 100_000
    joined.collect()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_top_percent_rounds_halves_as_the_sql_does(spark):
    rows = spark.range(2000).select(F.col("id").alias("pnu"), F.col("id").cast("double").alias("score"))
    got = {r.pnu: r.rank_top_pct for r in score_ranks(rows).collect()}
    want = duckdb.sql("SELECT i, round(100 * (1 - i / 2000), 1) FROM range(2000) r(i)").fetchall()
    assert got == dict(want) and got[901] == 55.0


def test_fits_run_side_by_side_and_keep_their_order(spark):
    meet = Barrier(3, timeout=60)

    def fit(k):
        meet.wait()
        return spark.range(k).count()

    assert side_by_side(spark, [partial(fit, k) for k in (5, 3, 4)]) == [5, 3, 4]
    assert side_by_side(spark, []) == []


def test_blocks_of_negatives_are_clustered_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(B, "TILE", 64)
    rows = [(f"p{i}", 1, f"z{i % 20}", float(i), -5000.0) for i in range(160)] + [(f"n{i}", 0, None, 20.0 * (i % 25), 20.0 * (i // 25)) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id string, y int, zone_id string, cx double, cy double")
    got = {r.row_id: r.block for r in B.spatial_blocks(df).collect()}
    blocks = {}
    for name, _, _, x, y in rows[160:]:
        blocks.setdefault(got[name], []).append((x, y))
    assert len(got) == 1160 and len({b.split()[1] for b in blocks}) > 8
    # A zone has 8 rows, so 125 blocks are asked for; each is one neighbourhood.
    assert 110 <= len(blocks) <= 140
    assert sum(max(x for x, _ in b) - min(x for x, _ in b) <= 160 and max(y for _, y in b) - min(y for _, y in b) <= 160 for b in blocks.values()) > 0.9 * len(blocks)
    assert got == {r.row_id: r.block for r in B.spatial_blocks(df).collect()}


def test_a_query_is_shuffled_once_for_each_bundle_of_clusters_it_sees(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)]
    v = spark.createDataFrame(rows, "i long, v array<double>").select("i", SI.unit(F.col("v")).alias("cv"))
    placed, shapes = SI.clustered(v.withColumnRenamed("i", "case_id"), 10)
    known = shapes.collect()
    bundle = SI.bundles(known, 100)
    assert sum(r["n"] for r in known) == 200 and len(set(bundle)) <= 3
    asked = v.selectExpr("i AS query_id", "cv AS qv", "-2D AS floor")
    seen = SI._with_seen(asked, known, bundle)
    left, right = SI._in_parts(seen, placed, bundle, 1000)
    # Every query sees nine clusters, in at most three copies; so does every case.
    assert SI.cluster_visits(asked, known).count() == 200 * (len(known) - 1)
    assert left.count() <= 3 * 200 and right.count() == 200
    assert left.selectExpr("sum(size(see)) AS n").first()["n"] == 200 * (len(known) - 1)
