"""Cases that used to be cut off or to land in one task."""

from pyspark.sql import functions as F

from parcelgrid.functions.text import focus_text
from parcelgrid.operators.cells import nearest_site
from parcelgrid.operators.keyed import match_left
from parcelgrid.operators.ranks import with_percentile
from parcelgrid.sources.sinks import ATTRS_TYPE, materialised, store_entries, upserted


def test_focus_text_keeps_long_texts_whole(spark):
    text = "\n".join(["plain line"] * 3000)
    row = spark.createDataFrame([(text, "용적률 " + "x" * 20_000)], "a string, b string").select(
        focus_text(F.col("a")).alias("a"), focus_text(F.col("b")).alias("b"), focus_text(F.col("a"), max_chars=50).alias("c")).first()
    assert row.a == text and len(row.b) > 20_000 and len(row.c) == 50


def test_nearest_site_is_found_however_far(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e7, 0.0)], "id int, x double, y double")
    sites = spark.createDataFrame([("a", 6e7, 8.0), ("b", -5e7, 0.0)], "name string, sx double, sy double")
    got = {r.id: r.name for r in nearest_site(points, sites, point_id=["id"], payload=["name"]).collect()}
    assert got == {1: "b", 2: "a"}
    one = nearest_site(points.where("id = 1").select("id", "x", "y"), spark.createDataFrame([(0.0, 0.0)], "sx double, sy double"), point_id=["id"])
    assert one.first().dist == 0.0


def test_null_keys_are_dealt_over_tasks(spark):
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled",
                                                "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("-1", "false", "16")):
            spark.conf.set(k, v)
        left = spark.range(20_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id END AS k")
        right = spark.range(0, 20_000, 20).selectExpr("id AS k", "1 AS v")
        out = match_left(left, right, ["k"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / 16
        assert out.where("v = 1").count() == 1000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_percentiles_of_one_common_value(spark, monkeypatch):
    from parcelgrid.operators import keyed

    monkeypatch.setattr(keyed, "ROWS_PER_TASK", 10)
    rows = spark.range(500).selectExpr("id", "'g' AS g", "CASE WHEN id % 5 = 0 THEN id * 1.0 WHEN id % 7 = 0 THEN NULL ELSE 0.0 END AS v")
    got = {r.id: r.pct for r in with_percentile(rows, ["g"], "v", "pct").collect()}
    known = {r.id: float(r.v) for r in rows.collect() if r.v is not None}
    for i in (0, 1, 5, 7, 495):
        v = known.get(i)
        want = None if v is None else (sum(x < v for x in known.values()) + (sum(x == v for x in known.values()) + 1) / 2) / len(known)
        assert got[i] == want or abs(got[i] - want) < 1e-12


def test_store_takes_repeated_attributes_and_is_written_by_partition(spark, tmp_path):
    rows = [("Z1", "a", "용적률", "230%", 230.0, "용적률", "flagged"), ("Z1", "a", "용적률", "250%", 250.0, "용적률", "verified"),
            ("Z1", "a", "건폐율", "40", 40.0, "건폐율", "flagged"), ("Z2", "b", "용적률", None, None, "용적률", "missing")]
    verified = spark.createDataFrame(rows, "zone_id string, zone_name string, attr string, raw string, value double, label string, grade string")
    store = store_entries(verified, ["zone_id", "zone_name"])
    got = {r.zone_id: r.attrs for r in store.collect()}
    assert got["Z1"]["용적률"].value == 250.0 and got["Z1"]["건폐율"].value == 40.0 and got["Z2"] == {}
    again = materialised(spark, str(tmp_path / "store"), lambda: store, partition_by=["zone_name"])
    assert dict(again.dtypes)["attrs"] == ATTRS_TYPE and again.count() == 2
    merged = upserted(store, store.withColumn("zone_name", F.lit("new")), replace=True)
    assert {r.zone_name for r in merged.collect()} == {"new"}
