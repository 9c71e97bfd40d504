import random

import pytest
from pyspark.sql import functions as F

from parcelgrid.plans import assess as AS, bootstrap as B, folds as K, models as MO
from parcelgrid.sources import cleaning as C, readers as IO, sinks


def test_folds_keep_test_apart(spark):
    rows = spark.createDataFrame([("a", "a", "1", 0., 0.), ("b", "b", "2", 900., 0.), ("c", "c", "2", 5., 0.), ("d", "d", "2", 900., 900.)],
                                 "row_id string, pnu string, sigungu string, x double, y double")
    edges = spark.createDataFrame([("a", "d"), ("d", "a")], "src string, dst string")
    f = K.buffered(K.district_folds(rows), rows, edges, hops=1, buffer_m=200.0).where("fold = '1'").collect()
    got = {r["row_id"]: (r["role"], r["in_hop"], r["in_geom"]) for r in f}
    assert got == {"a": ("test", False, False), "b": ("train", False, False), "c": ("train", False, True), "d": ("train", True, False)}


def test_zones_are_never_split(spark):
    rows = [(f"r{i}", 1, "z1" if i < 5 else "z2", float(i % 5) + (0 if i < 5 else 9000), 0.0) for i in range(10)]
    rows += [("n1", 0, None, 100.0, 0.0), ("n2", 0, None, 8000.0, 0.0)]
    g = K.zone_groups(spark.createDataFrame(rows, "row_id string, y int, zone_id string, cx double, cy double"), k=2).collect()
    by = {r["row_id"]: r["group"] for r in g}
    assert len(by) == 12 and len({by[f"r{i}"] for i in range(5)}) == 1 and by["r0"] != by["r9"] and by["n1"] == by["r0"] and by["n2"] == by["r9"]


def test_calibration_is_monotone_and_clipped(spark):
    rng = random.Random(0)
    oof = spark.createDataFrame([(p, int(rng.random() < p)) for p in [rng.random() for _ in range(300)]], "p double, y int")
    new = spark.createDataFrame([(v / 20,) for v in range(-4, 25)], "p double")
    out = [r["calibrated"] for r in MO.calibrate(oof, new).orderBy("p").collect()]
    assert out == sorted(out) and 0 <= out[0] and out[-1] <= 1


def test_boosting_is_repeatable_and_learns(spark):
    rows = spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + (F.col("id") % 5) / 10).alias("f"), F.lit(1.0).alias("g"))
    a, b = (MO.scored(MO.fit_classifier(rows, ["f", "g"], rounds=3), rows).groupBy("y").agg(F.avg("p").alias("p")).collect() for _ in range(2))
    pa, pb = {r["y"]: r["p"] for r in a}, {r["y"]: r["p"] for r in b}
    assert pa == pb and pa[1] > pa[0] + 0.3


@pytest.mark.parametrize("rows_per_bucket", [5, 20, 4000])
def test_bootstrap_matches_direct_resampling(spark, rows_per_bucket):
    rng = random.Random(7)
    rows = [(int(rng.random() < .4), f"b{rng.randrange(6)}", rng.choice([.5, round(rng.random(), 2)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, block string, s double")
    draws = B.draw_table(df, replicates=5)
    got = {r["replicate"]: r["pr_auc"] for r in B.replicate_scores(df, "s", draws, replicates=5, rows_per_bucket=rows_per_bucket).collect()}
    w = {(r["y"], r["block"], rep): n for r in draws.collect() for rep, n in zip(r["replicate"], r["times"])}
    for rep in range(5):
        for y in (0, 1):
            assert sum(n for (k, _, at), n in w.items() if k == y and at == rep) == len({b for k, b, _ in rows if k == y})
        weighted = [(s, y, w.get((y, b, rep), 0)) for y, b, s in rows]
        total, tp, n, ap = sum(k for _, y, k in weighted if y), 0, 0, 0.0
        for s in sorted({s for s, _, _ in weighted}, reverse=True):
            gain = sum(k for v, y, k in weighted if v == s and y)
            tp, n = tp + gain, n + sum(k for v, _, k in weighted if v == s)
            ap += gain / total * (tp / n if n else 0)
        assert got[rep] == pytest.approx(ap)


def test_spatial_blocks_keep_zones_and_match_their_size(spark):
    rows = [(f"p{i}", 1, f"z{i % 2}", float(i), 0.0) for i in range(8)] + [(f"u{i}", 1, None, 0.0, 0.0) for i in range(2)]
    rows += [(f"n{i}", 0, None, 1000.0 * (i // 4), float(i % 4)) for i in range(12)] + [("x", 0, None, None, None)]
    out = {r["row_id"]: r["block"] for r in B.spatial_blocks(spark.createDataFrame(rows, "row_id string, y int, zone_id string, cx double, cy double")).collect()}
    assert len(out) == len(rows) and {out[f"p{i}"] for i in range(8)} == {"zone z0", "zone z1"} and out["u0"] != out["u1"]
    places = [{out[f"n{i}"] for i in range(4 * g, 4 * g + 4)} for g in range(3)]
    assert all(len(p) == 1 for p in places) and len(set.union(*places)) == 3 and out["x"] == "no place"


def test_bootstrap_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(0, "b", .5), (0, "c", .25)], "y int, block string, s double")
    assert {r["pr_auc"] for r in B.replicate_scores(df, "s", B.draw_table(df, replicates=3), replicates=3).collect()} == {None}
    none = df.limit(0)
    assert B.replicate_scores(none, "s", B.draw_table(none, replicates=3), replicates=3).count() == 0


def test_verdict_and_report(spark):
    row = spark.range(1)
    facts = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in {
        "candidate_note": None, "rule_result": "재개발", "old_ratio": "노후·불량 연면적 94%", "abut_ratio": None, "price_context": "시세 산출 불가",
        "plan_info": None, "remaining": None, "stage_state": None, "similar_case": None, "social_signal": "신호 없음", "permit": None}.items()])
    text = row.select(AS.report_text(facts)).first()[0]
    assert text == "### 될까\n재개발. 노후·불량 연면적 94%\n### 얼마\n시세 산출 불가\n### 리스크\n신호 없음"
    v = row.select(AS.verdict(F.lit(False), F.lit(False), F.lit(8.0), F.lit("상위 8.0%")).alias("v")).first()["v"]
    assert v["class"] == "관심(경계 밖)" and "상위 8.0%" in v["headline"]


def test_xml_trades_and_scan_pushdown(spark, tmp_path):
    items = "".join(f"<item><umdNm>석관동</umdNm><jibun>338-505</jibun><sggCd>11290</sggCd><dealAmount>32,500</dealAmount><excluUseAr>30</excluUseAr>"
                    f"<landAr>-</landAr><buildYear>1999</buildYear><dealYear>2024</dealYear><dealMonth>{m}</dealMonth><cdealType>{c}</cdealType></item>"
                    for m, c in (("3", ""), ("4", "O")))
    (tmp_path / "villa_11290_202403.xml").write_text(f"<response><body><items>{items}</items></body></response>", encoding="utf-8")
    idx = spark.createDataFrame([("11290", "석관동", 338, 505, "P1")], "sigungu string, dong string, main_no long, sub_no long, pnu string")
    rows = C.clean_trades(IO.read_trade_items(spark, str(tmp_path)), idx).collect()
    assert [(r["pnu"], r["trade_type"], r["deal_amount"], r["land_share_m2"], r["deal_ym"]) for r in rows] == [("P1", "villa", 32500, None, "202403")]
    raw = spark.createDataFrame([("1", "a", "1", "1대", "11290", "junk")], "A1 string, A3 string, A4 string, A5 string, A7 string, Z string")
    raw.write.parquet(str(tmp_path / "parcels"))
    scan = IO.read_parcels(spark, str(tmp_path / "parcels"), ["11290"], with_geometry=False)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(A7" in plan or "EqualTo(A7,11290)" in plan
    assert "Z:string" not in plan


def test_korean_csv(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes("역사명,호선\n정릉,우이신설선\n".encode("cp949"))
    row = IO.read_text_csv(spark, str(tmp_path / "k.csv"), ["역사명", "호선"], korean=True).first()
    assert tuple(row) == ("정릉", "우이신설선")


def test_store_skips_known_and_guards_ranges(spark):
    rows = spark.createDataFrame([("z1", "a", "용적률", "250%"), ("z2", "b", "용적률", "9000%")], "zone_id string, zone_name string, attr string, raw string")
    e = sinks.manual_entries(rows)
    assert {r["zone_id"]: r["attrs"]["용적률"]["grade"] for r in e.collect()} == {"z1": "manual_verified", "z2": "flagged"}
    assert sinks.pending(rows, e.where("zone_id = 'z1'")).count() == 1
    assert sinks.upserted(e, e).count() == 2


def test_cluster_needs_shared_scratch(spark):
    from parcelgrid.session import scratch_root

    assert scratch_root(spark)
