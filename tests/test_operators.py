import random
import statistics

import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import shapes
from parcelgrid.operators import asof, graph as G, matching as M, metrics as E, prices as P, ranks, rules as R, similar as SI, verify as V
from parcelgrid.plans import features as FE, labels as L

BUILDINGS = "pnu string, approval_year int, structure string, gross_floor_area double"
ROWS = [("A", 1985, "other", 100.0), ("A", 1990, "rc", 100.0), ("A", 2024, "rc", 400.0), ("A", 2025, "rc", 400.0), ("F", 2024, "rc", 50.0)]


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_old_ratio_as_of(spark):
    stock = asof.building_stock(spark.createDataFrame(ROWS, BUILDINGS))
    at = {t: dict(pairs(asof.old_ratio_by_parcel(stock, t), "pnu", "old_ratio")) for t in (2021, 2026)}
    assert at[2021]["A"] == 1.0 and "F" not in at[2021]
    assert at[2026]["A"] < 1.0 and at[2026]["F"] == 0.0
    members = spark.createDataFrame([("A", "A"), ("F", "F"), ("N", "N")], "group_id string, pnu string")
    group = dict(pairs(asof.old_ratio_of_groups(stock, members, 2026), "group_id", "old_ratio"))
    assert group["A"] == at[2026]["A"] and group["F"] == 0.0 and group["N"] is None


def test_old_ratio_of_group_falls_back_to_counts(spark):
    stock = asof.building_stock(spark.createDataFrame([("A", 1980, "rc", None), ("A", 2020, "rc", 900.0)], BUILDINGS))
    m = spark.createDataFrame([("g", "A")], "group_id string, pnu string")
    assert asof.old_ratio_of_groups(stock, m, 2026).first()["old_ratio"] == 0.5
    assert asof.old_ratio_by_parcel(stock, 2026).first()["old_ratio"] == 0.0


def test_land_price_as_of(spark):
    pct = spark.createDataFrame([(2008, "A", .9), (2026, "B", .5)], "year int, pnu string, pct double")
    rows = spark.createDataFrame([("A", 2008), ("B", 2026), ("B", 2030), ("X", 2026)], "pnu string, t int")
    out = {(r["pnu"], r["t"]): (r["land_pct"], r["land_missing"]) for r in asof.land_price_as_of(rows, pct).collect()}
    assert out == {("A", 2008): (.9, 0), ("B", 2026): (.5, 0), ("B", 2030): (.5, 0), ("X", 2026): (.5, 1)}


def test_station_not_open_yet_is_invisible(spark):
    st = spark.createDataFrame([(1000.0, 0.0, 2000, "pre2001"), (0.0, 0.0, 2017, "compiled")], "x double, y double, open_year int, open_source string")
    pt = spark.createDataFrame([("A", 1.0, 1.0)], "pnu string, x double, y double")
    rows = spark.createDataFrame([("A", 2010), ("A", 2020), ("A", 1990)], "pnu string, t int")
    d = {r["t"]: r["rail_dist_m"] for r in asof.rail_as_of(rows, pt, st).collect()}
    assert d[2010] > 900 and d[2020] < 100 and d[1990] is None


def test_zoning_takes_the_most_specific_class(spark):
    z = spark.createDataFrame([("도시지역", 0., 9.), ("제2종일반주거지역", 0., 9.), ("자연녹지지역", 20., 29.)], "a6 string, a double, b double")
    z = z.select("a6", shapes.box(F.col("a"), F.lit(0.0), F.col("b"), F.lit(9.0)).alias("rings"))
    pts = spark.createDataFrame([("A", 5., 5.), ("B", 25., 5.), ("C", 90., 5.)], "pnu string, x double, y double")
    out = {r["pnu"]: (r["zoning_ord"], r["zoning_missing"]) for r in FE.zoning_at(pts, z).collect()}
    assert out == {"A": (4.0, 0), "B": (0.0, 0), "C": (0.0, 1)}


def test_price_levels(spark):
    pts = spark.createDataFrame([("1100000000A", 0., 0.), ("1100000000B", 1000., 0.), ("1200000000C", 9000., 0.)], "pnu string, x double, y double")
    tr = spark.createDataFrame([("1100000000A", "villa", 33000.0, 30.0, 202501), ("1100000000A", "villa", 1.0, None, 202501),
                                ("1100000000A", "apt", 9.0, 1.0, 202501)], "pnu string, trade_type string, deal_amount double, land_share_m2 double, deal_ym int")
    out = {r["pnu"][-1]: (r["target_pyung"], r["agg_level"], r["n_trades"]) for r in P.price_target(pts, tr, current_ym=202601).collect()}
    price = 33000 / (30 / 3.305785)
    assert out["A"] == (pytest.approx(price), "r50", 1) and out["B"] == (pytest.approx(price), "dong", 1) and out["C"] == (None, "missing", 0)


EDGES = [("0", "1"), ("1", "0"), ("1", "2"), ("2", "1"), ("2", "3"), ("3", "2")]


def test_neighbour_aggregates_and_closure(spark):
    e = spark.createDataFrame(EDGES[:4], "src string, dst string")
    v = spark.createDataFrame([("0", 1.0), ("1", 2.0), ("2", 4.0), ("9", 7.0)], "pnu string, f double")
    out = {r["pnu"]: (r["nb1_mean_f"], r["nb1_max_f"]) for r in G.neighbour_features(v.select("pnu"), v, e, ["f"], hops=1).collect()}
    assert out == {"0": (2.0, 2.0), "1": (2.5, 4.0), "2": (2.0, 2.0), "9": (0.0, 0.0)}
    full = spark.createDataFrame(EDGES, "src string, dst string")
    seed = spark.createDataFrame([("0",)], "pnu string")
    assert {r[0] for r in G.closure(seed, full, 1).collect()} == {"0", "1"}
    assert {r[0] for r in G.closure(seed, full, 2).collect()} == {"0", "1", "2"}


def test_clusters(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")], "src string, dst string")
    s = spark.createDataFrame([("A", .9), ("B", .9), ("C", .9), ("D", .1)], "pnu string, score double")
    assert {r["pnu"] for r in G.candidate_clusters(s, e, threshold=.5, min_nodes=2).collect()} == {"A", "B"}
    chain = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("C", "B"), ("C", "D"), ("D", "C")], "src string, dst string")
    age = spark.createDataFrame([("A", .7), ("B", .5), ("C", .3), ("D", .1)], "pnu string, aging double")
    assert {r["pnu"] for r in G.region_grow(age, chain, min_nodes=1).collect()} == {"A", "B"}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    raw = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(300, 460)]
    parent = list(range(500))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in raw:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    e = G.both_ways(spark.createDataFrame([(f"{a:05d}", f"{b:05d}") for a, b in raw], "a string, b string"))
    assert all(int(r["component"]) == find(int(r["pnu"])) for r in G.components(e).collect())


def test_metrics(spark):
    df = spark.createDataFrame([(0, .1), (0, .2), (1, .8), (1, .9)], "y int, p double")
    assert E.average_precision(E.curve(df, []), []).first()["pr_auc"] == 1.0
    one = spark.createDataFrame([(1, .1), (1, .2)], "y int, p double")
    assert E.average_precision(E.curve(one, []), []).first()["pr_auc"] is None
    b = spark.createDataFrame([(1, .9, 0.0), (1, .1, 0.0), (0, .1, .5)], "y int, p double, aging double")
    recall, n = E.battleground_recall(.5)
    assert tuple(b.agg(recall, n).first()) == (.5, 2)
    neg = spark.createDataFrame([(0, .9, "cancelled"), (0, .1, "new_construction")], "y int, p double, neg_reason string")
    assert tuple(E.negative_split(neg, .5).first()) == (1.0, 1, 0.0, 1)
    cal = spark.createDataFrame([(0, .0), (0, .0), (1, 1.0), (1, 1.0)], "y int, p double")
    assert E.calibration_error(E.reliability_bins(cal)).first()["ece"] == 0
    top = spark.createDataFrame([(1, 1, .9), (2, 1, .8), (3, 0, .2), (4, 0, .1)], "id long, y int, p double")
    assert {r["share"]: r["precision"] for r in E.topk_precision(top).collect()}[.5] == 1.0
    assert E.roc_auc(top, []).first()["roc_auc"] == 1.0


def test_set_overlap(spark):
    z = spark.createDataFrame([("z", "B"), ("z", "C")], "zone_id string, pnu string")
    c = spark.createDataFrame([("c", "A"), ("c", "B")], "cluster_id string, pnu string")
    r = E.zone_matches(z, c).first()
    assert (r["iou"], r["core_capture"]) == (pytest.approx(1 / 3), .5)


def test_exact_quantiles_and_ranks_match_plain_python(spark):
    rng = random.Random(2)
    rows = [(g, round(rng.gauss(0, 5), rng.choice([0, 3]))) for g in "ab" for _ in range(700)] + [("b", 1.0)] * 900
    df = spark.createDataFrame(rows, "g string, v double")
    q = {r["g"]: r for r in ranks.exact_quantiles(df, ["g"], "v", {"m": .5, "p90": .9}).collect()}
    for g in "ab":
        vals = sorted(v for k, v in rows if k == g)
        h = .9 * (len(vals) - 1)
        lo = int(h)
        want = vals[lo] + (vals[min(lo + 1, len(vals) - 1)] - vals[lo]) * (h - lo)
        assert q[g]["n"] == len(vals) and q[g]["m"] == pytest.approx(statistics.median(vals)) and q[g]["p90"] == pytest.approx(want)
    pct = ranks.with_percentile(df, ["g"], "v", "pct").distinct().collect()
    for r in pct:
        vals = [v for k, v in rows if k == r["g"]]
        below, same = sum(v < r["v"] for v in vals), sum(v == r["v"] for v in vals)
        assert r["pct"] == pytest.approx((below + (same + 1) / 2) / len(vals))


def test_conflicts(spark):
    rows = [("P", 2020, "uncertain"), ("P", 2020, "positive"), ("P", 2020, "reliable_negative"), ("Q", 2014, "uncertain"), ("Q", 2022, "positive")]
    df = L.aligned(spark.createDataFrame(rows, "pnu string, t int, certainty string"))
    assert pairs(L.resolve_conflicts(df), "pnu", "t", "certainty") == {("P", 2020, "positive"), ("Q", 2014, "uncertain"), ("Q", 2022, "positive")}


def test_notice_and_zone_matching(spark):
    idx = spark.createDataFrame([("2024-448", "20240919", "seoul", "장위15구역 변경"), ("2024-448", "20240919", "busan", "해운대3구역")],
                                "number string, date string, url string, title string")
    t = spark.createDataFrame([(1, "2024-448", "2024-09-19", "장위15구역"), (2, "2024-448", "2024-09-19", "없는9구역"), (3, "2024-448", None, None)],
                              "target_id int, number string, date string, zone_name string")
    out = {r["target_id"]: (r["url"], r["confidence"]) for r in M.resolve_notices(t, idx).collect()}
    assert out == {1: ("seoul", "high"), 2: (None, "none"), 3: (None, "none")}
    store = spark.createDataFrame([("11290A", "x"), ("11290B", "장위 제15구역"), ("11500C", "장위15구역")], "zone_id string, zone_name string")
    ctx = spark.createDataFrame([("11290A", "t"), ("11290Z", "변경 장위15구역 결정")], "zone_id string, title string")
    got = {r["store_id"]: (r["zone_id"], r["confidence"]) for r in M.resolve_store(store, ctx).collect()}
    assert got == {"11290A": ("11290A", "high"), "11290B": ("11290Z", "mid"), "11500C": (None, "none")}


def test_rules(spark):
    parcels = spark.createDataFrame([("A", 50.0, 0), ("B", 50.0, 0), ("C", 200.0, 0), ("D", 200.0, 0)], "pnu string, area_m2 double, road_abut int")
    b = spark.createDataFrame([("A", 1980, "rc", 30.0), ("B", 1980, "rc", 30.0), ("C", 2020, "rc", 900.0)], BUILDINGS)
    m = spark.createDataFrame([("old", "A"), ("old", "B"), ("new", "C"), ("none", "D")], "cluster_id string, pnu string")
    c = {r["cluster_id"]: r for r in R.classify(R.cluster_metrics(m, R.parcel_facts(parcels, asof.building_stock(b)))).collect()}
    assert c["old"]["path"] == "재개발" and len(c["old"]["caveats"]) == 4
    assert c["new"]["path"] == "해당없음" and c["none"]["old_area_ratio"] is None


def test_number_grounding(spark):
    src = "정비계획 결정 조서 용적률은 190.0% 이하로 하며 900% 는 아니다"
    items = spark.createDataFrame([("용적률", "190.0%", "용적률은 190.0% 이하로 하며", src), ("용적률", "250%", "용적률은 250%", src),
                                   ("용적률", "900%", "900% 는 아니다 라고 적힘", src), ("용적률", "190.0%", "지어낸 문장입니다 190.0", src),
                                   ("용적률", None, None, src)], "attr string, raw string, sentence string, source_text string")
    got = [r["grade"] for r in V.verify_attributes(items).collect()]
    assert got == ["verified", "rejected", "flagged", "flagged", "missing"]


def test_signals_without_corpus(spark):
    z = spark.createDataFrame([("z1",), ("z2",)], "zone_id string")
    rep = spark.createDataFrame([("z1", "u", "s", '```json {"signals":[{"type":"갈등","direction":"악재","evidence":"e"}]} ```')],
                                "zone_id string, url string, source string, reply string")
    out = {r["zone_id"]: r["status"] for r in V.signal_status(z, rep).collect()}
    assert out == {"z1": "신호 있음", "z2": "신호 없음"} and V.social_signals(rep).first()["url"] == "u"


def test_cosine_topk_over_many_blocks(spark):
    rng = random.Random(4)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(vecs, "i long, v array<double>").select("i", SI.unit(F.col("v")).alias("vec"))
    q, c = df.select(F.col("i").alias("query_id"), "vec"), df.select(F.col("i").alias("case_id"), "vec")
    got = pairs(SI.cosine_topk(q, c, k=2, block_rows=7), "query_id", "case_id", "rank")
    unit = {i: [x / sum(y * y for y in v) ** .5 for x in v] for i, v in vecs}
    want = set()
    for i in unit:
        best = sorted(unit, key=lambda j: (-round(sum(a * b for a, b in zip(unit[i], unit[j])), 12), j))[:2]
        want |= {(i, j, k + 1) for k, j in enumerate(best)}
    assert got == want
    axes = SI.with_top_axes(SI.cosine_topk(q, c, k=1), q, c).first()["top_axes"]
    assert 1 <= len(axes) <= 2


def _best_by_force(units: dict, k: int) -> set:
    out = set()
    for i in units:
        best = sorted(units, key=lambda j: (-round(sum(a * b for a, b in zip(units[i], units[j])), 12), j))[:k]
        out |= {(i, j, n + 1) for n, j in enumerate(best)}
    return out


def test_cosine_topk_skips_clusters_that_cannot_hold_a_better_case(spark):
    rng = random.Random(9)
    vecs = []
    for i in range(300):
        axis = [0.0] * 6
        axis[i % 6] = 1.0 if i % 2 else -1.0
        vecs.append((i, [a + rng.gauss(0, 0.05) for a in axis]))
    # Equal vectors, one far from all others, and a zero vector, which is equally near to all.
    vecs += [(300, vecs[0][1]), (301, vecs[0][1]), (302, [1.0] * 6), (303, [0.0] * 6)]
    df = spark.createDataFrame(vecs, "i long, v array<double>").select("i", SI.unit(F.col("v")).alias("vec")).cache()
    units = {r["i"]: r["vec"] for r in df.collect()}
    q, c = df.select(F.col("i").alias("query_id"), "vec"), df.select(F.col("i").alias("case_id"), "vec")
    assert pairs(SI.cosine_topk(q, c, k=4, block_rows=30), "query_id", "case_id", "rank") == _best_by_force(units, 4)
    # More than any cluster holds: every query sees every case.
    assert pairs(SI.cosine_topk(q, c, k=200, block_rows=30), "query_id", "case_id", "rank") == _best_by_force(units, 200)
    assert SI.cosine_topk(q, c.limit(0)).isEmpty() and SI.cosine_topk(q.limit(0), c, block_rows=30).isEmpty()

    placed, shapes = SI.clustered(c.withColumnRenamed("vec", "cv"), 10)
    assert placed.count() == len(vecs)
    known = shapes.collect()
    asked = q.withColumnRenamed("vec", "qv")
    home = SI.cluster_visits(asked.withColumn("floor", F.lit(None).cast("double")), known)
    assert home.count() == len(vecs) and home.select("query_id").distinct().count() == len(vecs)
    others = SI.cluster_visits(asked.withColumn("floor", F.lit(0.9)), known)
    seen = pairs(home.union(others), "query_id", "cluster")
    # Most are skipped, and no case of at least the floor lies in a skipped one.
    assert len(seen) < 0.5 * len(vecs) * len(known)
    where = {r["case_id"]: r["cluster"] for r in placed.collect()}
    for i, a in units.items():
        assert all((i, where[j]) in seen for j, b in units.items() if sum(x * y for x, y in zip(a, b)) >= 0.9)
