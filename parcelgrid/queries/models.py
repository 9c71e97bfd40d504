"""Label table, features, folds, models and resampling."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from parcelgrid import settings as S
from parcelgrid.functions.fields import feature_sets, production_features, villa_unit_prices, within_window
from parcelgrid.operators import asof, graph as G, prices as P
from parcelgrid.operators.ranks import exact_quantiles
from parcelgrid.plans import bootstrap as B, features as FE, folds as K, labels as L, models as MO, unlabelled as PU
from parcelgrid.queries.aggregates import POS_SQL
from parcelgrid.queries.joins import (
    ABUT_SQL, CENTRES_SQL, PCT_SQL, TARGET_SQL, ZONE_MEMBERS_SQL, ZONING_SQL, centres, land_pct, members)
from parcelgrid.queries.registry import EDGES_SQL, big, node_edges, old_sql, query, r, scores_of, shared
from parcelgrid.session import durable, side_by_side
from parcelgrid.standins import Tables

#: Rounds at most, as the jobs' own default; fits with validation rows stop earlier (`fit_classifier`).
ROUNDS = 100

CANC_SQL = "canc AS (SELECT pnu, CAST(2010 + ck % 12 AS INT) AS t FROM parcels WHERE ck % 9 = 4)"
LABEL_SQL = f""", {ZONE_MEMBERS_SQL}, {old_sql('2026')}, {POS_SQL}, {CANC_SQL},
every AS (SELECT pnu, t, 0 AS pr, 'positive' AS certainty, zone_id, zone_id IN (SELECT zone_id FROM done) AS contaminated, CAST(NULL AS STRING) AS neg_reason FROM pos
 UNION ALL SELECT pnu, t, 1, 'reliable_negative', NULL, false, 'cancelled' FROM canc
 UNION ALL SELECT pnu, 2026, CASE WHEN old_ratio < 0.2 THEN 1 ELSE 2 END, CASE WHEN old_ratio < 0.2 THEN 'reliable_negative' ELSE 'uncertain' END, NULL, false,
 CASE WHEN old_ratio < 0.2 THEN 'new_construction' ELSE 'not_yet' END FROM old_now WHERE (old_ratio < 0.2 OR old_ratio >= 0.5) AND pnu NOT IN (SELECT pnu FROM pos)),
labels_ AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY pnu, t ORDER BY pr) = 1)
"""


def label_rows(t: Tables):
    canc = t.parcels.where("ck % 9 = 4").selectExpr(
        "pnu", "CAST(2010 + ck % 12 AS INT) AS t", "(2010 + ck % 12) || '-01-01' AS t_date", "'cancel_date' AS t_source", "0 AS label",
        "'reliable_negative' AS certainty", "'해제' AS source", "'cancelled' AS neg_reason")
    return L.label_table(t.shaped("zones"), centres(t), asof.building_stock(t.buildings), canc)


@query("M1_label_table", LABEL_SQL + "SELECT pnu, CAST(t AS BIGINT) AS t, certainty, zone_id, contaminated, neg_reason FROM labels_",
       uses=("parcels", "buildings", "zones"))
def m1(t: Tables):
    return label_rows(t).select("pnu", big("t").alias("t"), "certainty", "zone_id", "contaminated", "neg_reason")


@query("M1_label_report", LABEL_SQL + """
SELECT count(*) AS total_rows, count(*) FILTER (certainty = 'positive') AS n_positive, count(*) FILTER (certainty = 'reliable_negative') AS n_reliable_negative,
 count(*) FILTER (certainty = 'uncertain') AS n_uncertain, count(DISTINCT zone_id) AS positive_zones, count(*) FILTER (contaminated) AS contaminated,
 (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM labels_ GROUP BY pnu) WHERE n > 1) AS double_rows FROM labels_""",
       uses=("parcels", "buildings", "zones"))
def m1_report(t: Tables):
    rep = L.label_report(durable(label_rows(t)))
    return rep.select(*[big(c).alias(c) for c in ("total_rows", "n_positive", "n_reliable_negative", "n_uncertain", "positive_zones", "contaminated", "double_rows")])


def tables(t: Tables) -> FE.Tables:
    return FE.Tables(t.shaped("parcels"), shared(t, "stock", lambda: asof.building_stock(t.buildings)), t.shaped("zoning"),
                     shared(t, "land", lambda: land_pct(t)), t.stations)


FEATURE_SQL = f""", {CENTRES_SQL}, {PCT_SQL}, {ABUT_SQL}{ZONING_SQL},
q AS (SELECT pnu, CAST({{t}} AS INT) AS t FROM parcels), b AS (SELECT q.pnu, q.t, count(*) AS n,
 sum(CASE WHEN q.t - approval_year >= CASE WHEN structure = 'rc' THEN 30 ELSE 20 END THEN coalesce(gross_floor_area, 0) ELSE 0 END) / nullif(sum(coalesce(gross_floor_area, 0)), 0) AS aging
 FROM q JOIN buildings ON buildings.pnu = q.pnu AND approval_year <= q.t GROUP BY 1, 2),
rl AS (SELECT q.pnu, q.t, min(sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2))) AS d FROM q JOIN centres c USING (pnu) JOIN stations s ON s.open_year <= least(q.t, 2026) GROUP BY 1, 2),
feat AS (SELECT q.pnu, q.t, coalesce(aging, 0) AS aging, w * w AS area_m2, pi() / 4 AS compactness, coalesce(n / (w * w) * 10000, 0) AS bldg_density,
 CASE WHEN a.pnu IS NULL THEN 0.0 ELSE 1.0 END AS road_abut, coalesce(pct, 0.5) AS land_pct, CASE WHEN pct IS NULL THEN 1.0 ELSE 0.0 END AS land_missing,
 coalesce(o, 0)::DOUBLE AS zoning_ord, CASE WHEN a6 IS NULL THEN 1.0 ELSE 0.0 END AS zoning_missing, 1 - least(greatest(d / 1000, 0), 1) AS rail_prox
 FROM q JOIN parcels p USING (pnu) LEFT JOIN b USING (pnu, t) LEFT JOIN abut a USING (pnu) LEFT JOIN zbest USING (pnu) LEFT JOIN rl USING (pnu, t)
 LEFT JOIN pct ON pct.pnu = q.pnu AND pct.year = least(q.t, 2026))
"""
FEATURE_COLS = ", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in S.NODE_FEATURES)
FEATURE_USES = ("parcels", "buildings", "prices", "zoning", "stations")


@query("M2_node_features", FEATURE_SQL.replace("{t}", "2003 + ck % 9") + f"SELECT pnu, CAST(t AS BIGINT) AS t, {FEATURE_COLS} FROM feat", uses=FEATURE_USES)
def m2(t: Tables):
    rows = t.parcels.selectExpr("pnu", "CAST(2003 + ck % 9 AS INT) AS t")
    f = FE.node_features(rows, tables(t))
    return f.select("pnu", big("t").alias("t"), *[r(c).alias(c) for c in S.NODE_FEATURES])


def nodes_of(t: Tables):
    return G.node_parcels(t.parcels)


def _neighbour_sql(node: str, keys: str, values: str, columns: list[str]) -> str:
    """Mean and largest value over the neighbours of each row of ``node``, 0 without any."""
    picked = ", ".join(f"coalesce(avg(v.{c}), 0) AS mean_{c}, coalesce(max(v.{c}), 0) AS max_{c}" for c in columns)
    on = " AND ".join(["v.pnu = dst", *(f"v.{k} = n.{k}" for k in keys.split(", ")[1:])])
    grouped = ", ".join(f"n.{k}" for k in keys.split(", "))
    return f"SELECT {grouped}, {picked} FROM {node} n LEFT JOIN edges ON src = n.pnu LEFT JOIN {values} v ON {on} GROUP BY {grouped}"


MEANS = [f"mean_{c}" for c in S.NODE_FEATURES]
ALL_FEATURES = [*S.NODE_FEATURES, *[f"nb{h}_{s}_{c}" for h in (1, 2) for s in ("mean", "max") for c in S.NODE_FEATURES]]
ALL_COLS = ", ".join([*[f"round(f.{c}, 9)::DOUBLE AS {c}" for c in S.NODE_FEATURES],
                      *[f"round(h1.{s}_{c}, 9)::DOUBLE AS nb1_{s}_{c}" for s in ("mean", "max") for c in S.NODE_FEATURES],
                      *[f"round(h2.{s}_mean_{c}, 9)::DOUBLE AS nb2_{s}_{c}" for s in ("mean", "max") for c in S.NODE_FEATURES]])


def hops_sql(node: str, keys: str) -> str:
    return (f"h1 AS ({_neighbour_sql(node, keys, 'feat', S.NODE_FEATURES)}),\n"
            f"h2 AS ({_neighbour_sql(node, keys, 'h1', MEANS)})\n")


@query("G5_all_node_features", FEATURE_SQL.replace("{t}", "2026") + f", {EDGES_SQL}, " + hops_sql("nodes", "pnu")
       + f"SELECT f.pnu, {ALL_COLS} FROM nodes JOIN feat f USING (pnu) JOIN h1 USING (pnu) JOIN h2 USING (pnu)", uses=FEATURE_USES)
def g5(t: Tables):
    return every_node(t).select("pnu", *[r(c, 9).alias(c) for c in ALL_FEATURES])


def _sum_sql(columns: list[str]) -> str:
    """Sum of feature columns as the SQL of ``hops_sql`` names them."""
    def place(c: str) -> str:
        if c.startswith("nb1_"):
            return f"h1.{c[4:]}"
        return "h2." + c[4:].replace("mean_", "mean_mean_", 1).replace("max_", "max_mean_", 1) if c.startswith("nb2_") else f"f.{c}"
    return " + ".join(map(place, columns))


FEATURE_SETS = {"b1": feature_sets(ALL_FEATURES)["B1"], "b1_plus": feature_sets(ALL_FEATURES)["B1+"], "production": production_features(ALL_FEATURES)}


@query("B30_feature_sets", FEATURE_SQL.replace("{t}", "2026") + f", {EDGES_SQL}, " + hops_sql("nodes", "pnu") + "SELECT f.pnu, "
       + ", ".join(f"round({_sum_sql(c)}, 6)::DOUBLE AS {n}" for n, c in FEATURE_SETS.items())
       + " FROM nodes JOIN feat f USING (pnu) JOIN h1 USING (pnu) JOIN h2 USING (pnu)", uses=FEATURE_USES)
def b30(t: Tables):
    rows = every_node(t)
    sets = {"b1": feature_sets(rows.columns)["B1"], "b1_plus": feature_sets(rows.columns)["B1+"], "production": production_features(rows.columns)}
    return rows.select("pnu", *[r(sum((F.col(c) for c in columns), F.lit(0.0))).alias(n) for n, columns in sets.items()])


def matrix(t: Tables):
    """Training matrix with row_id, cx and cy, written once."""
    def build():
        m = FE.training_matrix(durable(label_rows(t)), nodes_of(t), node_edges(t), tables(t))
        return m.withColumns({"row_id": F.concat_ws("@", "pnu", "t"), "cx": F.col("centroid_x"), "cy": F.col("centroid_y")})

    return shared(t, "matrix", build)


def every_node(t: Tables):
    """Features of all nodes at the current year, written once."""
    return shared(t, "nodes", lambda: FE.all_node_features(nodes_of(t), node_edges(t), tables(t)))


TRAIN_SQL = LABEL_SQL + f""", {EDGES_SQL}, tr AS (SELECT l.* FROM labels_ l JOIN nodes USING (pnu) WHERE NOT contaminated AND certainty <> 'uncertain')
"""


MATRIX_SQL = (TRAIN_SQL + ", nt AS (SELECT nodes.pnu, y.t FROM nodes, (SELECT DISTINCT t FROM tr) y)"
              + FEATURE_SQL.replace("SELECT pnu, CAST({t} AS INT) AS t FROM parcels", "SELECT pnu, CAST(t AS INT) AS t FROM nt")
              + ", " + hops_sql("nt", "pnu, t"))


@query("M3_training_matrix", MATRIX_SQL + f"""
SELECT tr.pnu, CAST(tr.t AS BIGINT) AS t, CASE WHEN certainty = 'positive' THEN 1 ELSE 0 END::BIGINT AS y, substr(tr.pnu, 1, 5) AS sigungu, {ALL_COLS}
FROM tr JOIN feat f ON f.pnu = tr.pnu AND f.t = tr.t JOIN h1 ON h1.pnu = tr.pnu AND h1.t = tr.t JOIN h2 ON h2.pnu = tr.pnu AND h2.t = tr.t""",
       uses=(*FEATURE_USES, "zones"))
def m3(t: Tables):
    return matrix(t).select("pnu", big("t").alias("t"), big("y").alias("y"), "sigungu", *[r(c, 9).alias(c) for c in ALL_FEATURES])


@query("M3_matrix_report", LABEL_SQL + f""", {EDGES_SQL}, x AS (SELECT l.*, pnu IN (SELECT pnu FROM nodes) AS ok FROM labels_ l)
SELECT count(*) FILTER (ok) AS reconciled_rows, count(*) FILTER (NOT ok) AS dropped_non_node, count(*) FILTER (ok AND contaminated) AS dropped_contaminated,
 count(*) FILTER (ok AND NOT contaminated AND certainty = 'uncertain') AS dropped_uncertain, count(*) FILTER (ok AND NOT contaminated AND certainty <> 'uncertain') AS final_rows FROM x""",
       uses=("parcels", "buildings", "zones"))
def m3_report(t: Tables):
    rep = FE.matrix_report(label_rows(t), nodes_of(t))
    return rep.select(*[big(c).alias(c) for c in ("reconciled_rows", "dropped_non_node", "dropped_contaminated", "dropped_uncertain", "final_rows")])


def fold_rows(t: Tables):
    """Every parcel as a labelled row."""
    return centres(t).selectExpr("pnu AS row_id", "pnu", "sigungu", "x", "y")


@query("M4_buffered_folds", f""", {CENTRES_SQL}, {EDGES_SQL}, d AS (SELECT DISTINCT sigungu AS fold FROM parcels),
tr AS (SELECT fold, c.* FROM d JOIN centres c ON c.sigungu <> fold), te AS (SELECT fold, c.* FROM d JOIN centres c ON c.sigungu = fold),
geo AS (SELECT DISTINCT tr.fold, tr.pnu FROM tr JOIN te ON te.fold = tr.fold AND pow(te.x - tr.x, 2) + pow(te.y - tr.y, 2) < 40000),
h1 AS (SELECT fold, dst AS pnu FROM te JOIN edges ON src = te.pnu), h AS (SELECT fold, pnu FROM h1 UNION SELECT fold, dst FROM h1 JOIN edges ON src = h1.pnu)
SELECT tr.fold, count(*) AS train_before, count(h.pnu) AS removed_graph_hop, count(geo.pnu) AS removed_geom, count(*) FILTER (h.pnu IS NOT NULL OR geo.pnu IS NOT NULL) AS removed_total,
 count(*) FILTER (h.pnu IS NULL AND geo.pnu IS NULL) AS train_after, (SELECT count(*) FROM te WHERE te.fold = tr.fold) AS n_test
FROM tr LEFT JOIN h ON h.fold = tr.fold AND h.pnu = tr.pnu LEFT JOIN geo ON geo.fold = tr.fold AND geo.pnu = tr.pnu GROUP BY tr.fold""", uses=("parcels",))
def m4(t: Tables):
    rows = fold_rows(t)
    return K.buffer_report(durable(K.buffered(K.district_folds(rows), rows, node_edges(t))))


@query("M5_zone_groups")
def m5(t: Tables):
    rows = centres(t).join(members(t).groupBy("pnu").agg(F.min("zone_id").alias("zone_id")), "pnu", "left").select(
        F.col("pnu").alias("row_id"), F.col("zone_id").isNotNull().cast("int").alias("y"), "zone_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    return K.zone_groups(rows, k=3).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("zone_id").alias("n_zones"))


@query("M6_boosted_classifier")
def m6(t: Tables):
    m = matrix(t)
    features = feature_sets(m.columns)["B1"]
    split = MO.inner_split(m, 2)
    model = MO.fit_classifier(split.where("group <> 0"), features, rounds=ROUNDS, validation=split.where("group = 0"))
    return MO.scored(model, split).select("row_id", "y", "group", r("p").alias("p"))


def out_of_fold(t: Tables, name: str, features: list[str]):
    """Out-of-fold scores of one feature set, written once."""
    return shared(t, f"oof_{name}", lambda: MO.cross_validate(matrix(t), node_edges(t), features, rounds=ROUNDS))


@query("M7_cross_validation")
def m7(t: Tables):
    return MO.cv_report(out_of_fold(t, "production", production_features(matrix(t).columns)))


@query("M10_production_scores")
def m10(t: Tables):
    model, _ = MO.train_production(matrix(t), rounds=ROUNDS)
    return MO.district_scores(model, every_node(t), centres(t))


@query("M20_district_scoring")
def m20(t: Tables):
    return m10(t).groupBy("sigungu").agg(F.count(F.lit(1)).alias("n"), r(F.avg("score")).alias("mean"), r(F.max("score_pct")).alias("top"))


@query("M12_calibration")
def m12(t: Tables):
    done = MO.calibrate(t.judged.select("p", "y"), t.judged.select("id", "p", "y"))
    return done.select(big("id").alias("id"), r("p").alias("p"), r("calibrated").alias("calibrated"))


def price_rows(t: Tables):
    """Price features of every parcel at the reference month, written once."""
    return shared(t, "price_rows", lambda: _price_rows(t))


def _price_rows(t: Tables):
    target = P.price_target(centres(t), t.trades, current_ym=200001)
    feats = FE.node_features(t.parcels.select("pnu", F.lit(S.CURRENT_YEAR).alias("t")), tables(t))
    level = F.create_map(*[F.lit(v) for kv in S.LEVEL_ORDINAL.items() for v in kv])
    return target.join(feats, "pnu").withColumn("agg_ord", level[F.col("agg_level")])


def later_trades(t: Tables):
    v = villa_unit_prices(t.trades).where("deal_ym >= 200001")
    return v.select("pnu", F.col("pyung").alias("actual"))


@query("M13_price_model")
def m13(t: Tables):
    rows = price_rows(t)
    model = MO.fit_price_model(rows.where(F.col("agg_level").isin("r50", "r100")), rounds=ROUNDS)
    return model.transform(rows).select("pnu", r("target_pyung", 2).alias("target_pyung"), r("prediction", 2).alias("prediction"))


@query("M14_price_validation")
def m14(t: Tables):
    rows = price_rows(t)
    model = MO.fit_price_model(rows.where(F.col("agg_level").isin("r50", "r100")), rounds=ROUNDS)
    return MO.price_validation(model, rows, later_trades(t))


@query("M14_price_baseline", TARGET_SQL + """
, g AS (SELECT substr(pnu, 1, 5) AS gu, median(target_pyung) AS m FROM target WHERE agg_level IN ('r50', 'r100') GROUP BY 1),
l AS (SELECT pnu, deal_amount / (land_share_m2 / 3.305785) AS actual FROM trades WHERE trade_type = 'villa' AND land_share_m2 > 0 AND deal_ym >= 200001)
SELECT count(*) AS n, round(avg(abs(m - actual)), 2) AS baseline_mae, round(avg(abs(m - actual) / actual), 6) AS baseline_mape FROM l JOIN g ON g.gu = substr(l.pnu, 1, 5)""",
       uses=("parcels", "trades"))
def m14_baseline(t: Tables):
    target = durable(P.price_target(centres(t), t.trades, current_ym=200201))
    reliable = target.where(F.col("agg_level").isin("r50", "r100")).withColumn("gu", F.substring("pnu", 1, 5))
    gu = exact_quantiles(reliable, ["gu"], "target_pyung", {"m": 0.5}).select("gu", "m")
    e = MO.price_errors(later_trades(t).withColumn("gu", F.substring("pnu", 1, 5)).join(gu, "gu"), {"baseline": "m"})
    return e.select("n", r("baseline_mae", 2).alias("baseline_mae"), r("baseline_mape").alias("baseline_mape"))


@query("M15_importance")
def m15(t: Tables):
    m = matrix(t)
    model, features = MO.train_production(m, rounds=ROUNDS)
    families = {"aging": "age", "density": "density", "rail": "location", "land": "price", "abut": "road", "area": "shape", "compactness": "shape"}
    return MO.importance(model, features, families).groupBy("family").agg(F.count(F.lit(1)).alias("n"), r(F.sum("importance")).alias("importance"))


def unlabelled_rows(t: Tables):
    m, edges = matrix(t), node_edges(t)
    every = durable(every_node(t).join(
        centres(t).select("pnu", F.col("x").alias("cx"), F.col("y").alias("cy")), "pnu").withColumns(
        {"centroid_x": F.col("cx"), "centroid_y": F.col("cy"), "row_id": F.concat_ws("@", "pnu", F.lit(S.CURRENT_YEAR))}))
    return durable(PU.with_uncertain(m, every)), every, edges


@query("M16_spy_promotion")
def m16_spy(t: Tables):
    rows, _, _ = unlabelled_rows(t)
    return PU.spy_promote(rows, production_features(rows.columns), rounds=ROUNDS)[1]


@query("M16_weight_trial")
def m16_trial(t: Tables):
    rows, every, edges = unlabelled_rows(t)
    features = production_features(rows.columns)
    zones = members(t).select("zone_id", "pnu")
    lodo, prod = side_by_side(t.spark, [
        partial(PU.district_trial, rows, features, 0.1, rounds=ROUNDS),
        partial(PU.production_trial, rows, every, edges, zones, features, 0.1, rounds=ROUNDS)])
    return lodo.join(prod, "w")


@query("M16_weights", """
SELECT CASE WHEN y = 1 THEN 'positive' WHEN aging = 0 THEN 'uncertain' ELSE 'reliable_negative' END AS certainty, count(*) AS n,
 round(sum(CASE WHEN y = 0 AND aging = 0 THEN 0.3 ELSE 1.0 END), 6)::DOUBLE AS weight FROM judged GROUP BY 1""", uses=("judged",))
def m16_weights(t: Tables):
    rows = t.judged.withColumn("certainty", F.expr("CASE WHEN y = 1 THEN 'positive' WHEN aging = 0 THEN 'uncertain' ELSE 'reliable_negative' END"))
    return rows.groupBy("certainty").agg(F.count(F.lit(1)).alias("n"), r(F.sum(PU.weight_column(0.3))).alias("weight"))


@query("M17_normalizer", """
, f AS (SELECT pnu, ln(1 + w * w) AS area_m2, ck % 13 AS v, ck % 3 = 0 AS train FROM parcels),
s AS (SELECT avg(area_m2) AS ma, stddev_pop(area_m2) + 1e-6 AS sa, avg(v) AS mv, stddev_pop(v) + 1e-6 AS sv FROM f WHERE train)
SELECT pnu, round((area_m2 - ma) / sa, 5) AS area_m2, round((v - mv) / sv, 5) AS v FROM f, s""", uses=("parcels",))
def m17(t: Tables):
    rows = t.parcels.selectExpr("pnu", "ck", "w * w AS area_m2", "CAST(ck % 13 AS DOUBLE) AS v")
    n = MO.normalized(rows.where("ck % 3 = 0"), rows, ["area_m2", "v"])
    return n.select("pnu", r("area_m2", 5).alias("area_m2"), r("v", 5).alias("v"))


@query("M18_ablation")
def m18(t: Tables):
    m = matrix(t)
    sets = feature_sets(m.columns)
    return MO.ablation(m, node_edges(t), {"B1": sets["B1"], "no_location": [c for c in sets["B1"] if c not in S.LOCATION_FEATURES]}, rounds=ROUNDS)


@query("M19_block_bootstrap")
def m19(t: Tables):
    """Screening score against a part of it, on all parcels; zones and k-means blocks are resampled."""
    zone = members(t).groupBy("pnu").agg(F.min("zone_id").alias("zone_id"))
    s = scores_of(t).join(zone, "pnu", "left").select(
        F.col("pnu").alias("row_id"), F.col("zone_id").isNotNull().cast("int").alias("y"), "zone_id",
        F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("score").alias("p"), (F.col("ck") % 7).cast("double").alias("q"))
    return B.difference_interval(durable(B.spatial_blocks(durable(s))), "p", "q", replicates=1000)


@query("M19_replicates", """, b AS (SELECT y, fold || '|' || neg_reason AS block, p FROM judged),
ix AS (SELECT y, block, row_number() OVER (PARTITION BY y ORDER BY md5(block), block) - 1 AS idx, count(*) OVER (PARTITION BY y) AS k FROM (SELECT DISTINCT y, block FROM b)),
d AS (SELECT y, g.replicate, ('0x' || substr(md5(concat_ws('|', 0, y, g.replicate, idx)), 1, 12))::BIGINT % k AS idx FROM ix, range(200) g(replicate)),
w AS (SELECT d.y, ix.block, d.replicate, count(*) AS w FROM d JOIN ix ON ix.y = d.y AND ix.idx = d.idx GROUP BY ALL),
s AS (SELECT replicate, p, coalesce(sum(w) FILTER (y = 1), 0) AS tp, sum(w) AS n FROM b JOIN w USING (y, block) GROUP BY ALL),
c AS (SELECT replicate, tp, sum(tp) OVER u AS ctp, sum(n) OVER u AS cn, sum(tp) OVER (PARTITION BY replicate) AS tp_all FROM s WINDOW u AS (PARTITION BY replicate ORDER BY p DESC))
SELECT CAST(replicate AS BIGINT) AS replicate, round(sum(tp / tp_all * ctp / cn), 6) AS pr_auc FROM c GROUP BY 1""", uses=("judged",))
def m19_replicates(t: Tables):
    rows = t.judged.select("y", F.concat_ws("|", "fold", "neg_reason").alias("block"), "p")
    got = B.replicate_scores(rows, "p", B.draw_table(rows, replicates=200), replicates=200)
    return got.select(big("replicate").alias("replicate"), r("pr_auc").alias("pr_auc"))
