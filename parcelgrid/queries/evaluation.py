"""Metrics over a score column, set overlap, assessments."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid import settings as S
from parcelgrid.operators import graph as G, metrics as M, rules
from parcelgrid.plans import assess as AS
from parcelgrid.queries.aggregates import PATH_SQL, zone_metrics  # noqa: F401
from parcelgrid.queries.ingest import lots
from parcelgrid.queries.joins import CLUSTER_SQL, ZONE_MEMBERS_SQL, clusters, members, node_aging, node_scores
from parcelgrid.queries.registry import EDGES_SQL, SCORES_SQL, big, node_edges, old_sql, query, r, scores_of
from parcelgrid.session import durable
from parcelgrid.standins import DISTRICTS, Tables

CURVE_SQL = """, s AS (SELECT {g} AS fold, {p} AS p, sum(y) AS tp, count(*) AS n FROM judged GROUP BY 1, 2),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY fold) AS atp, sum(n) OVER (PARTITION BY fold) AS an
 FROM s WINDOW w AS (PARTITION BY fold ORDER BY p DESC)),
f AS (SELECT *, 2 * (ctp / cn) * (ctp / atp) / (ctp / cn + ctp / atp + 1e-12) AS f1 FROM c),
b AS (SELECT fold, CASE WHEN max(atp) BETWEEN 1 AND max(an) - 1 THEN max(f1) END AS best_f1,
 CASE WHEN max(atp) BETWEEN 1 AND max(an) - 1 THEN arg_max(p, (f1, -p)) ELSE 0.5 END AS best_thr FROM f GROUP BY 1),
ap AS (SELECT fold, CASE WHEN max(atp) BETWEEN 1 AND max(an) - 1 THEN sum(tp / atp * ctp / cn) END AS pr_auc FROM c GROUP BY 1)
"""


@query("E1_average_precision", CURVE_SQL.format(g="fold", p="p") + "SELECT fold, round(pr_auc, 6) AS pr_auc FROM ap", uses=("judged",))
def e1(t: Tables):
    return M.average_precision(M.curve(t.judged, ["fold"]), ["fold"]).select("fold", r("pr_auc").alias("pr_auc"))


@query("E2_best_f1", CURVE_SQL.format(g="fold", p="p") + """
SELECT fold, round(best_f1, 6) AS best_f1, round(best_thr, 6) AS best_thr FROM b""", uses=("judged",))
def e2(t: Tables):
    b = M.best_f1(M.curve(t.judged, ["fold"]), ["fold"])
    return b.select("fold", r("best_f1").alias("best_f1"), r("best_thr").alias("best_thr"))


@query("E2_f1_at", """
SELECT fold, round(2.0 * count(*) FILTER (y = 1 AND p >= 0.4) / (2 * count(*) FILTER (y = 1 AND p >= 0.4) + count(*) FILTER ((p >= 0.4) <> (y = 1))), 6) AS f1
FROM judged GROUP BY 1""", uses=("judged",))
def e2_at(t: Tables):
    return t.judged.groupBy("fold").agg(r(M.f1_at(0.4)).alias("f1"))


@query("E3_battleground_recall", """
SELECT fold, round(avg((p >= 0.4)::INT) FILTER (y = 1 AND aging = 0), 6) AS recall, count(*) FILTER (y = 1 AND aging = 0) AS n FROM judged GROUP BY 1""", uses=("judged",))
def e3(t: Tables):
    recall, n = M.battleground_recall(0.4)
    return t.judged.groupBy("fold").agg(r(recall).alias("recall"), n.alias("n"))


@query("E4_negative_split", """
SELECT fold, round(avg((p >= 0.3)::INT) FILTER (y = 0 AND neg_reason = 'cancelled'), 6) AS hard_fpr, count(*) FILTER (y = 0 AND neg_reason = 'cancelled') AS hard_n,
 round(avg((p >= 0.3)::INT) FILTER (y = 0 AND neg_reason = 'new_construction'), 6) AS easy_fpr, count(*) FILTER (y = 0 AND neg_reason = 'new_construction') AS easy_n
FROM judged GROUP BY 1""", uses=("judged",))
def e4(t: Tables):
    s = M.negative_split(t.judged, 0.3, ["fold"])
    return s.withColumns({"hard_fpr": r("hard_fpr"), "easy_fpr": r("easy_fpr")})


@query("M8_evaluation_report", CURVE_SQL.format(g="fold", p="p") + """
, x AS (SELECT j.fold, count(*) AS n_test, CAST(sum(y) AS BIGINT) AS n_pos, avg((j.p >= best_thr)::INT) FILTER (y = 1 AND aging = 0) AS br, count(*) FILTER (y = 1 AND aging = 0) AS bn,
 avg((j.p >= best_thr)::INT) FILTER (y = 0 AND neg_reason = 'new_construction') AS ef FROM judged j JOIN b USING (fold) GROUP BY 1)
SELECT fold, n_test, n_pos, round(pr_auc, 6) AS pr_auc, round(best_f1, 6) AS best_f1, round(br, 6) AS battleground_recall, bn AS battleground_n, round(ef, 6) AS easy_fpr
FROM x JOIN ap USING (fold) JOIN b USING (fold)""", uses=("judged",))
def m8(t: Tables):
    e = M.evaluate(t.judged, ["fold"])
    return e.select("fold", "n_test", big("n_pos").alias("n_pos"), *[r(c).alias(c) for c in ("pr_auc", "best_f1", "battleground_recall")],
                    "battleground_n", r("easy_fpr").alias("easy_fpr"))


@query("M9_aging_floor", CURVE_SQL.format(g="'all'", p="aging") + "SELECT round(pr_auc, 6) AS pr_auc FROM ap", uses=("judged",))
def m9(t: Tables):
    return M.average_precision(M.curve(t.judged, [], p="aging"), []).select(r("pr_auc").alias("pr_auc"))


@query("M11_operating_threshold", CURVE_SQL.format(g="'all'", p="p") + "SELECT round(best_thr, 6) AS thr, round(best_f1, 6) AS f1 FROM b", uses=("judged",))
def m11(t: Tables):
    return M.best_f1(M.curve(t.judged, []), []).select(r("best_thr").alias("thr"), r("best_f1").alias("f1"))


BIN_SQL = """, k AS (SELECT least(greatest(list_sum(list_transform(range(11), lambda i: (p >= i * 0.1::DOUBLE)::INT)) - 1, 0), 9) AS bin, p, y FROM judged),
g AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM k GROUP BY 1)
"""


@query("E6_reliability_bins", BIN_SQL + "SELECT CAST(bin AS BIGINT) AS bin, n, round(conf, 6) AS conf, round(acc, 6) AS acc FROM g", uses=("judged",))
def e6(t: Tables):
    b = M.reliability_bins(t.judged)
    return b.select(big("bin").alias("bin"), "n", r("conf").alias("conf"), r("acc").alias("acc"))


@query("E6_calibration_error", BIN_SQL + "SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM g", uses=("judged",))
def e6_ece(t: Tables):
    return M.calibration_error(M.reliability_bins(t.judged)).select(r("ece").alias("ece"))


@query("E7_topk_precision", """
, o AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS rn, count(*) OVER () AS n FROM judged),
k AS (SELECT share, greatest(1, CAST(floor(share * (SELECT count(*) FROM judged)) AS BIGINT)) AS k FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) v(share))
SELECT share, k, round(avg(y), 6) AS precision FROM k JOIN o ON rn <= k GROUP BY 1, 2""", uses=("judged",))
def e7(t: Tables):
    p = M.topk_precision(t.judged)
    return p.select("share", big("k").alias("k"), r("precision").alias("precision"))


@query("E8_roc_auc", """
, k AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS rk FROM judged)
SELECT fold, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM k GROUP BY 1""", uses=("judged",))
def e8(t: Tables):
    return M.roc_auc(t.judged, ["fold"]).select("fold", r("roc_auc").alias("roc_auc"))


@query("E9_scoring_agreement", """
, k AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS ra, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rb,
 count(*) OVER () AS n FROM judged), d AS (SELECT *, ra / n AS pa, rb / n AS pb, abs(ra / n - rb / n) AS s FROM k)
SELECT round(corr(ra, rb), 6) AS spearman, round(median(s), 6) AS shift_median, round(quantile_cont(s, 0.9), 6) AS shift_p90, count(*) FILTER (pa > 0.9) AS n_top,
 count(*) FILTER (pa > 0.9 AND pb > 0.9) AS n_top_kept, count(*) FILTER (pa > 0.9 AND pb <= 0.9) AS n_top_lost FROM d""", uses=("judged",))
def e9(t: Tables):
    a = M.scoring_agreement(t.judged.select("id", "p", "q"), "p", "q")
    return a.withColumns({c: r(c) for c in ("spearman", "shift_median", "shift_p90")})


METHODS_SQL = f""", {old_sql('2026')}, {SCORES_SQL}, {EDGES_SQL}, {ZONE_MEMBERS_SQL},
age AS (SELECT n.pnu, coalesce(old_ratio, 0) AS a FROM nodes n LEFT JOIN old_now USING (pnu)),
ns AS (SELECT s.pnu, score FROM scores s JOIN nodes USING (pnu)),
ok AS (SELECT 'wide' AS method, pnu FROM ns WHERE score >= 0.5 UNION ALL SELECT 'tight', pnu FROM ns WHERE score >= 0.8
 UNION ALL SELECT 'grow', pnu FROM age WHERE a >= 0.4),
kept AS (SELECT a.method, src, dst FROM edges JOIN ok a ON a.pnu = src JOIN ok b ON b.pnu = dst AND b.method = a.method),
reach AS (SELECT method, pnu AS a, pnu AS b FROM ok
 UNION SELECT reach.method, reach.a, kept.dst FROM reach JOIN kept ON kept.src = reach.b AND kept.method = reach.method),
comp AS (SELECT method, a AS pnu, min(b) AS cluster_id FROM reach GROUP BY method, a),
big AS (SELECT method, cluster_id, count(*) AS cn FROM comp JOIN age USING (pnu) GROUP BY ALL HAVING count(*) >= 5 AND (method <> 'grow' OR max(age.a) >= 0.6)),
m AS (SELECT DISTINCT method FROM ok), zn AS (SELECT zone_id, count(*) AS zn FROM zm GROUP BY 1),
pr AS (SELECT method, zone_id, cluster_id, count(*) AS i FROM zm JOIN comp USING (pnu) GROUP BY ALL),
o AS (SELECT method, zone_id, i / (zn + cn - i) AS iou, i / zn AS core FROM pr JOIN big USING (method, cluster_id) JOIN zn USING (zone_id)
 QUALIFY row_number() OVER (PARTITION BY method, zone_id ORDER BY i / (zn + cn - i) DESC, cluster_id) = 1)
"""


@query("E5_method_comparison", METHODS_SQL + """
SELECT method, round(avg(coalesce(iou, 0)), 3) AS mean_iou, round(avg(coalesce(core, 0)), 3) AS mean_core_capture, count(*) AS n_zones,
 (SELECT count(*) FROM big WHERE big.method = m.method) AS n_clusters,
 coalesce(round((SELECT avg(cn) FROM big WHERE big.method = m.method), 0), 0) AS avg_cluster_size
FROM m CROSS JOIN zn LEFT JOIN o USING (method, zone_id) GROUP BY method""", uses=("parcels", "buildings", "zones"))
def e5(t: Tables):
    """Clusters at two thresholds and grown regions, against past zones."""
    edges = node_edges(t)
    tight = G.candidate_clusters(node_scores(t), edges, threshold=0.8)
    return M.compare_methods(durable(members(t)), {
        "wide": clusters(t), "tight": durable(tight), "grow": durable(G.region_grow(node_aging(t), edges))})


@query("R3_environment_score", f""", {old_sql('2026')}, {SCORES_SQL}, k AS (SELECT pnu, score, round(100 * (1 - (rank() OVER (ORDER BY score) - 1) / count(*) OVER ()), 1) AS top FROM scores)
SELECT pnu, top AS rank_top_pct, CASE WHEN top <= 50 THEN '상위 ' || top || '%' ELSE '하위 ' || round(100 - top, 1) || '%' END AS rank_phrase FROM k""", uses=("parcels", "buildings"))
def r3(t: Tables):
    s = AS.score_ranks(scores_of(t))
    return s.select("pnu", AS.environment_record(F.col("rank_top_pct"), F.col("score")).alias("e")).select(
        "pnu", "e.rank_top_pct", "e.rank_phrase")


def context(t: Tables) -> AS.Context:
    """Assessment tables: three detailed districts, all districts for the wide scope."""
    from parcelgrid.operators.ranks import with_percentile

    inside = ["11000", "11010", "11020"]
    wide = lots(t)
    every = durable(scores_of(t))
    nodes = G.node_parcels(t.parcels).select("pnu")
    detail = every.where(F.col("sigungu").isin(*inside)).join(nodes, "pnu", "left_semi")
    cl = durable(clusters(t))
    p = t.shaped("parcels")
    from parcelgrid.operators.asof import building_stock

    facts = rules.parcel_facts(G.static_shape(p).select("pnu", "area_m2"), building_stock(t.buildings),
                               road_abut=G.road_abutting(p, p.where(F.col("jimok") == S.ROAD_CLASS)))
    price = t.parcels.selectExpr(
        "pnu", "CASE WHEN ck % 4 < 3 THEN CAST(1000 + ck AS DOUBLE) END AS target_pyung",
        "CASE ck % 4 WHEN 0 THEN 'r50' WHEN 1 THEN 'r100' WHEN 2 THEN 'dong' ELSE 'missing' END AS agg_level", "ck % 9 AS n_trades")
    comp = t.parcels.selectExpr("pnu", "CASE WHEN ck % 2 = 0 THEN CAST(3000 + ck AS DOUBLE) END AS comp_pyung", "ck % 5 AS n_trades")
    plans = t.zones.where("sk % 2 = 0").select(
        "zone_id", F.concat(F.lit("2024-"), F.col("sk")).alias("number"), F.array().cast("array<string>").alias("flags"),
        F.create_map(F.lit("용적률"), F.struct(F.concat(F.col("sk") + 100, F.lit("%")).alias("raw"), F.lit("verified").alias("grade"))).alias("attrs"))
    return AS.Context(
        detail_index=wide.where(F.col("sigungu").isin(*inside)), wide_index=wide, district_codes=DISTRICTS,
        scores=detail.select("pnu", "score"), wide_scores=with_percentile(every, ["sigungu"], "score", "score_pct").select("pnu", "score", "score_pct"),
        clusters=cl, cluster_rules=rules.classify(rules.cluster_metrics(cl, facts)), zones=members(t).select("pnu", "zone_id"),
        prices=price, comparables=comp, plans=plans, threshold=0.5)


def addresses(t: Tables):
    return t.parcels.selectExpr(
        "ck AS address_id", "CASE ck % 7 WHEN 0 THEN pnu WHEN 6 THEN gu || ' 세종대로 1' ELSE '서울특별시 ' || gu || ' ' || dong || ' ' || main_no || '-' || sub_no END AS address",
        "CASE ck % 3 WHEN 0 THEN 'villa' WHEN 1 THEN 'apartment' END AS property_type", "CASE WHEN ck % 2 = 0 THEN '착공' END AS stage")


ASSESS_SQL = CLUSTER_SQL + f""", {ZONE_MEMBERS_SQL}, inz AS (SELECT pnu, min(zone_id) AS zone_id FROM zm GROUP BY 1),
det AS (SELECT pnu, score, round(100 * (1 - (rank() OVER (ORDER BY score) - 1) / count(*) OVER ()), 1) AS top FROM scores JOIN nodes n USING (pnu) WHERE scores.sigungu IN ('11000', '11010', '11020')),
wide AS (SELECT pnu, score, round(100 * (1 - (rank() OVER (PARTITION BY sigungu ORDER BY score) + (count(*) OVER (PARTITION BY sigungu, score) - 1) / 2.0) / count(*) OVER (PARTITION BY sigungu)), 1) AS top FROM scores),
j AS (SELECT p.ck, p.pnu AS lot, p.ck % 7 = 6 AS failed, p.sigungu IN ('11000', '11010', '11020') AS fullscope, det.score AS ds, det.top AS dt, wide.score AS ws, wide.top AS wt,
 c.cluster_id, inz.zone_id FROM parcels p LEFT JOIN det USING (pnu) LEFT JOIN wide USING (pnu) LEFT JOIN clusters c USING (pnu) LEFT JOIN inz USING (pnu)),
a AS (SELECT ck AS address_id, CASE WHEN failed THEN NULL ELSE lot END AS pnu, CASE WHEN failed THEN NULL WHEN fullscope THEN 'full' ELSE 'partial' END AS scope,
 CASE WHEN failed THEN 'road_address' END AS error, NOT failed AND zone_id IS NOT NULL AS in_zone,
 NOT failed AND cluster_id IS NOT NULL AND (NOT fullscope OR coalesce(ds >= 0.5, false)) AS candidate,
 CASE WHEN failed THEN NULL WHEN fullscope THEN dt ELSE wt END AS top, failed FROM j)
"""


@query("R1_assessments", ASSESS_SQL + """
SELECT address_id, pnu, scope, error, in_zone, candidate, top AS rank_top_pct, CASE WHEN failed THEN NULL WHEN in_zone THEN '지정 정비구역' WHEN candidate THEN '환경 유사 후보(미지정)'
 WHEN top <= 10 THEN '관심(경계 밖)' ELSE '대상 아님' END AS class FROM a""", uses=("parcels", "buildings", "zones"))
def r1(t: Tables):
    a = AS.assess(addresses(t), context(t))
    return a.select(big("address_id").alias("address_id"), "pnu", "scope", "error", "in_zone", "candidate",
                    F.col("environment.result.rank_top_pct").alias("rank_top_pct"), F.col("verdict.class").alias("class"))


@query("R1_report_parts", ASSESS_SQL + """
SELECT address_id, CASE WHEN top IS NULL THEN 'na' ELSE 'ok' END AS environment, CASE WHEN scope = 'full' THEN 'ok' ELSE 'skipped' END AS market,
 CASE WHEN scope = 'full' AND address_id % 3 < 2 THEN 'ok' ELSE 'na' END AS entry, CASE WHEN scope = 'full' AND candidate THEN 'ok' ELSE 'na' END AS requirements,
 0::BIGINT AS n_unmatched FROM a""", uses=("parcels", "buildings", "zones"))
def r1_parts(t: Tables):
    rep = AS.reports(AS.assess(addresses(t), context(t)))
    return rep.select(big("address_id").alias("address_id"), *[F.col(f"{c}.status").alias(c) for c in ("environment", "market", "entry", "requirements")],
                      big(F.coalesce(F.size("unmatched"), F.lit(0))).alias("n_unmatched"))


@query("R2_partial_assessments", ASSESS_SQL + """
SELECT address_id, in_zone, candidate, CASE WHEN top <= 50 THEN '상위 ' || top || '%' ELSE '하위 ' || round(100 - top, 1) || '%' END AS phrase FROM a WHERE scope = 'partial'""",
       uses=("parcels", "buildings", "zones"))
def r2(t: Tables):
    a = AS.assess(addresses(t), context(t)).where("scope = 'partial'")
    return a.select(big("address_id").alias("address_id"), "in_zone", "candidate", F.col("environment.result.rank_phrase").alias("phrase"))
