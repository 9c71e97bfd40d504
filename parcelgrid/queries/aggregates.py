"""Aggregates, windows, top-k and source comparison reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid import settings as S
from parcelgrid.operators import asof, graph as G, matching as M, metrics, ranks, reports as R, rules, similar as SI
from parcelgrid.operators.keyed import first_per_key
from parcelgrid.plans import labels as L
from parcelgrid.queries.joins import (
    ABUT_SQL, CENTRES_SQL, NOTICE_SQL, REQUESTS_SQL, TARGET_SQL, ZONE_MEMBERS_SQL, centres, clusters, decision_notices,
    districts_of_dong, land_pct, members, requests)
from parcelgrid.queries.registry import EDGES_SQL, SCORES_SQL, big, node_edges, old_sql, query, r, scores_of
from parcelgrid.standins import Tables


def stock(t: Tables):
    return asof.building_stock(t.buildings)


@query("D1_old_ratio_by_parcel", f", {old_sql('2010')} SELECT pnu, round(old_ratio, 6) AS old_ratio FROM old_now", uses=("buildings",))
def d1(t: Tables):
    return asof.old_ratio_by_parcel(stock(t), 2010).select("pnu", r("old_ratio").alias("old_ratio"))


@query("D1_old_ratio_by_count", """
SELECT pnu, round(avg(CASE WHEN 2010 - approval_year >= CASE WHEN structure = 'rc' THEN 30 ELSE 20 END THEN 1.0 ELSE 0.0 END), 6) AS old_ratio
FROM buildings WHERE approval_year <= 2010 GROUP BY 1""", uses=("buildings",))
def d1_count(t: Tables):
    return asof.old_ratio_by_parcel(stock(t), 2010, weight="count").select("pnu", r("old_ratio").alias("old_ratio"))


GROUP_RATIO_SQL = """e AS (SELECT zone_id, gross_floor_area AS g, {t} - approval_year >= CASE WHEN structure = 'rc' THEN 30 ELSE 20 END AS old
 FROM zm JOIN buildings USING (pnu) WHERE approval_year <= {t}),
zr AS (SELECT zone_id, CASE WHEN count(*) = count(g) THEN sum(CASE WHEN old THEN g ELSE 0 END) / nullif(sum(g), 0)
 ELSE avg(CASE WHEN old THEN 1.0 ELSE 0.0 END) END AS old_ratio FROM e GROUP BY 1)"""


@query("D2_old_ratio_of_zones", f", {ZONE_MEMBERS_SQL}, {GROUP_RATIO_SQL.format(t=2026)}"
       " SELECT DISTINCT zone_id, round(old_ratio, 6) AS old_ratio FROM zm LEFT JOIN zr USING (zone_id)", uses=("parcels", "buildings", "zones"))
def d2(t: Tables):
    return asof.old_ratio_of_groups(stock(t), members(t), 2026, group="zone_id").select("zone_id", r("old_ratio").alias("old_ratio"))


@query("D3_building_density", """
SELECT p.pnu, round(coalesce(n / (w * w) * 10000, 0), 6) AS bldg_density FROM parcels p
LEFT JOIN (SELECT pnu, count(*) AS n FROM buildings WHERE approval_year <= 2012 GROUP BY 1) USING (pnu)""", uses=("parcels", "buildings"))
def d3(t: Tables):
    area = G.static_shape(t.shaped("parcels")).select("pnu", "area_m2")
    return asof.density_by_parcel(stock(t), area, 2012).select("pnu", r("bldg_density").alias("bldg_density"))


POS_SQL = """pos AS (SELECT pnu, arg_min(zone_id, (t, zone_id)) AS zone_id, min(t) AS t FROM zm JOIN zones USING (zone_id) GROUP BY 1),
done AS (SELECT zone_id FROM pos JOIN old_now USING (pnu) GROUP BY 1 HAVING avg(old_ratio) < 0.5)"""


@query("D4_contamination", f", {ZONE_MEMBERS_SQL}, {old_sql('2026')}, {POS_SQL}"
       " SELECT pnu, zone_id, zone_id IN (SELECT zone_id FROM done) AS contaminated FROM pos", uses=("parcels", "buildings", "zones"))
def d4(t: Tables):
    pos = L.positives(t.shaped("zones"), centres(t))
    return L.flag_contamination(pos, asof.old_ratio_by_parcel(stock(t), 2026)).select("pnu", "zone_id", "contaminated")


@query("D5_derived_negatives", f", {ZONE_MEMBERS_SQL}, {old_sql('2026')} SELECT pnu, CASE WHEN old_ratio < 0.2 THEN 'reliable_negative' ELSE 'uncertain' END AS certainty,"
       " CASE WHEN old_ratio < 0.2 THEN 'new_construction' ELSE 'not_yet' END AS neg_reason FROM old_now"
       " WHERE (old_ratio < 0.2 OR old_ratio >= 0.5) AND pnu NOT IN (SELECT pnu FROM zm)", uses=("parcels", "buildings", "zones"))
def d5(t: Tables):
    now = asof.old_ratio_by_parcel(stock(t), 2026)
    return L.derived_negatives(now, L.positives(t.shaped("zones"), centres(t))).select("pnu", "certainty", "neg_reason")


@query("D6_dong_districts", "SELECT DISTINCT CASE WHEN dong = '안암동2가' THEN '안암' ELSE left(dong, 2) END AS base, sigungu FROM parcels", uses=("parcels",))
def d6(t: Tables):
    return districts_of_dong(t)


@query("D7_first_decisions", NOTICE_SQL + "SELECT sigungu, token, date FROM fd", uses=("parcels",))
def d7(t: Tables):
    return M.first_decisions(M.title_events(decision_notices(t), districts_of_dong(t))).select("sigungu", "token", "date")


@query("D8_promotion_dates", NOTICE_SQL + "SELECT region AS parent, min(date) AS date FROM dn WHERE dec AND k = 2 AND region IN ('흑석', '장위') GROUP BY 1",
       uses=("parcels",))
def d8(t: Tables):
    return M.promotion_dates(decision_notices(t)).select("parent", "date")


@query("D9_dissolved_zones", """
SELECT zone_id, arg_min(zone_type, sk) AS zone_type, CAST(arg_min(t, sk) AS BIGINT) AS t, count(*) AS n_parts, round(sum(w * w), 4) AS area_m2
FROM (SELECT 'M' || (sk % 30) AS zone_id, zone_type, t, sk, w FROM zones) GROUP BY 1""", uses=("zones",))
def d9(t: Tables):
    parts = t.shaped("zones").withColumn("zone_id", F.concat(F.lit("M"), F.col("sk") % 30)).withColumn("part_no", F.col("sk"))
    d = L.dissolve_zones(parts, ["zone_type", "t"])
    return d.select("zone_id", "zone_type", big("t").alias("t"), "n_parts", r("area_m2", 4).alias("area_m2"))


@query("D10_dong_median", """
SELECT substr(pnu, 1, 10) AS dong, round(median(deal_amount / (land_share_m2 / 3.305785)), 4) AS dong_pyung, count(*) AS n
FROM trades WHERE trade_type = 'villa' AND land_share_m2 > 0 GROUP BY 1""", uses=("trades",))
def d10(t: Tables):
    from parcelgrid.functions.fields import villa_unit_prices
    from parcelgrid.operators.prices import dong_prices

    return dong_prices(villa_unit_prices(t.trades)).select("dong", r("dong_pyung", 4).alias("dong_pyung"), big("n").alias("n"))


HOPS_SQL = f""", {EDGES_SQL}, f AS (SELECT pnu, ck % 17 AS v, w AS u FROM nodes),
n1 AS (SELECT n.pnu, coalesce(avg(f.v), 0) AS mv, coalesce(max(f.v), 0) AS xv, coalesce(avg(f.u), 0) AS mu, coalesce(max(f.u), 0) AS xu
 FROM nodes n LEFT JOIN edges ON src = n.pnu LEFT JOIN f ON f.pnu = dst GROUP BY 1),
n2 AS (SELECT n.pnu, coalesce(avg(g.mv), 0) AS mv, coalesce(max(g.mv), 0) AS xv, coalesce(avg(g.mu), 0) AS mu, coalesce(max(g.mu), 0) AS xu
 FROM nodes n LEFT JOIN edges ON src = n.pnu LEFT JOIN n1 g ON g.pnu = dst GROUP BY 1)
"""


@query("D11_neighbour_features", HOPS_SQL + """
SELECT pnu, round(n1.mv, 6) AS nb1_mean_v, round(n1.xv, 6)::DOUBLE AS nb1_max_v, round(n1.mu, 6) AS nb1_mean_u, round(n1.xu, 6) AS nb1_max_u,
 round(n2.mv, 6) AS nb2_mean_v, round(n2.xv, 6) AS nb2_max_v, round(n2.mu, 6) AS nb2_mean_u, round(n2.xu, 6) AS nb2_max_u
FROM n1 JOIN n2 USING (pnu)""", uses=("parcels",))
def d11(t: Tables):
    f = G.node_parcels(t.parcels).select("pnu", (F.col("ck") % 17).cast("double").alias("v"), F.col("w").alias("u"))
    out = G.neighbour_features(f.select("pnu"), f, node_edges(t), ["v", "u"])
    return out.select("pnu", *[r(c).alias(c) for c in out.columns if c != "pnu"])


FACTS_SQL = f"""{ABUT_SQL},
gfa AS (SELECT pnu, count(*) AS nb, sum(coalesce(gross_floor_area, 0)) AS g FROM buildings GROUP BY 1)"""
METRICS_SQL = f""", {ZONE_MEMBERS_SQL}, {FACTS_SQL}, {GROUP_RATIO_SQL.format(t=2026)},
cm AS (SELECT zm.zone_id, count(*) AS n_parcels, sum(coalesce(nb, 0)) AS n_buildings, sum(w * w) / 10000 AS ha,
 avg(CASE WHEN a.pnu IS NULL THEN 0.0 ELSE 1.0 END) AS abut_ratio, avg(CASE WHEN w * w < 90 THEN 1.0 ELSE 0.0 END) AS undersized_ratio,
 avg(CASE WHEN coalesce(g, 0) / (w * w) < 1 THEN 1.0 ELSE 0.0 END) AS low_density_ratio
 FROM zm JOIN parcels USING (pnu) LEFT JOIN abut a USING (pnu) LEFT JOIN gfa USING (pnu) GROUP BY 1),
m AS (SELECT cm.*, n_buildings / ha AS house_density, old_ratio FROM cm LEFT JOIN zr USING (zone_id))
"""


def zone_metrics(t: Tables):
    p = t.shaped("parcels")
    facts = rules.parcel_facts(
        G.static_shape(p).select("pnu", "area_m2"), stock(t),
        road_abut=G.road_abutting(p, p.where(F.col("jimok") == S.ROAD_CLASS)))
    return rules.cluster_metrics(members(t).withColumnRenamed("zone_id", "cluster_id"), facts).withColumnRenamed("cluster_id", "zone_id")


@query("D12_cluster_metrics", METRICS_SQL + """
SELECT zone_id, n_parcels, CAST(n_buildings AS BIGINT) AS n_buildings, round(ha, 3) AS area_ha, round(old_ratio, 6) AS old_area_ratio, round(abut_ratio, 6) AS abut_ratio,
 round(house_density, 4) AS house_density, round(undersized_ratio, 6) AS undersized_ratio, round(low_density_ratio, 6) AS low_density_ratio FROM m""",
       uses=("parcels", "buildings", "zones"))
def d12(t: Tables):
    m = zone_metrics(t)
    return m.select("zone_id", big("n_parcels").alias("n_parcels"), "n_buildings", "area_ha", *[
        r(c, 4 if c == "house_density" else 6).alias(c) for c in (
            "old_area_ratio", "abut_ratio", "house_density", "undersized_ratio", "low_density_ratio")])


@query("D13_zone_display_names", f""", {ZONE_MEMBERS_SQL},
c AS (SELECT zone_id, gu || ' ' || dong AS a, count(*) AS n FROM zm JOIN parcels USING (pnu) GROUP BY 1, 2),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, a) = 1)
SELECT zone_id, a || ' 일대 (' || t || ')' AS display_name FROM b JOIN zones USING (zone_id)""", uses=("parcels", "zones"))
def d13(t: Tables):
    addr = t.parcels.selectExpr("pnu", "'서울특별시 ' || gu || ' ' || dong AS dong_addr")
    return SI.display_names(members(t), addr, t.zones.select("zone_id", "t"))


@query("D14_value_counts", "SELECT jimok AS value, count(*) AS n FROM parcels GROUP BY 1", uses=("parcels",))
def d14(t: Tables):
    return R.value_counts(t.parcels, "jimok")


@query("D15_score_distribution", f", {old_sql('2026')}, {SCORES_SQL} SELECT sigungu, count(*) AS n, round(median(score), 6) AS median,"
       " round(avg(score), 6) AS mean, round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS high_share FROM scores GROUP BY 1",
       uses=("parcels", "buildings"))
def d15(t: Tables):
    d = R.score_distribution(scores_of(t))
    return d.select("sigungu", big("n").alias("n"), r("median").alias("median"), r("mean").alias("mean"), r("high_share").alias("high_share"))


HOLD_SQL = """, z AS (SELECT zone_id, sigungu, region || '|' || no AS k, 2015 + sk % 10 AS year, sk % 11 = 10 AS keyless FROM notices),
a AS (SELECT DISTINCT sigungu, region || '|' || no AS k FROM notices WHERE sk % 3 = 0),
b AS (SELECT DISTINCT sigungu, region || '|' || no AS k FROM notices WHERE sk % 4 = 1),
h AS (SELECT z.*, NOT keyless AND (sigungu, k) IN (SELECT (sigungu, k) FROM a) AS fa, NOT keyless AND (sigungu, k) IN (SELECT (sigungu, k) FROM b) AS fb FROM z)
"""


@query("D16_holdout_bias", HOLD_SQL + """
SELECT sigungu, count(*) AS n, count(*) FILTER (NOT fa AND NOT fb) AS n_held, round(avg(CASE WHEN NOT fa AND NOT fb THEN 1.0 ELSE 0.0 END), 6) AS held_rate,
 count(*) FILTER (fa AND NOT fb) AS first_only, count(*) FILTER (fb AND NOT fa) AS second_only, count(*) FILTER (fa AND fb) AS both,
 count(*) FILTER (NOT fa AND NOT fb AND keyless) AS reason_no_key, count(*) FILTER (NOT fa AND NOT fb AND NOT keyless AND year >= 2022) AS reason_recent,
 count(*) FILTER (NOT fa AND NOT fb AND NOT keyless AND year < 2022) AS reason_old FROM h GROUP BY 1""", uses=("notices",))
def d16(t: Tables):
    zones = t.notices.selectExpr(
        "zone_id", "sigungu", "CASE WHEN sk % 11 = 10 THEN '도시계획 변경' ELSE region || '제' || no || ' 주택재개발 정비구역' END AS title",
        "2015 + sk % 10 AS year")
    first = t.notices.where("sk % 3 = 0").selectExpr("sigungu", "region || no || '구역 재개발조합' AS name")
    second = t.notices.where("sk % 4 = 1").selectExpr("sigungu", "region || ' ' || no || ' 일대' AS name")
    out = R.holdout_rates(R.holdout_bias(zones, first, second))
    return out.withColumn("held_rate", r("held_rate"))


PATH_SQL = METRICS_SQL.rstrip() + """,
k AS (SELECT m.*, coalesce(old_ratio >= 0.6, false) AS old_ok, coalesce(abut_ratio <= 0.4, false) AS abut_ok, coalesce(house_density >= 60, false) AS dens_ok,
 coalesce(old_ratio >= 0.3, false)::INT + coalesce(undersized_ratio >= 0.4, false)::INT + coalesce(low_density_ratio >= 0.5, false)::INT AS c FROM m),
path AS (SELECT zone_id, old_ok AND abut_ok AS housing_eligible, c >= 2 AS urban_eligible,
 (old_ok AND (abut_ok OR dens_ok)) OR c >= 2 AS pass_a, (old_ok AND abut_ok) OR c >= 2 AS pass_b,
 CASE WHEN (old_ok AND abut_ok) OR c >= 2 THEN '재개발' WHEN coalesce(old_ratio >= 0.5, false) THEN '모아타운·소규모정비' ELSE '해당없음' END AS path,
 '호수밀도 ' || printf('%.0f', house_density) || CASE WHEN dens_ok THEN ' ≥ ' ELSE ' < ' END || '60' AS density_reason FROM k)
"""


@query("E10_path_rules", PATH_SQL + "SELECT zone_id, path, housing_eligible, urban_eligible, density_reason FROM path", uses=("parcels", "buildings", "zones"))
def e10(t: Tables):
    c = rules.classify(zone_metrics(t))
    return c.select("zone_id", "path", "housing_eligible", "urban_eligible", F.col("housing_reasons")[2].alias("density_reason"))


@query("D17_pass_rates", PATH_SQL + """
SELECT zone_type, CASE WHEN t < 2010 THEN '~2009' WHEN t < 2020 THEN '2010-19' ELSE '2020+' END AS era, grouping(zone_type, era) AS level, count(*) AS n,
 count(*) FILTER (path = '재개발') AS redevelopment, round(count(*) FILTER (path = '재개발') / count(*), 6) AS pass_rate
FROM path JOIN zones USING (zone_id) GROUP BY CUBE (zone_type, era)""", uses=("parcels", "buildings", "zones"))
def d17(t: Tables):
    c = rules.classify(zone_metrics(t)).join(t.zones.select("zone_id", "zone_type", "t"), "zone_id")
    out = rules.zone_type_pass_rates(c)
    return out.select("zone_type", "era", big("level").alias("level"), "n", "redevelopment", r("pass_rate").alias("pass_rate"))


@query("D18_source_comparison", """
, o AS (SELECT *, 2026 - approval_year >= CASE WHEN structure = 'rc' THEN 30 ELSE 20 END AS old, coalesce(gross_floor_area, 0) AS g FROM buildings),
a AS (SELECT pnu, sum(CASE WHEN old THEN g ELSE 0 END) / nullif(sum(g), 0) AS v FROM o WHERE ok % 4 <> 1 AND approval_year <= 2026 GROUP BY 1),
b AS (SELECT pnu, sum(CASE WHEN old THEN g ELSE 0 END) / nullif(sum(g), 0) AS v FROM o WHERE ok % 4 <> 2 AND ok % 10 < 9 AND approval_year <= 2026 GROUP BY 1),
j AS (SELECT a.v AS av, b.v AS bv, abs(b.v - a.v) AS d FROM a FULL JOIN b USING (pnu)), x AS (SELECT * FROM j WHERE d IS NOT NULL)
SELECT count(*) AS n_both, round(avg(d), 6) AS mean_diff, round(max(d), 6) AS max_diff, round(avg(CASE WHEN d > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS over_5,
 round(avg(CASE WHEN d < 0.001 THEN 1.0 ELSE 0.0 END), 6) AS same, round(avg(CASE WHEN bv < av THEN 1.0 ELSE 0.0 END), 3) AS b_lower, round(median(d), 6) AS median_diff,
 (SELECT count(*) FROM j WHERE bv IS NULL) AS only_a, (SELECT count(*) FROM j WHERE av IS NULL) AS only_b FROM x""", uses=("buildings",))
def d18(t: Tables):
    a = asof.old_ratio_by_parcel(asof.building_stock(t.buildings.where("ok % 4 <> 1")), 2026)
    b = asof.old_ratio_by_parcel(asof.building_stock(t.buildings.where("ok % 4 <> 2 AND ok % 10 < 9")), 2026)
    # Equal sums may differ in the last bit, so the one-sided share keeps three digits.
    d = R.ratio_differences(a, b, "old_ratio")
    return d.select("n_both", *[r(c).alias(c) for c in ("mean_diff", "max_diff", "over_5", "same")], r("b_lower", 3).alias("b_lower"),
                    r("median_diff").alias("median_diff"), "only_a", "only_b")


USE = "CASE ok % 5 WHEN 0 THEN '단독주택' WHEN 1 THEN '창고' WHEN 2 THEN NULL WHEN 3 THEN '아파트' ELSE '사무소' END"
LOST_SQL = """, p AS (SELECT pnu, bool_or(ok % 5 IN (0, 3)) AS res, count(*) AS n FROM buildings GROUP BY 1),
lost AS (SELECT *, substr(pnu, 1, 5) AS gu FROM p WHERE pnu NOT IN (SELECT pnu FROM buildings WHERE ok % 6 = 0))
"""


@query("D19_lost_coverage", LOST_SQL + """
, a AS (SELECT gu, count(*) AS n_lost, avg(res::INT) AS rs FROM lost GROUP BY 1), b AS (SELECT substr(pnu, 1, 5) AS gu, count(*) AS n_every FROM p GROUP BY 1)
SELECT gu, n_every, coalesce(n_lost, 0) AS n_lost, round(rs, 6) AS residential_share, round(coalesce(n_lost, 0) / n_every, 6) AS loss_rate,
 round((coalesce(n_lost, 0) / (SELECT count(*) FROM lost)) / (n_every / (SELECT count(*) FROM p)), 6) AS skew FROM b LEFT JOIN a USING (gu)""", uses=("buildings",))
def d19(t: Tables):
    b = t.buildings.withColumn("use_type", F.expr(USE))
    lost = R.lost_coverage(b, t.buildings.where("ok % 6 = 0"))
    out = R.loss_skew(lost, b)
    return out.select("gu", "n_every", "n_lost", *[r(c).alias(c) for c in ("residential_share", "loss_rate", "skew")])


def building_points(t: Tables, where: str = "true"):
    """Buildings at a spot inside their parcel."""
    return t.buildings.where(where).selectExpr(
        "ok AS point_id", "CAST(20 * (ck % 25) + 3 + ok % 11 AS DOUBLE) AS x", "CAST(20 * (ck div 25) + 4 + ok % 7 AS DOUBLE) AS y",
        "gross_floor_area AS gfa", "ok % 5 = 3 AS shared")


BPOINTS_SQL = """bp AS (SELECT ok, 20 * (ck % 25) + 3 + ok % 11 AS x, 20 * (ck // 25) + 4 + ok % 7 AS y, gross_floor_area AS gfa, ok % 5 = 3 AS shared FROM buildings),
bz AS (SELECT zone_id, bp.* FROM bp JOIN zones z ON x > x0 AND x < x0 + w AND y > y0 AND y < y0 + w)"""


@query("D20_density_flips", f""", {BPOINTS_SQL}, d AS (SELECT zone_id, count(*) FILTER (ok % 4 <> 1) / 0.4225 AS da, count(*) FILTER (ok % 3 = 0) / 0.4225 AS db FROM bz GROUP BY 1),
z AS (SELECT zone_id, coalesce(da, 0) AS da, coalesce(db, 0) AS db FROM zones LEFT JOIN d USING (zone_id))
SELECT count(*) AS n_zones, count(*) FILTER (da >= 120) AS pass_a, count(*) FILTER (db >= 120) AS pass_b,
 count(*) FILTER (da >= 120 AND db < 120) AS lost, count(*) FILTER (db >= 120 AND da < 120) AS gained FROM z""", uses=("buildings", "zones"))
def d20(t: Tables):
    z = t.shaped("zones")
    return R.threshold_flips(R.zone_density(z, building_points(t, "ok % 4 <> 1")), R.zone_density(z, building_points(t, "ok % 3 = 0")), 120.0)


@query("D21_dwelling_density", f""", {BPOINTS_SQL}
SELECT zone_id, round(coalesce(s, 0) / 0.4225, 4) AS density FROM zones LEFT JOIN (SELECT zone_id,
 sum(CASE WHEN shared THEN greatest(1, coalesce(gfa, 0) / 70) ELSE 1 END) AS s FROM bz GROUP BY 1) USING (zone_id)""", uses=("buildings", "zones"))
def d21(t: Tables):
    w = R.dwelling_weight(F.col("shared"), F.coalesce("gfa", F.lit(0.0)))
    return R.zone_density(t.shaped("zones"), building_points(t), weight=w).select("zone_id", r("density", 4).alias("density"))


@query("D22_rule_change", PATH_SQL + "SELECT zone_id, pass_a, pass_b, pass_a AND NOT pass_b AS rescued FROM path", uses=("parcels", "buildings", "zones"))
def d22(t: Tables):
    return rules.rule_change_impact(zone_metrics(t)).select("zone_id", "pass_a", "pass_b", "rescued")


@query("D23_degrees", f", {EDGES_SQL}, d AS (SELECT src, count(*) AS degree FROM edges GROUP BY 1) SELECT degree, count(*) AS n FROM d GROUP BY 1", uses=("parcels",))
def d23(t: Tables):
    return G.degrees(node_edges(t)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@query("D26_zone_score_profile", f""", {old_sql('2026')}, {SCORES_SQL}, {ZONE_MEMBERS_SQL},
sp AS (SELECT pnu, (rank() OVER (PARTITION BY sigungu ORDER BY score) + (count(*) OVER (PARTITION BY sigungu, score) - 1) / 2.0) / count(*) OVER (PARTITION BY sigungu) AS p FROM scores)
SELECT zone_id, round(avg((p >= 0.9)::INT), 6) AS top10, round(avg((p >= 0.7)::INT), 6) AS top30, round(avg((p >= 0.5)::INT), 6) AS top50, round(median(p), 6) AS median_pct, count(*) AS n
FROM zm JOIN sp USING (pnu) GROUP BY 1""", uses=("parcels", "buildings", "zones"))
def d26(t: Tables):
    s = ranks.with_percentile(scores_of(t), ["sigungu"], "score", "score_pct")
    out = R.zone_score_profile(members(t), s, "zone_id")
    return out.select("zone_id", *[r(c).alias(c) for c in ("top10", "top30", "top50", "median_pct")], big("n").alias("n"))


@query("D27_over_prediction", f", {old_sql('2026')}, {SCORES_SQL} SELECT count(*) AS n_all, round(avg((score >= 0.618)::INT), 6) AS positive_share,"
       " round(median(score), 6) AS median FROM scores", uses=("parcels", "buildings"))
def d27(t: Tables):
    o = R.over_prediction(scores_of(t), 0.618)
    return o.select("n_all", r("positive_share").alias("positive_share"), r("median").alias("median"))


VEC_SQL = """SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v))) AS n FROM embeddings"""


def unit_vectors(t: Tables, key: str):
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    return t.source("embeddings").select(big("vec_id").alias(key), SI.unit(v).alias("vec"))


@query("D28_vector_shift", f"""
WITH u AS ({VEC_SQL}) SELECT vec_id AS zone_id, round(sqrt(list_sum(list_transform(list_zip(e, list_reverse(e)), lambda p: pow(p[1]::DOUBLE / n - p[2]::DOUBLE / n, 2)))), 6) AS shift FROM u""")
def d28(t: Tables):
    a = unit_vectors(t, "zone_id")
    return SI.vector_shift(a, a.select("zone_id", F.reverse("vec").alias("vec"))).select("zone_id", r("shift").alias("shift"))


@query("D29_column_profile", """
SELECT 'l_quantity' AS column, count(*) AS n, round(avg((l_quantity BETWEEN 2 AND 30)::INT), 6) AS in_range, round(avg((l_quantity = round(l_quantity))::INT), 6) AS whole FROM lineitem
UNION ALL SELECT 'l_discount', count(*), round(avg((l_discount BETWEEN 2 AND 30)::INT), 6), round(avg((l_discount = round(l_discount))::INT), 6) FROM lineitem
UNION ALL SELECT 'l_partkey', count(*), round(avg((l_partkey BETWEEN 2 AND 30)::INT), 6), 1.0 FROM lineitem""")
def d29(t: Tables):
    p = R.column_profile(t.source("lineitem"), ["l_quantity", "l_discount", "l_partkey"], low=2, high=30)
    return p.withColumns({"in_range": r("in_range"), "whole": r("whole")})


@query("D30_control_circles", f""", {BPOINTS_SQL}, pick AS (SELECT DISTINCT CAST(floor(i * ((SELECT count(*) FROM bp) - 1) / 199.0) AS BIGINT) AS ok FROM range(200) r(i)),
c AS (SELECT bp.* FROM bp JOIN pick USING (ok) WHERE ok NOT IN (SELECT ok FROM bz))
SELECT c.ok AS point_id, round(count(b.ok) / (pi() * 2500 / 10000), 4) AS density FROM c LEFT JOIN bp b ON pow(b.x - c.x, 2) + pow(b.y - c.y, 2) <= 2500 GROUP BY 1""",
       uses=("buildings", "zones"))
def d30(t: Tables):
    pts = building_points(t)
    ctrl = R.control_points(pts, t.shaped("zones"), samples=200, order="point_id")
    d = R.circle_density(ctrl, pts, 50.0)
    return d.select(big("point_id").alias("point_id"), r("density", 4).alias("density"))


RANK_SQL = "(rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0) / count(*) OVER (PARTITION BY {g})"


@query("W1_land_percentile", f""", yearly AS (SELECT pnu, year, substr(pnu, 1, 5) AS gu, round(sum(part), 2) AS price FROM prices GROUP BY 1, 2)
SELECT pnu, CAST(year AS BIGINT) AS year, round({RANK_SQL.format(g='year, gu', v='price')}, 6) AS pct FROM yearly""", uses=("prices",))
def w1(t: Tables):
    return land_pct(t).select("pnu", big("year").alias("year"), r("pct").alias("pct"))


@query("W2_district_percentile", f", {old_sql('2026')}, {SCORES_SQL} SELECT pnu, round({RANK_SQL.format(g='sigungu', v='score')}, 6) AS score_pct FROM scores",
       uses=("parcels", "buildings"))
def w2(t: Tables):
    return ranks.with_percentile(scores_of(t), ["sigungu"], "score", "score_pct").select("pnu", r("score_pct").alias("score_pct"))


@query("W3_heatmap_percentile", f", {old_sql('2026')}, {SCORES_SQL} SELECT pnu, round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)"
       " / count(*) OVER () * 100, 6) AS heat FROM scores", uses=("parcels", "buildings"))
def w3(t: Tables):
    return ranks.with_percentile(scores_of(t), [], "score", "heat", scale=100.0).select("pnu", r("heat").alias("heat"))


@query("W4_resolve_conflicts", """
SELECT pnu, CAST(2010 + ok % 4 AS BIGINT) AS t, CASE min(CASE ok % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END)
 WHEN 0 THEN 'positive' WHEN 1 THEN 'reliable_negative' ELSE 'uncertain' END AS certainty FROM buildings GROUP BY 1, 2""", uses=("buildings",))
def w4(t: Tables):
    rows = t.buildings.selectExpr(
        "pnu", "CAST(2010 + ok % 4 AS INT) AS t", "CASE ok % 3 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'positive' ELSE 'reliable_negative' END AS certainty",
        "structure AS source", "CAST(ok AS STRING) AS zone_id")
    return L.resolve_conflicts(rows).select("pnu", big("t").alias("t"), "certainty")


@query("W5_first_and_last", """
SELECT pnu, min(ok) AS first_ok, CAST(arg_min(approval_year, ok) AS BIGINT) AS first_year, max(ok) AS last_ok FROM buildings GROUP BY 1""", uses=("buildings",))
def w5(t: Tables):
    b = t.buildings.select("pnu", "ok", "approval_year")
    first = first_per_key(b, ["pnu"], [F.col("ok")]).select("pnu", big("ok").alias("first_ok"), big("approval_year").alias("first_year"))
    last = first_per_key(b, ["pnu"], [-F.col("ok")]).select("pnu", big("ok").alias("last_ok"))
    return first.join(last, "pnu")


@query("W6_reference_rank", f", {old_sql('2026')}, {SCORES_SQL} SELECT pnu, round(100 * (1 - (rank() OVER (ORDER BY score) - 1) / count(*) OVER ()), 1) AS rank_top_pct FROM scores",
       uses=("parcels", "buildings"))
def w6(t: Tables):
    from parcelgrid.plans.assess import score_ranks

    return score_ranks(scores_of(t)).select("pnu", "rank_top_pct")


@query("W7_curve", """
, s AS (SELECT p, sum(y) AS tp, count(*) AS n FROM judged GROUP BY 1)
SELECT round(p, 9) AS p, CAST(sum(tp) OVER (ORDER BY p DESC) AS BIGINT) AS cum_tp, CAST(sum(n) OVER (ORDER BY p DESC) AS BIGINT) AS cum_n FROM s""", uses=("judged",))
def w7(t: Tables):
    return metrics.curve(t.judged, []).select(r("p", 9).alias("p"), big("cum_tp").alias("cum_tp"), big("cum_n").alias("cum_n"))


@query("T1_screener", f""", {old_sql('2026')}, {SCORES_SQL}, q AS (SELECT pnu, sigungu, score, {RANK_SQL.format(g='sigungu', v='score')} AS score_pct FROM scores)
SELECT pnu, sigungu, round(100 * (1 - score_pct), 1) AS rank_pct FROM q WHERE score_pct >= 0.5 ORDER BY score DESC, pnu LIMIT 50""", uses=("parcels", "buildings"))
def t1(t: Tables):
    s = ranks.with_percentile(scores_of(t), ["sigungu"], "score", "score_pct")
    return ranks.screen(s, min_pct=0.5, k=50)


TOPK_SQL = f"""WITH u AS (SELECT vec_id, label, list_transform(e, lambda v: v::DOUBLE / n) AS e FROM ({VEC_SQL.replace('SELECT vec_id', 'SELECT vec_id, label')})),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS case_id, b.label AS t, list_dot_product(a.e, b.e) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id OR a.vec_id = b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, case_id) AS rank FROM s QUALIFY rank <= 3)
"""


@query("T2_cosine_topk", TOPK_SQL + "SELECT query_id, case_id, rank, round(sim, 6) AS similarity FROM k")
def t2(t: Tables):
    m = SI.cosine_topk(unit_vectors(t, "query_id"), unit_vectors(t, "case_id"), k=3)
    return m.select("query_id", "case_id", big("rank").alias("rank"), r("similarity").alias("similarity"))


@query("T2_zone_cases", METRICS_SQL + """
, st AS (SELECT avg(old_ratio) AS m1, stddev_pop(old_ratio) AS s1, avg(round(ha, 3)) AS m2, stddev_pop(round(ha, 3)) AS s2, avg(house_density) AS m3, stddev_pop(house_density) AS s3,
 avg(abut_ratio) AS m4, stddev_pop(abut_ratio) AS s4 FROM m),
z AS (SELECT zone_id, [coalesce((old_ratio - m1) / nullif(s1, 0), 0), coalesce((round(ha, 3) - m2) / nullif(s2, 0), 0), coalesce((house_density - m3) / nullif(s3, 0), 0), coalesce((abut_ratio - m4) / nullif(s4, 0), 0)] AS v FROM m, st),
u AS (SELECT zone_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM z),
k AS (SELECT a.zone_id AS query_id, b.zone_id AS case_id, list_dot_product(a.v, b.v) AS sim,
 list_sort(list_transform(generate_series(1, 4), lambda i: {'o': -(a.v[i] * b.v[i]), 'i': i})) AS parts FROM u a, u b
 QUALIFY row_number() OVER (PARTITION BY a.zone_id ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.zone_id) <= 3)
SELECT query_id, case_id, round(sim, 4) AS similarity,
 array_to_string(list_transform(list_filter(parts, lambda p: p.o < 0)[1:2], lambda p: ['노후도', '면적', '호수밀도', '접도율'][p.i]), ' ') AS top_axes
FROM k WHERE query_id <> case_id""", uses=("parcels", "buildings", "zones"))
def t2_zones(t: Tables):
    from parcelgrid.session import durable

    v = durable(SI.zone_vectors(zone_metrics(t)))
    q, c = v.select(F.col("zone_id").alias("query_id"), "vec"), v.select(F.col("zone_id").alias("case_id"), "vec")
    m = SI.with_top_axes(SI.cosine_topk(q, c, k=3), q, c).where("query_id <> case_id")
    return m.select("query_id", "case_id", r("similarity", 4).alias("similarity"), F.array_join("top_axes", " ").alias("top_axes"))


@query("T3_recency_order", TOPK_SQL + "SELECT query_id, case_id, row_number() OVER (PARTITION BY query_id ORDER BY t DESC NULLS LAST, rank) AS recency_rank FROM k")
def t3(t: Tables):
    m = SI.cosine_topk(unit_vectors(t, "query_id"), unit_vectors(t, "case_id"), k=3)
    years = t.source("embeddings").select(big("vec_id").alias("case_id"), F.col("label").alias("t"))
    return SI.by_recency(m.join(years, "case_id")).select("query_id", "case_id", big("recency_rank").alias("recency_rank"))


@query("T4_percentile_cut", f", {old_sql('2026')}, {SCORES_SQL} SELECT sigungu, round(quantile_cont(score, 0.9), 6) AS cut FROM scores GROUP BY 1", uses=("parcels", "buildings"))
def t4(t: Tables):
    q = ranks.exact_quantiles(scores_of(t), ["sigungu"], "score", {"cut": 1 - S.TIGHT_TOP_PCT / 100})
    return q.select("sigungu", r("cut").alias("cut"))


@query("T5_lowest_per_district", f", {old_sql('2026')}, {SCORES_SQL} SELECT sigungu, pnu, row_number() OVER (PARTITION BY sigungu ORDER BY score, pnu) AS rank FROM scores QUALIFY rank <= 3",
       uses=("parcels", "buildings"))
def t5(t: Tables):
    return ranks.extremes_per_group(scores_of(t), "sigungu", "score", "pnu", 3).select("sigungu", "pnu", big("rank").alias("rank"))


@query("D24_list_agreement", TOPK_SQL + """
, a AS (SELECT query_id, case_id, rank FROM k), b AS (SELECT query_id, (case_id + rank % 2) AS case_id, rank FROM k),
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, a.rank AS ra, b.rank AS rb FROM a FULL JOIN b ON a.query_id = b.query_id AND a.case_id = b.case_id)
SELECT query_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS n_shared, max(CASE WHEN ra = 1 AND rb = 1 THEN 1 ELSE 0 END)::BIGINT AS same_first,
 CAST(min(CASE WHEN ra IS DISTINCT FROM rb THEN least(coalesce(ra, rb), coalesce(rb, ra)) END) AS DOUBLE) AS diverges_at FROM j GROUP BY 1""")
def d24(t: Tables):
    m = SI.cosine_topk(unit_vectors(t, "query_id"), unit_vectors(t, "case_id"), k=3).select("query_id", "case_id", "rank")
    other = m.select("query_id", (F.col("case_id") + F.col("rank") % 2).alias("case_id"), "rank")
    out = SI.list_agreement(m, other)
    return out.select("query_id", "n_shared", big("same_first").alias("same_first"), F.col("diverges_at").cast("double").alias("diverges_at"))
