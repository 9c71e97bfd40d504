"""Address, spatial, as-of and matching joins, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid import settings as S
from parcelgrid.functions import titles as N
from parcelgrid.operators import asof, graph as G, matching as M, metrics, prices as P
from parcelgrid.operators.cells import nearest_site, point_in_polygon, polygon_overlap, radius_join, square_grid
from parcelgrid.operators.keyed import new_rows, overlap_report
from parcelgrid.plans import features as FE, labels as L
from parcelgrid.queries.ingest import lots
from parcelgrid.queries.registry import EDGES_SQL, REACH_SQL, SCORES_SQL, big, node_edges, old_sql, query, r, scores_of, shared
from parcelgrid.session import durable
from parcelgrid.standins import DISTRICTS, Tables



def centres(t: Tables):
    half = F.col("w") / 2
    return t.parcels.select("pnu", "sigungu", "ck", (F.col("x0") + half).alias("x"), (F.col("y0") + half).alias("y"))


CENTRES_SQL = "centres AS (SELECT pnu, sigungu, ck, x0 + w / 2 AS x, y0 + w / 2 AS y FROM parcels)"


def requests(t: Tables):
    """Three (pnu, year) rows per parcel."""
    return t.parcels.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).selectExpr(
        "pnu", "CAST(2001 + (ck * 7 + k * 5) % 26 AS INT) AS t")


REQUESTS_SQL = "requests AS (SELECT pnu, CAST(2001 + (ck * 7 + k * 5) % 26 AS INT) AS t FROM parcels, range(3) r(k))"


@query("C1_lot_lookup", """
SELECT ck, CASE WHEN ck % 4 = 3 THEN NULL ELSE pnu END AS found, ck % 4 <> 3 AND dong = '상도동' AS by_legal FROM parcels""",
       uses=("parcels",))
def c1(t: Tables):
    rows = t.parcels.selectExpr(
        "ck", "sigungu", "CASE WHEN ck % 4 = 3 THEN '없는동' WHEN dong = '상도동' THEN '상도2동' ELSE dong END"
        " || main_no || '-' || sub_no AS loc")
    return M.locate(rows, lots(t), F.col("loc"), out="found").select(big("ck").alias("ck"), "found", "by_legal")


@query("C2_points_in_zones", """
SELECT p.pnu, arg_min(z.zone_id, (z.t, z.zone_id)) AS zone_id, CAST(min(z.t) AS BIGINT) AS t FROM parcels p JOIN zones z
 ON p.x0 + p.w / 2 > z.x0 AND p.x0 + p.w / 2 < z.x0 + z.w AND p.y0 + p.w / 2 > z.y0 AND p.y0 + p.w / 2 < z.y0 + z.w GROUP BY 1""",
       uses=("parcels", "zones"))
def c2(t: Tables):
    pos = L.positives(t.shaped("zones"), durable(L.inner_points(t.shaped("parcels"))))
    return pos.select("pnu", "zone_id", big("t").alias("t"))


ORD_SQL = ("CASE a6 WHEN '제1종일반주거지역' THEN 3 WHEN '제2종일반주거지역' THEN 4 WHEN '제3종일반주거지역' THEN 5"
           " WHEN '준주거지역' THEN 6 END")
ZONING_SQL = f""", zhit AS (SELECT p.pnu, z.a6, {ORD_SQL} AS o FROM parcels p JOIN zoning z
 ON p.x0 + p.w / 2 > z.x0 AND p.x0 + p.w / 2 < z.x0 + z.w AND p.y0 + p.w / 2 > z.y0 AND p.y0 + p.w / 2 < z.y0 + z.w),
zbest AS (SELECT * FROM zhit QUALIFY row_number() OVER (PARTITION BY pnu ORDER BY o NULLS LAST, a6) = 1)
"""


@query("C3_zoning_of_parcels", ZONING_SQL + """
SELECT p.pnu, coalesce(o, 0)::DOUBLE AS zoning_ord, CASE WHEN a6 IS NULL THEN 1 ELSE 0 END::BIGINT AS zoning_missing, a6 AS zoning_name
FROM parcels p LEFT JOIN zbest USING (pnu)""", uses=("parcels", "zoning"))
def c3(t: Tables):
    z = FE.zoning_at(durable(L.inner_points(t.shaped("parcels"))), t.shaped("zoning"))
    return z.withColumn("zoning_missing", big("zoning_missing"))


@query("C4_adjacency", f", {EDGES_SQL} SELECT src, dst FROM edges", uses=("parcels",))
def c4(t: Tables):
    return node_edges(t)


ABUT_SQL = """abut AS (SELECT DISTINCT p.pnu FROM parcels p JOIN parcels q ON q.jimok = '도' AND p.pnu <> q.pnu
 AND q.x0 BETWEEN p.x0 - 40 AND p.x0 + 40 AND q.y0 BETWEEN p.y0 - 40 AND p.y0 + 40
 AND greatest(p.x0, q.x0) <= least(p.x0 + p.w, q.x0 + q.w) AND greatest(p.y0, q.y0) <= least(p.y0 + p.w, q.y0 + q.w))"""


@query("C5_road_abutting", f", {ABUT_SQL} SELECT p.pnu, CASE WHEN a.pnu IS NULL THEN 0 ELSE 1 END::BIGINT AS road_abut"
       " FROM parcels p LEFT JOIN abut a USING (pnu)", uses=("parcels",))
def c5(t: Tables):
    p = t.shaped("parcels")
    return G.road_abutting(p, p.where(F.col("jimok") == S.ROAD_CLASS)).select("pnu", big("road_abut").alias("road_abut"))


VILLA_SQL = """villa AS (SELECT pnu, deal_amount / (land_share_m2 / 3.305785) AS pyung FROM trades
 WHERE trade_type = 'villa' AND land_share_m2 > 0 AND deal_ym >= 199901)"""
TARGET_SQL = f""", {CENTRES_SQL}, {VILLA_SQL},
v AS (SELECT villa.*, c.x, c.y, substr(pnu, 1, 10) AS dong FROM villa JOIN centres c USING (pnu)),
near AS (SELECT c.pnu, v.pyung, pow(c.x - v.x, 2) + pow(c.y - v.y, 2) <= 2500 AS n50 FROM centres c JOIN v
 ON abs(c.x - v.x) <= 100 AND abs(c.y - v.y) <= 100 AND pow(c.x - v.x, 2) + pow(c.y - v.y, 2) <= 10000),
agg AS (SELECT pnu, count(*) FILTER (n50) AS c50, median(pyung) FILTER (n50) AS m50, count(*) AS c100, median(pyung) AS m100 FROM near GROUP BY 1),
d AS (SELECT dong, median(pyung) AS md, count(*) AS cd FROM v GROUP BY 1),
target AS (SELECT c.pnu, CASE WHEN c50 >= 1 THEN m50 WHEN c100 >= 1 THEN m100 ELSE md END AS target_pyung,
 CASE WHEN c50 >= 1 THEN 'r50' WHEN c100 >= 1 THEN 'r100' WHEN md IS NOT NULL THEN 'dong' ELSE 'missing' END AS agg_level,
 CASE WHEN c50 >= 1 THEN c50 WHEN c100 >= 1 THEN c100 ELSE coalesce(cd, 0) END AS n_trades
 FROM centres c LEFT JOIN agg USING (pnu) LEFT JOIN d ON d.dong = substr(c.pnu, 1, 10))
"""


@query("C6_price_target", TARGET_SQL + "SELECT pnu, round(target_pyung, 4) AS target_pyung, agg_level, n_trades FROM target",
       uses=("parcels", "trades"))
def c6(t: Tables):
    p = P.price_target(centres(t), t.trades, current_ym=200201)
    return p.withColumns({"target_pyung": r("target_pyung", 4), "n_trades": big("n_trades")})


@query("C7_comparable_newbuild", f""", {CENTRES_SQL},
a AS (SELECT c.x, c.y, deal_amount / (area_m2 / 3.305785) AS pyung FROM trades JOIN centres c USING (pnu)
 WHERE trade_type = 'apt' AND 2026 - build_year <= 10),
g AS (SELECT c.pnu, count(*) AS n, median(a.pyung) AS m FROM centres c JOIN a
 ON pow(c.x - a.x, 2) + pow(c.y - a.y, 2) <= 1000000 GROUP BY 1)
SELECT c.pnu, CASE WHEN n >= 3 THEN round(m, 4) END AS comp_pyung, CASE WHEN n >= 3 THEN n ELSE 0 END AS n_trades
FROM centres c LEFT JOIN g USING (pnu)""", uses=("parcels", "trades"))
def c7(t: Tables):
    p = P.comparable_newbuild(centres(t), t.trades)
    return p.withColumns({"comp_pyung": r("comp_pyung", 4), "n_trades": big("n_trades")})


RAIL_SQL = """rail AS (SELECT q.pnu, q.t, min(sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2))) AS d FROM requests q JOIN centres c USING (pnu)
 JOIN stations s ON s.open_year <= least(q.t, 2026) GROUP BY 1, 2)"""


@query("C8_nearest_station_as_of", f""", {CENTRES_SQL}, {REQUESTS_SQL}, {RAIL_SQL}
SELECT DISTINCT q.pnu, CAST(q.t AS BIGINT) AS t, round(d, 4) AS rail_dist_m, round(1 - least(greatest(d / 1000, 0), 1), 6) AS rail_prox
FROM requests q LEFT JOIN rail USING (pnu, t)""", uses=("parcels", "stations"))
def c8(t: Tables):
    out = asof.rail_as_of(requests(t).distinct(), centres(t), t.stations)
    return out.select("pnu", big("t").alias("t"), r("rail_dist_m", 4).alias("rail_dist_m"), r("rail_prox").alias("rail_prox"))


@query("C9_nearest_distance", f""", {CENTRES_SQL}
SELECT c.pnu, round(min(sqrt(pow(c.x - z.x0, 2) + pow(c.y - z.y0, 2))), 4) AS dist FROM centres c, zones z GROUP BY 1""",
       uses=("parcels", "zones"))
def c9(t: Tables):
    sites = t.zones.select(F.col("x0").alias("sx"), F.col("y0").alias("sy"))
    near = nearest_site(centres(t).select("pnu", "x", "y"), sites, point_id=["pnu"])
    return near.select("pnu", r("dist", 4).alias("dist"))


@query("C9_within_buffer", f""", {CENTRES_SQL}
SELECT DISTINCT c.pnu FROM centres c JOIN zones z ON pow(c.x - z.x0, 2) + pow(c.y - z.y0, 2) < 40000""", uses=("parcels", "zones"))
def c9_buffer(t: Tables):
    right = t.zones.select(F.col("x0").alias("rx"), F.col("y0").alias("ry"))
    return radius_join(centres(t).select("pnu", "x", "y"), right, 200.0, left_id="pnu", strict=True).select("pnu").distinct()


@query("C10_building_snapshot", f""", {REQUESTS_SQL}
SELECT q.pnu, CAST(q.t AS BIGINT) AS t, count(*) AS n_existing FROM (SELECT DISTINCT * FROM requests) q JOIN buildings b
 ON b.pnu = q.pnu AND approval_year <= q.t GROUP BY 1, 2""", uses=("parcels", "buildings"))
def c10(t: Tables):
    out = asof.stock_as_of(asof.building_stock(t.buildings), requests(t))
    return out.select("pnu", big("t").alias("t"), big("n_existing").alias("n_existing"))


PCT_SQL = """yearly AS (SELECT pnu, year, substr(pnu, 1, 5) AS gu, round(sum(part), 2) AS price FROM prices GROUP BY 1, 2),
pct AS (SELECT pnu, year, (rank() OVER (PARTITION BY year, gu ORDER BY price) + (count(*) OVER (PARTITION BY year, gu, price) - 1) / 2.0)
 / count(*) OVER (PARTITION BY year, gu) AS pct FROM yearly)"""


def land_pct(t: Tables):
    yearly = t.prices.groupBy("pnu", "year").agg(F.round(F.sum("part"), 2).alias("price"))
    return asof.land_percentile(yearly)


@query("C11_land_price_as_of", f""", {REQUESTS_SQL}, {PCT_SQL}
SELECT DISTINCT q.pnu, CAST(q.t AS BIGINT) AS t, round(coalesce(pct, 0.5), 6) AS land_pct, CASE WHEN pct IS NULL THEN 1 ELSE 0 END::BIGINT AS land_missing
FROM requests q LEFT JOIN pct ON pct.pnu = q.pnu AND pct.year = least(q.t, 2008)""", uses=("parcels", "prices"))
def c11(t: Tables):
    out = asof.land_price_as_of(requests(t).distinct(), land_pct(t), current_year=2008)
    return out.select("pnu", big("t").alias("t"), r("land_pct").alias("land_pct"), big("land_missing").alias("land_missing"))


@query("C12_node_semi_anti", f""", {old_sql('2026')}
SELECT p.pnu, p.pnu IN (SELECT pnu FROM old_now WHERE old_ratio >= 0.5) AS old FROM parcels p
WHERE jimok <> '도' OR pnu IN (SELECT pnu FROM buildings WHERE structure = 'rc')""", uses=("parcels", "buildings"))
def c12(t: Tables):
    built = t.buildings.where("structure = 'rc'").select("pnu")
    nodes = G.node_parcels(t.parcels, with_buildings=built).select("pnu")
    old = asof.old_ratio_by_parcel(asof.building_stock(t.buildings), 2026).where("old_ratio >= 0.5")
    yes = nodes.join(old, "pnu", "left_semi").withColumn("old", F.lit(True))
    return yes.unionByName(nodes.join(old, "pnu", "left_anti").withColumn("old", F.lit(False)))


def notice_tables(t: Tables):
    index = t.source("documents").selectExpr(
        "'2024-' || (doc_id % 50) AS number", "'202401' || lpad(CAST(doc_id % 3 + 10 AS STRING), 2, '0') AS date",
        "'http://g/' || lpad(CAST(doc_id AS STRING), 9, '0') AS url", "'장위' || (doc_id % 7) || '구역 변경' AS title")
    targets = t.source("customer").selectExpr(
        "c_custkey AS target_id", "'제2024-' || (c_custkey % 60) || '호' AS number",
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '2024. 01. ' || (c_custkey % 5 + 10) END AS date",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '장위제' || (c_custkey % 9) || '구역' END AS zone_name")
    return targets, index


@query("C13_notice_match", """
WITH i AS (SELECT doc_id % 50 AS no, 10 + doc_id % 3 AS d, doc_id % 7 AS z, 'http://g/' || lpad(CAST(doc_id AS STRING), 9, '0') AS url FROM documents),
t AS (SELECT c_custkey AS target_id, c_custkey % 60 AS no, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 5 + 10 END AS d,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 9 END AS z FROM customer),
f AS (SELECT target_id, t.z AS tz, count(url) AS n, count(*) FILTER (i.d = t.d) AS nd, min(url) FILTER (i.z = t.z) AS u1,
 min(url) FILTER (i.z = t.z AND i.d = t.d) AS u2, min(url) FILTER (i.d = t.d) AS u3, min(url) AS u4 FROM t LEFT JOIN i USING (no) GROUP BY 1, 2),
p AS (SELECT target_id, tz, CASE WHEN tz IS NOT NULL THEN CASE WHEN nd > 0 THEN u2 ELSE u1 END
 WHEN nd = 1 THEN u3 WHEN nd = 0 AND n = 1 THEN u4 END AS url FROM f)
SELECT target_id, url, CASE WHEN url IS NULL THEN 'none' WHEN tz IS NOT NULL THEN 'high' ELSE 'mid' END AS confidence FROM p""")
def c13(t: Tables):
    targets, index = notice_tables(t)
    # Titles repeat, so the smallest url decides among equal rows.
    out = M.resolve_notices(targets, index)
    return out.select(big("target_id").alias("target_id"), "url", "confidence")


@query("C14_zone_match", """
WITH c AS (SELECT s_suppkey AS k, '11' || (s_suppkey % 5) || '00Z' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS zone_id,
 '장위' || (s_suppkey % 40) AS name FROM supplier),
s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '11' || (c_custkey % 5) || '00Z' || lpad(CAST(c_custkey AS STRING), 6, '0')
 ELSE '11' || (c_custkey % 5) || '00G' || c_custkey END AS store_id, '장위' || (c_custkey % 70) AS name FROM customer),
n AS (SELECT s.store_id, count(DISTINCT c.zone_id) AS n, min(c.zone_id) AS cand FROM s JOIN c ON substr(c.zone_id, 1, 5) = substr(s.store_id, 1, 5) AND c.name = s.name GROUP BY 1)
SELECT s.store_id, coalesce(d.zone_id, CASE WHEN n = 1 THEN cand END) AS zone_id,
 CASE WHEN d.zone_id IS NOT NULL THEN 'high' WHEN n = 1 THEN 'mid' ELSE 'none' END AS confidence,
 CASE WHEN d.zone_id IS NOT NULL OR n = 1 THEN NULL WHEN n > 1 THEN 'several' ELSE 'no_match' END AS reason
FROM s LEFT JOIN c d ON d.zone_id = s.store_id LEFT JOIN n ON n.store_id = s.store_id""")
def c14(t: Tables):
    ctx = t.source("supplier").selectExpr(
        "'11' || (s_suppkey % 5) || '00Z' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS zone_id",
        "'변경 장위제' || (s_suppkey % 40) || '구역 결정' AS title")
    store = t.source("customer").selectExpr(
        "CASE WHEN c_custkey % 3 = 0 THEN '11' || (c_custkey % 5) || '00Z' || lpad(CAST(c_custkey AS STRING), 6, '0')"
        " ELSE '11' || (c_custkey % 5) || '00G' || c_custkey END AS zone_id", "'장위 제' || (c_custkey % 70) || '구역' AS zone_name")
    return M.resolve_store(store, ctx).select("store_id", "zone_id", "confidence", "reason")


def decision_notices(t: Tables):
    """Notices of zones over the years, one per order, with finished cycles among them."""
    return t.source("orders").selectExpr(
        "o_orderkey", "CAST(o_orderdate AS DATE) AS d", "(CASE o_custkey % 4 WHEN 0 THEN '정릉' WHEN 1 THEN '상도' WHEN 2 THEN '장위' ELSE '흑석' END) AS region",
        "o_custkey % 30 AS no").selectExpr(
        "CASE o_orderkey % 4 WHEN 0 THEN region || '제' || no || ' 주택재개발 정비구역 지정' WHEN 1 THEN region || no || '구역 재개발 관리처분계획'"
        " WHEN 2 THEN '재정비촉진지구(' || region || no || '구역) 변경' ELSE '공원 결정' END AS title",
        "CAST(d AS STRING) || ' 00:00:00' AS date", "CASE WHEN o_orderkey % 3 = 0 THEN '열람공고' ELSE '결정고시' END AS kind")


NOTICE_SQL = """, dn AS (SELECT o_orderkey % 4 AS k, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey % 3 <> 0 AS dec,
 CASE o_custkey % 4 WHEN 0 THEN '정릉' WHEN 1 THEN '상도' WHEN 2 THEN '장위' ELSE '흑석' END AS region, o_custkey % 30 AS no FROM orders),
ev AS (SELECT sigungu, region || no AS token, date, k IN (0, 2) AS designates, k = 1 AS done FROM dn
 JOIN (SELECT DISTINCT left(dong, 2) AS base, sigungu FROM parcels) b ON b.base = region WHERE dec AND k < 3),
ld AS (SELECT sigungu, token, max(date) FILTER (done) AS last_done FROM ev GROUP BY 1, 2),
fd AS (SELECT sigungu, token, min(date) AS date FROM ev JOIN ld USING (sigungu, token)
 WHERE designates AND (last_done IS NULL OR date > last_done) GROUP BY 1, 2)
"""


def districts_of_dong(t: Tables):
    return M.dong_districts(t.parcels.selectExpr("'서울특별시 ' || gu || ' ' || dong AS dong_addr", "sigungu"))


@query("C15_token_events", NOTICE_SQL + """
SELECT sigungu, token, date, designates, done, count(*) AS n FROM ev GROUP BY ALL""", uses=("parcels",))
def c15(t: Tables):
    ev = M.title_events(decision_notices(t), districts_of_dong(t))
    return ev.groupBy("sigungu", "token", "date", "designates", "done").agg(F.count(F.lit(1)).alias("n"))


ZONE_TITLE = ("CASE sk % 5 WHEN 0 THEN region || '제' || no || ' 정비구역 지정' WHEN 1 THEN '재정비촉진지구(' || region || no || '구역) 변경'"
              " WHEN 2 THEN region || no || '구역 변경' WHEN 3 THEN '도시계획 변경' ELSE region || no || '재개발 지정 및 변경' END")


@query("C16_zone_dates", NOTICE_SQL + """
, z AS (SELECT *, region || no AS tok, (2003 + sk % 20) || '-05-06' AS nd, sk % 5 AS k FROM notices),
sel AS (SELECT sigungu, region || no AS token, max((2005 + sk % 9)::STRING) AS date FROM notices WHERE sk % 2 = 0 GROUP BY 1, 2),
gos AS (SELECT sigungu, region || no AS token, max((1999 + sk % 25) || '-01-15') AS date FROM notices WHERE sk % 3 = 0 GROUP BY 1, 2),
pub AS (SELECT sigungu, region || no AS name, (2010 + sk % 5) || '-07-08' AS date FROM notices WHERE sk % 7 = 0),
par AS (SELECT region AS parent, min(date) AS date FROM dn WHERE dec AND k = 2 AND region IN ('흑석', '장위') GROUP BY 1),
cand AS (SELECT zone_id, d.date, 'oa_first_decision' AS src, 0 AS rk FROM z JOIN fd d ON d.sigungu = z.sigungu AND d.token = tok WHERE k <> 3
 UNION ALL SELECT zone_id, par.date, 'promotion_parent', 1 FROM z JOIN par ON parent = region WHERE k = 1
 UNION ALL SELECT zone_id, nd, 'ntfc_direct', 2 FROM z WHERE k = 0
 UNION ALL SELECT zone_id, g.date, 'first_designation_gosi', 3 FROM z JOIN gos g ON g.sigungu = z.sigungu AND g.token = tok WHERE k <> 3
 UNION ALL SELECT zone_id, s.date, 'shintong_select', 4 FROM z JOIN sel s ON s.sigungu = z.sigungu AND s.token = tok WHERE k <> 3
 UNION ALL SELECT zone_id, p.date, 'public_redev', 5 FROM z JOIN pub p ON p.sigungu = z.sigungu AND contains(CASE k WHEN 0 THEN region || '제' || no WHEN 3 THEN '' ELSE tok END, p.name)),
pad AS (SELECT *, CASE WHEN length(date) >= 10 THEN date ELSE left(date, 4) || '-01-01' END AS nd FROM cand),
best AS (SELECT zone_id, arg_min(date, (nd, rk)) AS date, arg_min(src, (nd, rk)) AS src, min(nd) AS nd FROM pad GROUP BY 1),
alt AS (SELECT p.zone_id, string_agg(DISTINCT p.date, ';' ORDER BY p.date) AS t_alt FROM pad p JOIN best b USING (zone_id) WHERE p.nd <> b.nd GROUP BY 1)
SELECT z.zone_id, CAST(left(b.date, 4) AS DOUBLE) AS t, left(b.date, 10) AS t_date, b.src AS t_source, t_alt
FROM z LEFT JOIN best b USING (zone_id) LEFT JOIN alt USING (zone_id)""", uses=("parcels", "notices"))
def c16(t: Tables):
    zones = t.notices.selectExpr("zone_id", f"{ZONE_TITLE} AS title", "sigungu", "(2003 + sk % 20) || '-05-06' AS notice_date")
    every = decision_notices(t)
    decisions = M.first_decisions(M.title_events(every, districts_of_dong(t)))
    token = "region || no AS token"

    def listed(where: str, date: str):
        return t.notices.where(where).selectExpr("sigungu", token, f"{date} AS date").groupBy("sigungu", "token").agg(
            F.max("date").alias("date"))

    gos = listed("sk % 3 = 0", "(1999 + sk % 25) || '-01-15'")
    sel = listed("sk % 2 = 0", "CAST(2005 + sk % 9 AS STRING)")
    pub = t.notices.where("sk % 7 = 0").selectExpr("sigungu", "region || no || '일대' AS name", "(2010 + sk % 5) || '-07-08' AS date")
    out = M.resolve_zone_dates(zones, decisions, M.promotion_dates(every), gos, sel, pub)
    return out.withColumn("t", F.col("t").cast("double"))


@query("C17_contained_names", """
SELECT DISTINCT a.zone_id, (2000 + b.sk % 20)::STRING AS date FROM notices a JOIN notices b
 ON a.sigungu = b.sigungu AND contains('서울 ' || a.region || a.no || '구역정비', b.region || b.no)""", uses=("notices",))
def c17(t: Tables):
    zones = t.notices.selectExpr("zone_id", "sigungu", "'서울 ' || region || ' ' || no || '구역 정비' AS title")
    names = t.notices.selectExpr("sigungu", "region || no || '일대' AS name", "CAST(2000 + sk % 20 AS STRING) AS date")
    return M.contained_names(zones, names)


@query("C18_attach_features", f""", {REQUESTS_SQL}, {CENTRES_SQL}, {old_sql('2010', 'old10')}
SELECT DISTINCT q.pnu, CAST(q.t AS BIGINT) AS t, x, y, round(old_ratio, 6) AS old_ratio FROM requests q LEFT JOIN centres USING (pnu) LEFT JOIN old10 USING (pnu)""",
       uses=("parcels", "buildings"))
def c18(t: Tables):
    rows = requests(t).distinct()
    shape = G.static_shape(t.shaped("parcels")).select("pnu", "x", "y")
    old = asof.old_ratio_by_parcel(asof.building_stock(t.buildings), 2010)
    return rows.join(shape, "pnu", "left").join(old, "pnu", "left").select(
        "pnu", big("t").alias("t"), r("x").alias("x"), r("y").alias("y"), r("old_ratio").alias("old_ratio"))


@query("C19_scoped_lookup", """
SELECT ck, CASE ck % 5 WHEN 4 THEN NULL ELSE pnu END AS pnu,
 CASE WHEN ck % 5 = 4 THEN NULL WHEN sigungu IN ('11000', '11010') THEN 'full' ELSE 'partial' END AS scope,
 CASE ck % 5 WHEN 4 THEN 'lot_not_found' END AS error FROM parcels""", uses=("parcels",))
def c19(t: Tables):
    addr = t.parcels.selectExpr(
        "ck", "CASE ck % 5 WHEN 0 THEN pnu WHEN 4 THEN gu || ' ' || dong || ' 9999-1' WHEN 3 THEN '서울특별시 ' || gu || ' ' ||"
        " (CASE WHEN dong = '상도동' THEN '상도1동' ELSE dong END) || ' ' || main_no || '-' || sub_no"
        " ELSE gu || ' ' || dong || main_no || '-' || sub_no END AS address")
    wide = lots(t)
    detail = wide.where(F.col("sigungu").isin("11000", "11010"))
    return M.scoped_lookup(addr, detail, wide, DISTRICTS).select(big("ck").alias("ck"), "pnu", "scope", "error")


@query("C20_grid_cells", f""", {CENTRES_SQL}, g AS (SELECT DISTINCT CAST(floor(x / 250) AS BIGINT) AS gx, CAST(floor(y / 250) AS BIGINT) AS gy FROM centres),
hit AS (SELECT DISTINCT gx, gy FROM g JOIN zones z ON greatest(gx * 250, z.x0) <= least(gx * 250 + 250, z.x0 + z.w)
 AND greatest(gy * 250, z.y0) <= least(gy * 250 + 250, z.y0 + z.w))
SELECT gx, gy, (gx, gy) IN (SELECT (gx, gy) FROM hit) AS in_zone FROM g""", uses=("parcels", "zones"))
def c20(t: Tables):
    grid = square_grid(centres(t), 250.0)
    hit = polygon_overlap(grid.select("gid", "rings"), t.shaped("zones").select("zone_id", "rings"), left_id="gid", right_id="zone_id")
    inside = grid.join(hit.select("gid").distinct(), "gid", "left_semi").withColumn("in_zone", F.lit(True))
    outside = grid.join(hit.select("gid").distinct(), "gid", "left_anti").withColumn("in_zone", F.lit(False))
    return inside.unionByName(outside).select(big("gx").alias("gx"), big("gy").alias("gy"), "in_zone")


@query("C21_backlog", """
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def c21(t: Tables):
    done = t.source("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return new_rows(t.source("customer").select(big("c_custkey").alias("id")), done, ["id"])


ZONE_MEMBERS_SQL = """zm AS (SELECT z.zone_id, p.pnu FROM parcels p JOIN zones z
 ON p.x0 + p.w / 2 > z.x0 AND p.x0 + p.w / 2 < z.x0 + z.w AND p.y0 + p.w / 2 > z.y0 AND p.y0 + p.w / 2 < z.y0 + z.w)"""
CLUSTER_SQL = f""", {old_sql('2026')}, {SCORES_SQL}, {EDGES_SQL},
ok AS (SELECT n.pnu FROM nodes n JOIN scores s USING (pnu) WHERE score >= 0.5), {REACH_SQL},
clusters AS (SELECT cluster_id, pnu FROM comp WHERE cluster_id IN (SELECT cluster_id FROM comp GROUP BY 1 HAVING count(*) >= 5))
"""


def node_scores(t: Tables):
    return scores_of(t).join(G.node_parcels(t.parcels).select("pnu"), "pnu", "left_semi")


def node_aging(t: Tables):
    old = asof.old_ratio_by_parcel(asof.building_stock(t.buildings), 2026)
    return G.node_parcels(t.parcels).select("pnu").join(old, "pnu", "left").select(
        "pnu", F.coalesce("old_ratio", F.lit(0.0)).alias("aging"))


def clusters(t: Tables):
    return shared(t, "clusters", lambda: G.candidate_clusters(node_scores(t), node_edges(t), threshold=0.5))


def members(t: Tables):
    return shared(t, "members", lambda: L.zone_members(
        t.shaped("zones").select("zone_id", "rings"), centres(t).select("pnu", "x", "y")))


@query("C22_zone_cluster_overlap", CLUSTER_SQL + f""", {ZONE_MEMBERS_SQL},
zn AS (SELECT zone_id, count(*) AS zn FROM zm GROUP BY 1), cn AS (SELECT cluster_id, count(*) AS cn FROM clusters GROUP BY 1),
pr AS (SELECT zone_id, cluster_id, count(*) AS i FROM zm JOIN clusters USING (pnu) GROUP BY 1, 2),
b AS (SELECT zone_id, arg_min({{'c': cluster_id, 'iou': i / (zn + cn - i), 'core': i / zn}}, (-i / (zn + cn - i), cluster_id)) AS b
 FROM pr JOIN zn USING (zone_id) JOIN cn USING (cluster_id) GROUP BY 1)
SELECT zone_id, b.c AS cluster_id, round(coalesce(b.iou, 0), 6) AS iou, round(coalesce(b.core, 0), 6) AS core_capture FROM zn LEFT JOIN b USING (zone_id)""",
       uses=("parcels", "buildings", "zones"))
def c22(t: Tables):
    return metrics.zone_matches(members(t), clusters(t)).select(
        "zone_id", "cluster_id", r("iou").alias("iou"), r("core_capture").alias("core_capture"))


@query("G1_graph_by_district", f", {EDGES_SQL} SELECT substr(src, 1, 5) AS sigungu, count(*) AS n_edges, count(DISTINCT src) AS n_linked,"
       " count(*) FILTER (substr(src, 1, 5) <> substr(dst, 1, 5)) AS crossing FROM edges GROUP BY 1", uses=("parcels",))
def g1(t: Tables):
    e = node_edges(t)
    return e.groupBy(F.substring("src", 1, 5).alias("sigungu")).agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_linked"),
        F.count(F.when(F.substring("src", 1, 5) != F.substring("dst", 1, 5), 1)).alias("crossing"))


@query("G2_two_hop_closure", f""", {EDGES_SQL}, {ZONE_MEMBERS_SQL},
s AS (SELECT pnu FROM nodes WHERE pnu IN (SELECT pnu FROM zm)), h1 AS (SELECT pnu FROM s UNION SELECT dst FROM edges JOIN s ON src = pnu)
SELECT pnu FROM h1 UNION SELECT dst FROM edges JOIN h1 ON src = pnu""", uses=("parcels", "zones"))
def g2(t: Tables):
    seeds = G.node_parcels(t.parcels).select("pnu").join(members(t).select("pnu").distinct(), "pnu", "left_semi")
    return G.closure(seeds, node_edges(t), 2)


@query("G3_candidate_clusters", CLUSTER_SQL + "SELECT cluster_id, pnu FROM clusters", uses=("parcels", "buildings"))
def g3(t: Tables):
    return clusters(t)


@query("G4_region_grow", f""", {old_sql('2026')}, {EDGES_SQL},
age AS (SELECT n.pnu, coalesce(old_ratio, 0) AS a FROM nodes n LEFT JOIN old_now USING (pnu)),
ok AS (SELECT pnu FROM age WHERE a >= 0.4), {REACH_SQL},
big AS (SELECT cluster_id FROM comp JOIN age USING (pnu) GROUP BY 1 HAVING count(*) >= 5 AND max(a) >= 0.6)
SELECT cluster_id, pnu FROM comp WHERE cluster_id IN (SELECT cluster_id FROM big)""", uses=("parcels", "buildings"))
def g4(t: Tables):
    return G.region_grow(node_aging(t), node_edges(t))


@query("S1_aligned_union", """
SELECT pnu, 'a' AS src, CAST(ck AS DOUBLE) AS extra FROM parcels UNION ALL SELECT pnu, 'b', NULL FROM buildings""", uses=("parcels", "buildings"))
def s1(t: Tables):
    a = t.parcels.select("pnu", F.lit("a").alias("src"), F.col("ck").cast("double").alias("extra"))
    return a.unionByName(t.buildings.select("pnu", F.lit("b").alias("src")), allowMissingColumns=True)


@query("S2_row_union", "SELECT pnu, count(*) AS n FROM (SELECT pnu FROM parcels UNION ALL SELECT pnu FROM buildings) GROUP BY 1",
       uses=("parcels", "buildings"))
def s2(t: Tables):
    return t.parcels.select("pnu").unionByName(t.buildings.select("pnu")).groupBy("pnu").agg(F.count(F.lit(1)).alias("n"))


@query("S3_undirected_edges", """
WITH e AS (SELECT DISTINCT least(o_custkey, o_orderkey % 1000) AS a, greatest(o_custkey, o_orderkey % 1000) AS b FROM orders WHERE o_custkey <> o_orderkey % 1000)
SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e""")
def s3(t: Tables):
    pairs = t.source("orders").selectExpr("o_custkey AS a", "o_orderkey % 1000 AS b")
    return G.both_ways(pairs)


@query("S4_set_overlap", """
, a AS (SELECT DISTINCT pnu FROM buildings WHERE structure = 'rc'), b AS (SELECT DISTINCT pnu FROM buildings WHERE gross_floor_area > 400)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (pnu)) AS n_both,
 (SELECT count(*) FROM a WHERE pnu NOT IN (SELECT pnu FROM b)) AS only_a, (SELECT count(*) FROM b WHERE pnu NOT IN (SELECT pnu FROM a)) AS only_b""",
       uses=("buildings",))
def s4(t: Tables):
    b = t.buildings
    return overlap_report(b.where("structure = 'rc'"), b.where("gross_floor_area > 400"), "pnu")
