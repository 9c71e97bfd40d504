"""Source cleaning, load reports and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcelgrid import settings as S
from parcelgrid.functions.project import to_degrees, to_target
from parcelgrid.operators.matching import lot_index
from parcelgrid.queries.registry import big, query, r, scores_of, old_sql, SCORES_SQL
from parcelgrid.queries.scalars import STRUCTURE_RAW, YEAR_RAW
from parcelgrid.session import durable, scratch_root
from parcelgrid.sources import cleaning as C, readers as IO, sinks as K
from parcelgrid.standins import DISTRICTS, Tables


def raw_parcels(t: Tables):
    return t.parcels.selectExpr(
        "CASE WHEN ck % 19 = 4 THEN 'x' || pnu ELSE ' ' || pnu END AS A1",
        "CASE WHEN ck % 23 = 1 THEN NULL ELSE '서울특별시 ' || gu || ' ' || dong END AS A3",
        "main_no || '-' || sub_no AS A4", "main_no || '-' || sub_no || jimok AS A5", "sigungu AS A7", "ck AS unused")


@query("A1_parcel_scan", """
SELECT pnu, sigungu, jimok, CASE WHEN ck % 23 = 1 THEN NULL ELSE '서울특별시 ' || gu || ' ' || dong END AS dong_addr
FROM parcels WHERE ck % 19 <> 4 AND sigungu IN ('11000', '11020')""", uses=("parcels",))
def a1(t: Tables):
    path = durable(raw_parcels(t))._durable_path
    raw = IO.read_parcels(t.spark, path, ["11000", "11020"], with_geometry=False)
    return C.clean_parcels(raw).select("pnu", "sigungu", "jimok", "dong_addr")


@query("A1_parcel_report", """
SELECT count(*) AS total_rows, count(*) FILTER (ck % 19 = 4) AS dropped_bad_pnu, count(*) FILTER (ck % 19 <> 4) AS kept_rows,
 count(*) FILTER (ck % 19 <> 4 AND ck % 23 = 1) AS dong_missing, 0::BIGINT AS jibun_missing, count(DISTINCT sigungu) AS n_districts FROM parcels""",
       uses=("parcels",))
def a1_report(t: Tables):
    rep = C.parcel_report(IO.renamed(raw_parcels(t), IO.PARCEL_COLUMNS))
    return rep.select(*[big(c).alias(c) for c in rep.columns])


RAW_BUILDING = {
    "pnu": "CASE WHEN ok % 23 = 7 THEN 'bad-' || pnu ELSE pnu END", "approval_raw": YEAR_RAW, "structure_raw": STRUCTURE_RAW,
    "gross_floor_area": "CASE WHEN ok % 17 = 0 THEN NULL WHEN ok % 31 = 0 THEN 0 ELSE gross_floor_area END",
    "land_div": "'일반'", "sigungu": "sigungu"}
RAW_BUILDING_SQL = """, raw AS (SELECT ok, pnu, sigungu, ok % 23 = 7 AS bad,
 CASE WHEN ok % 29 = 0 OR ok % 31 = 0 OR ok % 37 = 0 OR ok % 41 = 0 THEN NULL ELSE approval_year END AS y,
 CASE WHEN ok % 6 IN (0, 5) THEN 'rc' ELSE 'other' END AS structure,
 CASE WHEN ok % 17 = 0 THEN NULL WHEN ok % 31 = 0 THEN 0 ELSE gross_floor_area END AS gfa FROM buildings),
kept AS (SELECT * FROM raw WHERE NOT bad AND NOT ((gfa IS NULL OR gfa <= 0) AND y IS NULL))
"""


def raw_buildings(t: Tables):
    return t.buildings.selectExpr(*[f"{e} AS {c}" for c, e in RAW_BUILDING.items()])


@query("A2_buildings", RAW_BUILDING_SQL + """
SELECT pnu, CAST(y AS DOUBLE) AS approval_year, structure, gfa AS gross_floor_area FROM kept""", uses=("buildings",))
def a2(t: Tables):
    b = C.clean_buildings(raw_buildings(t))
    return b.select("pnu", F.col("approval_year").cast("double").alias("approval_year"), "structure", "gross_floor_area")


@query("A2_building_report", RAW_BUILDING_SQL + """
SELECT (SELECT count(*) FROM raw) AS total_rows, (SELECT count(*) FROM raw WHERE bad) AS dropped_bad_pnu,
 (SELECT count(*) FROM raw WHERE NOT bad) - count(*) AS dropped_empty_shape, count(*) AS kept_rows,
 round(avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END), 6) AS year_missing_rate, count(*) FILTER (structure = 'rc') AS n_rc,
 count(DISTINCT pnu) AS n_parcels FROM kept""", uses=("buildings",))
def a2_report(t: Tables):
    rep = C.building_report(raw_buildings(t))
    return rep.select(*[r(c).alias(c) if c == "year_missing_rate" else big(c).alias(c) for c in rep.columns])


@query("A3_combined_buildings", """
, third AS (SELECT DISTINCT pnu FROM buildings WHERE ok % 3 < 2)
SELECT pnu, count(*) AS n, CAST(min(approval_year) AS BIGINT) AS first_year FROM buildings
WHERE ok % 3 < 2 OR pnu NOT IN (SELECT pnu FROM third) GROUP BY pnu""", uses=("buildings",))
def a3(t: Tables):
    b = t.buildings.withColumn("apr", F.concat("approval_year", F.lit("-01-01")))
    codes = {v: k for k, v in IO.NATIONAL_BUILDING_COLUMNS.items()}
    national = b.select("ok", *[F.col(s).alias(codes[n]) for n, s in (
        ("pnu", "pnu"), ("approval_raw", "apr"), ("structure_raw", "structure"), ("gross_floor_area", "gross_floor_area"),
        ("sigungu", "sigungu"))])
    general = IO.renamed(national.where("ok % 3 = 0"), IO.NATIONAL_BUILDING_COLUMNS)
    collective = IO.renamed(national.where("ok % 3 = 1"), IO.NATIONAL_BUILDING_COLUMNS)
    fill = b.where("ok % 3 = 2").select("pnu", "approval_year", "gross_floor_area", "structure")
    return C.clean_buildings(C.combined_buildings(general, collective, fill)).groupBy("pnu").agg(
        F.count(F.lit(1)).alias("n"), big(F.min("approval_year")).alias("first_year"))


@query("A4_yearly_prices", """
SELECT year, pnu, arg_max(part, ok) AS price FROM (SELECT CAST(year(o_orderdate) + 10 AS BIGINT) AS year, o_orderkey AS ok, o_totalprice AS part,
 CAST(11000 + 10 * ((o_custkey % 25) // 5) AS STRING) || '000001' || lpad(CAST(o_custkey // 10000 AS STRING), 4, '0') || lpad(CAST(o_custkey % 10000 AS STRING), 4, '0') AS pnu
 FROM orders WHERE o_orderkey % 9 <> 2 AND o_orderkey % 11 <> 3) GROUP BY 1, 2""")
def a4(t: Tables):
    from parcelgrid.standins import pnu_of

    raw = t.source("orders").selectExpr(
        "CAST(year(o_orderdate) + 10 AS INT) AS year", "o_orderkey AS ok",
        f"CASE WHEN o_orderkey % 9 = 2 THEN '123' ELSE {pnu_of('o_custkey').replace('{div}', 'div')} END AS pnu",
        "CASE WHEN o_orderkey % 11 = 3 THEN '없음' ELSE CAST(o_totalprice AS STRING) END AS price")
    return C.clean_prices(raw, "ok").select(big("year").alias("year"), "pnu", "price")


@query("A5_stations", """
SELECT name, CASE sk % 4 WHEN 0 THEN '9호선' WHEN 1 THEN '우이신설선' WHEN 2 THEN '1호선' ELSE '신림선' END AS line,
 round(x + 190000, 2) AS x, round(y + 540000, 2) AS y, CASE sk % 4 WHEN 0 THEN 2009 WHEN 1 THEN 2017 WHEN 2 THEN 2000 ELSE 2022 END::BIGINT AS open_year,
 CASE WHEN sk % 4 = 2 THEN 'pre2001' ELSE 'compiled' END AS open_source FROM (SELECT s.*, s_suppkey AS sk FROM stations s JOIN supplier ON s_name = name)""",
       uses=("stations",))
def a5(t: Tables):
    d = to_degrees(F.col("x") + 190000, F.col("y") + 540000)
    raw = t.stations.withColumn("sk", F.substring("name", 10, 20).cast("long")).select(
        "name", F.expr("CASE sk % 4 WHEN 0 THEN '9호선' WHEN 1 THEN '우이신설선' WHEN 2 THEN '1호선' ELSE '신림선' END").alias("line"),
        d.alias("d")).select("name", "line", F.col("d.lon").cast("string").alias("x"), F.col("d.lat").cast("string").alias("y"))
    s = C.clean_stations(raw, srid=4326)
    return s.select("name", "line", r("x", 2).alias("x"), r("y", 2).alias("y"), big("open_year").alias("open_year"), "open_source")


@query("A6_zoning_scan", """
SELECT a6, count(*) AS n FROM zoning WHERE sigungu IN ('11000', '11030') GROUP BY 1""", uses=("zoning",))
def a6(t: Tables):
    path = durable(t.shaped("zoning").select(F.col("a6").alias("A6"), F.col("sigungu").alias("A4"), "rings"))._durable_path
    z = IO.read_zoning(t.spark, path, ["11000", "11030"])
    return z.groupBy("a6").agg(F.count(F.lit(1)).alias("n"))


TRADE_SQL = """, items AS (SELECT o_custkey % 16 = 3 AS apt, l_linenumber AS ln, floor(l_extendedprice) AS amount, l_quantity AS q,
 l_partkey AS pk, l_orderkey AS ok, year(l_shipdate) AS y, month(l_shipdate) AS m, p.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN parcels p ON p.ck = o_custkey),
placed AS (SELECT * FROM items WHERE ln <> 7),
found AS (SELECT * FROM placed WHERE ok % 13 <> 6), good AS (SELECT * FROM found WHERE pk % 50 <> 9)
"""


def trade_items(t: Tables):
    """Trade items as the XML reader gives them, joined from sales lines."""
    p = t.parcels.select("ck", "dong", "main_no", "sub_no", F.col("sigungu").alias("sgg"))
    lines = t.source("lineitem").join(t.source("orders"), F.expr("l_orderkey = o_orderkey"))
    return lines.join(p, F.expr("ck = o_custkey")).selectExpr(
        "CASE WHEN l_orderkey % 13 = 6 THEN '없는동' WHEN dong = '상도동' AND l_orderkey % 2 = 0 THEN '상도2동' ELSE dong END AS umdNm",
        "main_no || '-' || sub_no AS jibun", "sgg AS sggCd",
        "CASE WHEN l_partkey % 50 = 9 THEN '-' ELSE ' ' || format_number(floor(l_extendedprice), 0) END AS dealAmount",
        "CAST(l_quantity AS STRING) AS excluUseAr", "CASE WHEN l_linenumber = 1 THEN '-' ELSE CAST(l_quantity AS STRING) END AS landAr",
        "CAST(1990 + l_partkey % 36 AS STRING) AS buildYear", "CAST(year(l_shipdate) AS STRING) AS dealYear",
        "CAST(month(l_shipdate) AS STRING) AS dealMonth", "CASE WHEN l_linenumber = 7 THEN 'O' ELSE '' END AS cdealType",
        "CASE WHEN o_custkey % 16 = 3 THEN 'apt' ELSE 'villa' END AS kind")


def lots(t: Tables):
    return lot_index(t.parcels.selectExpr(
        "pnu", "'서울특별시 ' || gu || ' ' || dong AS dong_addr", "main_no || '-' || sub_no AS jibun", "sigungu"))


@query("A7_trades", TRADE_SQL + """
SELECT pnu, CASE WHEN apt THEN 'apt' ELSE 'villa' END AS trade_type, CAST(y * 100 + m AS STRING) AS deal_ym, count(*) AS n,
 CAST(sum(amount) AS BIGINT) AS amount, round(sum(q), 4) AS area_m2, coalesce(round(sum(CASE WHEN ln <> 1 THEN q END), 4), 0) AS land_share_m2
FROM good GROUP BY 1, 2, 3""", uses=("parcels",))
def a7(t: Tables):
    return C.clean_trades(trade_items(t), lots(t)).groupBy("pnu", "trade_type", "deal_ym").agg(
        F.count(F.lit(1)).alias("n"), big(F.sum("deal_amount")).alias("amount"), r(F.sum("area_m2"), 4).alias("area_m2"),
        F.coalesce(r(F.sum("land_share_m2"), 4), F.lit(0.0)).alias("land_share_m2"))


@query("A7_trade_report", TRADE_SQL + """
SELECT (SELECT count(*) FROM placed) AS api_rows, (SELECT count(*) FROM placed) - (SELECT count(*) FROM found) AS pnu_miss,
 (SELECT count(*) FROM found) - count(*) AS amount_fail, count(*) AS matched,
 round(count(*) / (SELECT count(*) FROM placed), 3) AS match_rate, count(*) FILTER (NOT apt) AS villa_rows,
 count(*) FILTER (NOT apt AND ln = 1) AS villa_land_missing FROM good""", uses=("parcels",))
def a7_report(t: Tables):
    rep = C.trade_report(trade_items(t), lots(t))
    return rep.select(*[F.col(c) if c == "match_rate" else big(c).alias(c) for c in rep.columns])


def raw_notices(t: Tables):
    return t.source("documents").selectExpr(
        "CASE WHEN doc_id % 17 = 5 THEN '번호없음' ELSE '서울특별시 고시 제' || (2000 + doc_id % 25) || '-' || (doc_id % 400) || '호' END AS `고시 번호`",
        "'2024. ' || lpad(CAST(doc_id % 9 + 1 AS STRING), 2, '0') || '. 19.' AS `고시일`", "'http://g/' || doc_id AS URL",
        "'구역' || doc_id AS `제목`", "source AS other")


@query("A8_notice_index", """
SELECT (2000 + doc_id % 25) || '-' || (doc_id % 400) AS number, '20240' || (doc_id % 9 + 1) || '19' AS date,
 'http://g/' || doc_id AS url, '구역' || doc_id AS title FROM documents WHERE doc_id % 17 <> 5""")
def a8(t: Tables):
    return C.clean_notices(raw_notices(t))


@query("A8_notice_api_dedupe", """
SELECT (2000 + doc_id % 25) || '-' || (doc_id % 400) AS number, count(*) > 0 AS found,
 min('20240' || (doc_id % 9 + 1) || '19') AS date FROM documents WHERE doc_id % 17 <> 5 GROUP BY 1""")
def a8_api(t: Tables):
    n = C.clean_notices(raw_notices(t), one_per_number=True)
    return n.select("number", F.col("url").isNotNull().alias("found"), "date")


@query("A9_zone_scan", """
SELECT zone_id, sigungu, zone_type FROM zones WHERE sigungu IN ('11000', '11010', '11040') AND zone_type IN ('UQ1221', 'UQ1222')""",
       uses=("zones",))
def a9(t: Tables):
    path = durable(t.shaped("zones").select(
        F.col("zone_id").alias("NTFC_SN"), F.col("sigungu").alias("SIGNGU_SE"), F.col("zone_type").alias("SCLAS_CL"), "rings"))._durable_path
    z = IO.read_zone_parts(t.spark, path, ["11000", "11010", "11040"], tuple(S.ZONE_CLASSES))
    return z.select("zone_id", "sigungu", "zone_type")


def raw_cancelled(t: Tables):
    lot = "main_no || '-' || sub_no"
    return t.parcels.selectExpr(
        "CASE WHEN ck % 7 = 6 THEN '바깥구' ELSE gu END AS gu", "' 구역' || ck AS zone_name",
        f"CASE WHEN ck % 11 = 2 THEN '위치 미상' WHEN ck % 11 = 3 THEN dong || ' 9999-' || sub_no"
        f" WHEN dong = '상도동' THEN '상도3동' || {lot} || ' 일대' ELSE dong || ' ' || {lot} END AS location",
        "(2008 + ck % 12) || '-03-05 00:00' AS date")


CANCELLED_SQL = """, c AS (SELECT *, CASE WHEN ck % 11 = 2 THEN 'parse_fail' WHEN ck % 11 = 3 THEN 'lot_miss'
 WHEN dong = '상도동' THEN 'recovered' ELSE 'matched' END AS outcome FROM parcels WHERE ck % 7 <> 6)
"""


@query("A10_cancelled", CANCELLED_SQL + """
SELECT pnu, CAST(2008 + ck % 12 AS BIGINT) AS t, (2008 + ck % 12) || '-03-05' AS t_date, '구역' || ck AS zone_id, 'cancelled' AS neg_reason
FROM c WHERE outcome IN ('matched', 'recovered')""", uses=("parcels",))
def a10(t: Tables):
    c = C.clean_cancelled(raw_cancelled(t), lots(t), DISTRICTS)
    return c.select("pnu", big("t").alias("t"), "t_date", "zone_id", "neg_reason")


@query("A10_cancelled_report", CANCELLED_SQL + """
SELECT count(*) AS in_scope_rows, count(*) FILTER (outcome IN ('matched', 'recovered')) AS matched_pnu,
 round(count(*) FILTER (outcome IN ('matched', 'recovered')) / count(*), 3) AS match_rate,
 count(*) FILTER (outcome = 'parse_fail') AS parse_fail, count(*) FILTER (outcome = 'lot_miss') AS lot_miss,
 count(*) FILTER (outcome = 'recovered') AS recovered FROM c""", uses=("parcels",))
def a10_report(t: Tables):
    rep = C.cancelled_report(C.cancelled_rows(raw_cancelled(t), lots(t), DISTRICTS))
    return rep.select(*[F.col(c) if c == "match_rate" else big(c).alias(c) for c in rep.columns])


@query("A11_crosscheck_dates", """
SELECT sigungu, region || no AS token, max(CAST(2000 + sk % 20 AS STRING) || '-02-03') AS date
FROM notices WHERE sk % 10 <> 9 GROUP BY 1, 2""", uses=("notices",))
def a11(t: Tables):
    rows = t.notices.selectExpr(
        "sigungu", "'(' || region || '제' || no || '구역)' AS name",
        "CASE WHEN sk % 10 = 9 THEN ' ' ELSE (2000 + sk % 20) || '-02-03 10:00' END AS date")
    return C.crosscheck_dates(rows)


@query("A12_projection", """
SELECT c_custkey AS ck, round(200000.0::DOUBLE + (c_custkey % 2003 - 1000) * 80, 3) AS x, round(550000.0::DOUBLE + (c_custkey * 7 % 2003 - 1000) * 90, 3) AS y FROM customer""")
def a12(t: Tables):
    x = 200000.0 + (F.col("c_custkey") % 2003 - 1000) * 80
    y = 550000.0 + (F.col("c_custkey") * 7 % 2003 - 1000) * 90
    deg = t.source("customer").select(big("c_custkey").alias("ck"), to_degrees(x, y).alias("d")).select(
        "ck", F.col("d.lon").alias("x"), F.col("d.lat").alias("y"))
    m = to_target(deg, 4326)
    return m.select("ck", r("x", 3).alias("x"), r("y", 3).alias("y"))


@query("A13_news_corpus", """
SELECT 'Z' || lpad(CAST(user_id % 20 AS STRING), 7, '0') AS zone_id, count(*) AS n, min('http://n/' || event_id) AS first_url FROM events GROUP BY 1""")
def a13(t: Tables):
    lines = t.source("events").selectExpr(
        "'Z' || lpad(CAST(user_id % 20 AS STRING), 7, '0') AS zone_id", "'http://n/' || event_id AS url", "event_type AS source",
        "props AS text", "props AS reply")
    path = f"{scratch_root(t.spark)}/corpus/{uuid.uuid4().hex}"
    lines.write.partitionBy("zone_id").json(path)
    return IO.read_corpus(t.spark, path).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"))


@query("A14_materialised", f"""
, {old_sql('2026')}, {SCORES_SQL}
SELECT sigungu, count(*) AS n, round(sum(score), 4) AS total FROM scores GROUP BY 1""", uses=("parcels", "buildings"))
def a14(t: Tables):
    path = f"{scratch_root(t.spark)}/scores/{uuid.uuid4().hex}"
    K.materialised(t.spark, path, lambda: scores_of(t), partition_by=["sigungu"])
    again = K.materialised(t.spark, path, lambda: scores_of(t).limit(0), partition_by=["sigungu"])
    return again.groupBy("sigungu").agg(F.count(F.lit(1)).alias("n"), r(F.sum("score"), 4).alias("total"))


@query("A15_attribute_store", """
, k AS (SELECT s_suppkey AS sk, 'Z' || lpad(CAST(s_suppkey AS STRING), 7, '0') AS zone_id FROM supplier)
SELECT zone_id, CASE WHEN sk % 3 = 0 THEN 'old' ELSE 'new' END AS zone_name,
 CASE WHEN sk % 3 = 0 THEN 1.0 WHEN sk % 20 < 18 THEN sk % 20 + 50.0 ELSE 900.0 END::DOUBLE AS far,
 CASE WHEN sk % 3 = 0 THEN 'verified' WHEN sk % 20 < 18 THEN 'manual_verified' ELSE 'flagged' END AS grade FROM k""".replace(", k AS", "WITH k AS", 1))
def a15(t: Tables):
    sup = t.source("supplier").selectExpr("s_suppkey AS sk", "'Z' || lpad(CAST(s_suppkey AS STRING), 7, '0') AS zone_id")
    old = sup.where("sk % 3 = 0").select("zone_id", F.lit("old").alias("zone_name"), F.create_map(
        F.lit("용적률"), F.struct(F.lit(1.0).alias("value"), F.lit("1%").alias("raw"), F.lit("용적률").alias("label"),
                               F.lit("verified").alias("grade"))).alias("attrs"))
    samples = sup.select(
        "zone_id", F.lit("new").alias("zone_name"), F.lit("용적률").alias("attr"),
        F.expr("CASE WHEN sk % 20 < 18 THEN (sk % 20 + 50) || '%' ELSE '900%' END").alias("raw"))
    fresh = K.manual_entries(K.pending(samples, old))
    store = K.upserted(old, fresh)
    return store.select("zone_id", "zone_name", F.col("attrs")["용적률"]["value"].alias("far"), F.col("attrs")["용적률"]["grade"].alias("grade"))
