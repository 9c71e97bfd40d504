"""Row-level expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid import settings as S
from parcelgrid.functions import address as A, fields as C, ids, shapes, text as X, titles as N
from parcelgrid.operators import rules as R
from parcelgrid.plans.assess import verdict
from parcelgrid.queries.registry import big, query, r
from parcelgrid.standins import DISTRICTS, Tables

RAW_ID = ("CASE ck % 6 WHEN 0 THEN pnu WHEN 1 THEN ' ' || pnu || ' ' WHEN 2 THEN CAST(ck AS STRING)"
          " WHEN 3 THEN 'x' || pnu WHEN 4 THEN '1.13e+18' ELSE '' END")


@query("B1_normalize_id", """
SELECT ck, CASE ck % 6 WHEN 0 THEN pnu WHEN 1 THEN pnu WHEN 2 THEN lpad(CAST(ck AS STRING), 19, '0') END AS pnu
FROM parcels""", uses=("parcels",))
def b1(t: Tables):
    raw = t.parcels.selectExpr("ck", f"{RAW_ID} AS raw")
    return raw.select(big("ck").alias("ck"), ids.normalized_id(raw, "raw").alias("pnu"))


@query("B2_valid_id", """
SELECT ck % 4 AS kind, count(*) AS n, count(*) FILTER (ck % 4 < 2) AS n_valid FROM parcels GROUP BY 1""",
       uses=("parcels",))
def b2(t: Tables):
    p = t.parcels.selectExpr(
        "ck % 4 AS kind", "CASE ck % 4 WHEN 0 THEN pnu WHEN 1 THEN substr(pnu, 1, 10) || '2' || substr(pnu, 12, 8)"
        " WHEN 2 THEN substr(pnu, 1, 10) || '7' || substr(pnu, 12, 8) ELSE substr(pnu, 1, 18) END AS pnu")
    return p.groupBy(big("kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(ids.is_valid_id(F.col("pnu")), 1)).alias("n_valid"))


@query("B3_id_parts", """
SELECT pnu, substr(pnu, 1, 10) AS dong_code, sigungu, '1' AS register, false AS is_mountain,
 main_no, sub_no FROM parcels""", uses=("parcels",))
def b3(t: Tables):
    p = t.parcels.select("pnu", ids.id_parts(F.col("pnu")).alias("s")).select("pnu", "s.*")
    return p.withColumns({"main_no": big("main_no"), "sub_no": big("sub_no")})


@query("B4_district_filter", """
SELECT sigungu, count(*) AS n FROM parcels WHERE sigungu IN ('11000', '11030') GROUP BY 1""", uses=("parcels",))
def b4(t: Tables):
    kept = ids.in_districts(t.parcels, ["11000", "11030"])
    return kept.groupBy(ids.district_of(F.col("pnu")).alias("sigungu")).agg(F.count(F.lit(1)).alias("n"))


LOCATION = ("CASE ck % 5 WHEN 0 THEN dong || ' ' || main_no || '-' || sub_no WHEN 1 THEN dong || sub_no || ' 일대'"
            " WHEN 2 THEN dong || ' 산' || sub_no WHEN 3 THEN '번지 없음 ' || sub_no"
            " ELSE '상도2동 ' || main_no || '-' || sub_no || '일원' END")


@query("B5_location_parts", """
SELECT ck, CASE WHEN ck % 5 = 3 THEN NULL WHEN ck % 5 = 4 THEN '상도2동' ELSE dong END AS dong,
 CAST(CASE WHEN ck % 5 IN (0, 4) THEN main_no WHEN ck % 5 = 3 THEN NULL ELSE sub_no END AS DOUBLE) AS main_no,
 CAST(CASE WHEN ck % 5 IN (0, 4) THEN sub_no WHEN ck % 5 = 3 THEN NULL ELSE 0 END AS DOUBLE) AS sub_no,
 CAST(CASE WHEN ck % 5 = 3 THEN NULL WHEN ck % 5 = 2 THEN 1 ELSE 0 END AS DOUBLE) AS is_mountain
FROM parcels""", uses=("parcels",))
def b5(t: Tables):
    p = t.parcels.selectExpr("ck", f"{LOCATION} AS loc").select(
        big("ck").alias("ck"), A.location_parts(F.col("loc")).alias("s"))
    return p.select("ck", "s.dong", F.col("s.main_no").cast("double").alias("main_no"),
                    F.col("s.sub_no").cast("double").alias("sub_no"),
                    F.col("s.is_mountain").cast("double").alias("is_mountain"))


@query("B6_legal_dong", """
SELECT ck, CASE WHEN ck % 3 = 0 THEN '상도동' WHEN ck % 3 = 1 THEN dong ELSE '길음동' END AS legal FROM parcels""",
       uses=("parcels",))
def b6(t: Tables):
    p = t.parcels.selectExpr(
        "ck", "CASE ck % 3 WHEN 0 THEN '상도' || (ck % 9 + 1) || '동' WHEN 1 THEN dong ELSE '길음' || ck || '동' END AS d")
    return p.select(big("ck").alias("ck"), A.legal_dong(F.col("d")).alias("legal"))


@query("B7_lot_fields", """
SELECT ck, jimok, dong, CAST(CASE WHEN ck % 4 = 3 THEN NULL WHEN ck % 4 = 2 THEN sub_no ELSE main_no END AS DOUBLE) AS main_no,
 CAST(CASE WHEN ck % 4 = 3 THEN NULL WHEN ck % 4 = 2 THEN 0 ELSE sub_no END AS DOUBLE) AS sub_no FROM parcels""",
       uses=("parcels",))
def b7(t: Tables):
    p = t.parcels.selectExpr(
        "ck", "main_no || '-' || sub_no || jimok AS raw", "'서울특별시 ' || gu || '  ' || dong || ' ' AS addr",
        "CASE ck % 4 WHEN 3 THEN '산 1' WHEN 2 THEN '' || sub_no ELSE ' ' || main_no || '-' || sub_no || ' ' END AS lot")
    lot = A.lot_parts(F.col("lot"))
    return p.select(big("ck").alias("ck"), A.land_class(F.col("raw")).alias("jimok"), A.dong_of(F.col("addr")).alias("dong"),
                    lot["main_no"].cast("double").alias("main_no"), lot["sub_no"].cast("double").alias("sub_no"))


STRUCTURE_RAW = ("CASE ok % 6 WHEN 0 THEN '철근콘크리트구조' WHEN 1 THEN '경량철골구조' WHEN 2 THEN '조적구조'"
                 " WHEN 3 THEN '일반목구조' WHEN 4 THEN NULL ELSE '일반철골구조' END")


@query("B8_structure_class", """
SELECT ok, CASE WHEN ok % 6 IN (0, 5) THEN 'rc' ELSE 'other' END AS structure FROM buildings""", uses=("buildings",))
def b8(t: Tables):
    b = t.buildings.selectExpr("ok", f"{STRUCTURE_RAW} AS raw")
    return b.select(big("ok").alias("ok"), C.structure_class(F.col("raw")).alias("structure"))


YEAR_RAW = ("CASE WHEN ok % 29 = 0 THEN '0000-00-00' WHEN ok % 31 = 0 THEN NULL WHEN ok % 37 = 0 THEN '9999'"
            " WHEN ok % 41 = 0 THEN ' 미상' ELSE approval_year || '-09-02' END")


@query("B9_approval_year", """
SELECT ok, CAST(CASE WHEN ok % 29 = 0 OR ok % 31 = 0 OR ok % 37 = 0 OR ok % 41 = 0 THEN NULL
 ELSE approval_year END AS DOUBLE) AS approval_year FROM buildings""", uses=("buildings",))
def b9(t: Tables):
    b = t.buildings.selectExpr("ok", f"{YEAR_RAW} AS raw")
    return b.select(big("ok").alias("ok"), C.approval_year(F.col("raw")).cast("double").alias("approval_year"))


@query("B10_number_text", """
SELECT o_orderkey AS ok, CASE WHEN o_orderkey % 7 < 3 THEN NULL ELSE floor(o_totalprice) END AS v FROM orders""")
def b10(t: Tables):
    o = t.source("orders").select(big("o_orderkey").alias("ok"), F.expr(
        "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' - ' WHEN 2 THEN '없음'"
        " ELSE format_number(floor(o_totalprice), 0) END").alias("raw"))
    return o.select("ok", C.number_of(F.col("raw")).alias("v"))


@query("B11_clean_title", """
SELECT sk, '수색증산' || no || '구역' || CASE WHEN sk % 2 = 0 THEN ' a?b' ELSE '' END AS title FROM notices""",
       uses=("notices",))
def b11(t: Tables):
    n = t.notices.selectExpr(
        "sk", "CASE sk % 3 WHEN 0 THEN '수색?증산' WHEN 1 THEN '수색·증산' ELSE '수색ㆍ증산' END || no || '구역'"
        " || CASE WHEN sk % 2 = 0 THEN ' a?b' ELSE '' END AS title")
    return n.select(big("sk").alias("sk"), N.clean_title(F.col("title")).alias("title"))


TITLE = ("CASE sk % 6 WHEN 0 THEN region || '제' || no || ' 주택재개발정비구역 지정' WHEN 1 THEN region || no || ' 주택재건축 정비구역지정'"
         " WHEN 2 THEN region || no || '구역 재개발 사업시행인가' WHEN 3 THEN region || no || ' 주택재개발 관리처분계획 인가'"
         " WHEN 4 THEN '재정비촉진지구 변경(' || region || no || ',' || (no + 1) || '구역)' ELSE '도시계획시설 결정' END")


@query("B12_title_kinds", """
SELECT sk, sk % 6 IN (0, 4) AS designates, sk % 6 = 3 AS done FROM notices""", uses=("notices",))
def b12(t: Tables):
    n = t.notices.selectExpr("sk", f"{TITLE} AS title")
    return n.select(big("sk").alias("sk"), N.is_designation_title(F.col("title")).alias("designates"),
                    N.is_cycle_done(F.col("title")).alias("done"))


@query("B13_region_and_parent", """
SELECT sk, region, CASE WHEN sk % 6 = 4 AND region IN ('흑석', '장위') THEN region END AS parent FROM notices""",
       uses=("notices",))
def b13(t: Tables):
    n = t.notices.selectExpr("sk", f"{TITLE} AS title", "region || CASE WHEN sk % 2 = 0 THEN '동' ELSE '' END || no AS token")
    return n.select(big("sk").alias("sk"), N.region_of(F.col("token")).alias("region"),
                    N.promotion_parent(F.col("title")).alias("parent"))


@query("B14_zone_tokens", """
SELECT sk, CASE WHEN sk % 6 < 4 THEN region || no WHEN sk % 6 = 4 THEN region || least(no, no + 1) || ';' || region || (no + 1)
 ELSE '' END AS tokens FROM notices""".replace("least(no, no + 1)", "no"), uses=("notices",))
def b14(t: Tables):
    n = t.notices.selectExpr("sk", "no", f"{TITLE} AS title")
    tokens = N.zone_tokens(F.col("title"))
    # Numbers 9 and 10 sort as text; the listed order is restored by length.
    by_length = F.transform(F.array_sort(F.transform(tokens, lambda x: F.struct(F.length(x).alias("n"), x.alias("v")))),
                            lambda s: s["v"])
    return n.select(big("sk").alias("sk"), F.array_join(by_length, ";").alias("tokens"))


@query("B15_name_keys", """
SELECT sk, region || no AS norm, region || no AS core, region || '제' || no || '구역' AS in_title,
 (2000 + sk % 26) || '-' || sk AS number, sigungu || '|' || region || '|' || no AS holdout FROM notices""",
       uses=("notices",))
def b15(t: Tables):
    n = t.notices.selectExpr(
        "sk", "sigungu", "region || ' 제' || no || '구역' AS name", "region || '제' || no || ' 구역' AS listed", "'변경 ' || region || '제' || no || '구역 고시' AS title",
        "'서울특별시 고시 제' || (2000 + sk % 26) || '-' || sk || '호' AS number",
        "region || '제' || no || ' 주택재개발 정비구역' AS long_name")
    return n.select(
        big("sk").alias("sk"), N.norm_zone_name(F.col("name")).alias("norm"), N.name_core(F.col("listed")).alias("core"),
        N.zone_name_in_title(F.col("title")).alias("in_title"), N.notice_number(F.col("number")).alias("number"),
        N.holdout_key(F.col("long_name"), F.col("sigungu")).alias("holdout"))


@query("B16_sortable_date", """
SELECT o_orderkey AS ok, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
 ELSE strftime(o_orderdate, '%Y') || '-01-01' END AS d FROM orders""")
def b16(t: Tables):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = t.source("orders").select(big("o_orderkey").alias("ok"), F.when(
        F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit(" 00:00"))).otherwise(F.substring(day, 1, 4)).alias("d"))
    return o.select("ok", N.sortable_date(F.col("d")).alias("d"))


@query("B17_recent_window", """
SELECT trade_type, count(*) AS n, CAST(min(deal_ym) AS BIGINT) AS first_ym FROM trades WHERE deal_ym >= 199809 GROUP BY 1""",
       uses=("trades",))
def b17(t: Tables):
    return C.within_window(t.trades, 200109, 3).groupBy("trade_type").agg(
        F.count(F.lit(1)).alias("n"), big(F.min("deal_ym")).alias("first_ym"))


@query("B18_unit_price", """
SELECT sigungu, count(*) AS n, round(avg(deal_amount / (land_share_m2 / 3.305785)), 4) AS mean_pyung,
 round(max(deal_amount / (land_share_m2 / 3.305785)), 4) AS max_pyung
FROM trades WHERE trade_type = 'villa' AND land_share_m2 > 0 GROUP BY 1""", uses=("trades",))
def b18(t: Tables):
    return C.villa_unit_prices(t.trades).groupBy("sigungu").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("pyung"), 4).alias("mean_pyung"), r(F.max("pyung"), 4).alias("max_pyung"))


def _figures(t: Tables):
    """Rectangles, right triangles and squares with a square hole, by parcel number."""
    x, y, a = F.col("x0"), F.col("y0"), F.col("w")
    b = a + F.col("ck") % 7
    tri = F.array(F.array(*[shapes.point(p, q) for p, q in ((x, y), (x + a, y), (x, y + b), (x, y))]))
    ring = F.array(
        F.array(*[shapes.point(p, q) for p, q in ((x, y), (x + a, y), (x + a, y + a), (x, y + a), (x, y))]),
        F.array(*[shapes.point(p, q) for p, q in ((x + 4, y + 4), (x + 4, y + 8), (x + 8, y + 8), (x + 8, y + 4), (x + 4, y + 4))]))
    k = F.col("ck") % 3
    return t.parcels.withColumn("rings", F.when(k == 0, shapes.box(x, y, x + a, y + b)).when(k == 1, tri).otherwise(ring))


@query("B19_area_compactness", """
, f AS (SELECT pnu, ck % 3 AS k, w AS a, w + ck % 7 AS b FROM parcels),
g AS (SELECT pnu, CASE k WHEN 0 THEN a * b WHEN 1 THEN a * b / 2 ELSE a * a - 16 END AS area_m2,
 CASE k WHEN 0 THEN 2 * (a + b) WHEN 1 THEN a + b + sqrt(a * a + b * b) ELSE 4 * a + 16 END AS per FROM f)
SELECT pnu, round(area_m2, 6) AS area_m2, round(per, 6) AS perimeter_m, round(4 * pi() * area_m2 / (per * per), 6) AS compactness
FROM g""", uses=("parcels",))
def b19(t: Tables):
    f = _figures(t)
    g = F.col("rings")
    return f.select("pnu", r(shapes.area(g)).alias("area_m2"), r(shapes.perimeter(g)).alias("perimeter_m"),
                    r(shapes.compactness(g)).alias("compactness"))


@query("B20_inner_point", """
, f AS (SELECT pnu, ck % 3 AS k, x0, y0, w AS a, w + ck % 7 AS b FROM parcels)
SELECT pnu, round(CASE k WHEN 0 THEN x0 + a / 2 WHEN 1 THEN x0 + a / 3 ELSE (a * a * (x0 + a / 2) - 16 * (x0 + 6)) / (a * a - 16) END, 6) AS cx,
 round(CASE k WHEN 0 THEN y0 + b / 2 WHEN 1 THEN y0 + b / 3 ELSE (a * a * (y0 + a / 2) - 16 * (y0 + 6)) / (a * a - 16) END, 6) AS cy,
 round(x0 + 9 * a / 10, 6) AS ux, round(y0 + a / 2, 6) AS uy
FROM f""", uses=("parcels",))
def b20(t: Tables):
    f = _figures(t)
    x, y, a = F.col("x0"), F.col("y0"), F.col("w") / 10
    u = F.array(F.array(*[shapes.point(x + i * a, y + j * a) for i, j in (
        (0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10), (0, 0))]))
    c, p = shapes.centroid(F.col("rings")), shapes.inner_point(u)
    return f.select("pnu", c.alias("c"), p.alias("p")).select(
        "pnu", r("c.x").alias("cx"), r("c.y").alias("cy"), r("p.x").alias("ux"), r("p.y").alias("uy"))


@query("B21_zoning_ordinal", """
SELECT pk, CASE a6 WHEN '제1종일반주거지역' THEN 3.0 WHEN '제2종일반주거지역' THEN 4.0 WHEN '제3종일반주거지역' THEN 5.0
 WHEN '준주거지역' THEN 6.0 ELSE 0.0 END::DOUBLE AS zoning_ord,
 CASE a6 WHEN '제1종일반주거지역' THEN 200.0 WHEN '제2종일반주거지역' THEN 250.0 WHEN '제3종일반주거지역' THEN 300.0
 WHEN '준주거지역' THEN 500.0 END::DOUBLE AS far_limit FROM zoning""", uses=("zoning",))
def b21(t: Tables):
    return t.zoning.select(big("pk").alias("pk"), C.zoning_ordinal(F.col("a6")).alias("zoning_ord"),
                           C.far_limit(F.col("a6")).cast("double").alias("far_limit"))


@query("B22_proximity", """
SELECT pnu, round(1 - least(greatest(y0 / 1000, 0), 1), 6) AS prox FROM parcels""", uses=("parcels",))
def b22(t: Tables):
    return t.parcels.select("pnu", r(C.proximity(F.col("y0"))).alias("prox"))


@query("B23_confidence", """
SELECT id, CASE WHEN abs(p - 0.618) >= 0.15 THEN '고신뢰' ELSE '저신뢰' END AS confidence FROM judged""", uses=("judged",))
def b23(t: Tables):
    return t.judged.select(big("id").alias("id"), C.confidence(F.col("p"), F.lit(0.618)).alias("confidence"))


@query("B24_rank_phrase", """
SELECT id, CASE WHEN v <= 50 THEN '상위 ' || v || '%' ELSE '하위 ' || round(100 - v, 1) || '%' END AS phrase
FROM (SELECT id, round(p * 100, 1) AS v FROM judged)""", uses=("judged",))
def b24(t: Tables):
    return t.judged.select(big("id").alias("id"), C.rank_phrase(F.round(F.col("p") * 100, 1)).alias("phrase"))


KIND = "CASE ck % 4 WHEN 0 THEN 'apartment' WHEN 1 THEN 'villa' WHEN 2 THEN '연립' ELSE 'shop' END"
STAGE = "CASE ck % 5 WHEN 0 THEN '조합설립인가' WHEN 1 THEN '착공' WHEN 2 THEN '기타단계' WHEN 3 THEN NULL ELSE '준공' END"


@query("B25_permit_status", """
SELECT ck, CASE WHEN ck % 4 IN (1, 2) THEN ck % 3 = 0 ELSE true END AS permit_applies,
 NOT CASE WHEN ck % 4 IN (1, 2) THEN ck % 3 = 0 ELSE true END AS gap_investment_possible FROM parcels""", uses=("parcels",))
def b25(t: Tables):
    s = R.permit_status(F.expr(KIND), in_complex=F.col("ck") % 3 == 0)
    return t.parcels.select(big("ck").alias("ck"), s["permit_applies"].alias("permit_applies"),
                            s["gap_investment_possible"].alias("gap_investment_possible"))


@query("B26_stage_remaining", """
SELECT ck, jimok = '대' AND ck % 5 IN (0, 1, 4) AS known,
 CAST(CASE WHEN jimok = '대' THEN CASE ck % 5 WHEN 0 THEN 7 WHEN 1 THEN 2 WHEN 4 THEN 0 END END AS DOUBLE) AS min_years,
 CAST(CASE WHEN jimok = '대' THEN CASE ck % 5 WHEN 0 THEN 15 WHEN 1 THEN 4 WHEN 4 THEN 1 END END AS DOUBLE) AS max_years,
 CAST(CASE WHEN jimok = '대' THEN CASE ck % 5 WHEN 0 THEN 10 WHEN 1 THEN 3 WHEN 4 THEN 0 END END AS DOUBLE) AS typical_years
FROM parcels""", uses=("parcels",))
def b26(t: Tables):
    s = R.stage_remaining(F.expr(STAGE), F.col("jimok") == "대")
    return t.parcels.select(big("ck").alias("ck"), s["known"].alias("known"),
                            *[s[c].cast("double").alias(c) for c in ("min_years", "max_years", "typical_years")])


@query("B27_entry_status", """
SELECT CASE WHEN ck % 4 IN (1, 2) THEN false ELSE true END AS permit_applies,
 jimok = '대' AND ck % 5 IN (0, 1, 4) AS known, count(*) AS n FROM parcels GROUP BY 1, 2""", uses=("parcels",))
def b27(t: Tables):
    s = R.entry_status(F.expr(KIND), F.expr(STAGE), F.col("jimok") == "대")
    return t.parcels.groupBy(s["permit"]["permit_applies"].alias("permit_applies"),
                             s["remaining"]["known"].alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("B28_market_context", """
SELECT ck, CASE ck % 4 WHEN 0 THEN '반경 50m 실거래 ' || ck || '건' WHEN 1 THEN '반경 100m 실거래 ' || ck || '건'
 WHEN 2 THEN '주변 거래 부족 → 동 평균 ' || ck || '건' ELSE '거래 없음' END AS land,
 CASE WHEN ck % 3 = 0 AND ck > 0 THEN '반경 1km 신축 ' || ck || '건' ELSE '거래 부족' END AS newbuild FROM parcels""",
       uses=("parcels",))
def b28(t: Tables):
    level = F.expr("CASE ck % 4 WHEN 0 THEN 'r50' WHEN 1 THEN 'r100' WHEN 2 THEN 'dong' ELSE 'missing' END")
    m = R.market_context(F.col("w"), F.when(F.col("ck") % 3 == 0, F.col("w")), level, F.col("ck"), F.col("ck"))
    return t.parcels.select(big("ck").alias("ck"), m["land_provenance"].alias("land"), m["newbuild_provenance"].alias("newbuild"))


@query("B29_display_formats", """
SELECT o_orderkey AS ok, CAST(CAST(round_even((o_orderkey % 97) / 97.0 * 100, 0) AS BIGINT) AS STRING) || '%' AS pct,
 CASE WHEN o_orderkey % 9 = 0 THEN '값없음' ELSE format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) || '만원' END AS won,
 (o_orderkey % 1000) || '%' || CASE WHEN o_orderkey % 2 = 0 THEN ' 이하' ELSE '' END AS far,
 format('{:,}', o_orderkey + 1) || '㎡' AS area FROM orders""")
def b29(t: Tables):
    k = F.col("o_orderkey")
    far = F.expr("(o_orderkey % 1000) || CASE WHEN o_orderkey % 2 = 0 THEN '이하' ELSE '%' END")
    area = F.concat(F.format_number(k + 1, 0), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '.0' ELSE '' END"))
    return t.source("orders").select(
        big(k).alias("ok"), X.percent_text((k % 97) / 97.0).alias("pct"),
        X.won_text(F.when(k % 9 != 0, F.col("o_totalprice"))).alias("won"),
        X.attribute_text("용적률", far).alias("far"), X.attribute_text("구역면적", area).alias("area"))


@query("B31_verdict", """
SELECT id, class, CASE class WHEN '지정 정비구역' THEN '이미 구역으로 지정된 필지. 노후 환경 순위 ' || phrase || ' (지정과 별개인 비교값).'
 WHEN '환경 유사 후보(미지정)' THEN '지정 기록은 없으나 비슷한 필지 묶음에 포함. 순위 ' || phrase || '. 기록 누락 여부를 확인하십시오.'
 WHEN '관심(경계 밖)' THEN '묶음에는 들지 않았으나 순위가 높음: ' || phrase || '. 변화를 지켜볼 필지.'
 ELSE '순위 ' || phrase || '. 검토 기준에 미치지 못함.' END AS headline
FROM (SELECT id, CASE WHEN id % 5 = 0 THEN '지정 정비구역' WHEN id % 3 = 0 THEN '환경 유사 후보(미지정)' WHEN v <= 10 THEN '관심(경계 밖)' ELSE '대상 아님' END AS class,
 CASE WHEN v <= 50 THEN '상위 ' || v || '%' ELSE '하위 ' || round(100 - v, 1) || '%' END AS phrase FROM (SELECT id, round(p * 50, 1) AS v FROM judged))""", uses=("judged",))
def b31(t: Tables):
    top = F.round(F.col("p") * 50, 1)
    v = verdict(F.col("id") % 5 == 0, F.col("id") % 3 == 0, top, C.rank_phrase(top))
    return t.judged.select(big("id").alias("id"), v.alias("v")).select("id", "v.class", "v.headline")


@query("B35_address_parts", """
SELECT ck, CASE WHEN ck % 6 = 5 THEN NULL WHEN ck % 6 IN (3, 4) THEN NULL ELSE sigungu END AS sigungu,
 CASE WHEN ck % 6 IN (3, 4, 5) THEN NULL WHEN ck % 6 = 2 THEN '상도2동' ELSE dong END AS dong,
 CASE WHEN ck % 6 IN (3, 4, 5) THEN NULL WHEN ck % 6 = 2 THEN '상도동' ELSE dong END AS legal,
 CASE ck % 6 WHEN 3 THEN 'road_address' WHEN 4 THEN 'unknown_district' WHEN 5 THEN 'unparsable_lot' END AS error
FROM parcels""", uses=("parcels",))
def b35(t: Tables):
    lot = "' ' || main_no || '-' || sub_no"
    p = t.parcels.selectExpr(
        "ck", f"CASE ck % 6 WHEN 0 THEN '서울특별시 ' || gu || ' ' || dong || {lot} WHEN 1 THEN gu || ' ' || dong || {lot}"
        f" WHEN 2 THEN '서울 ' || gu || ' 상도2동' || {lot} WHEN 3 THEN gu || ' 세종대로 ' || ck"
        f" WHEN 4 THEN '바깥구 ' || dong || {lot} ELSE gu || ' 번지없음' END AS address")
    return p.select(big("ck").alias("ck"), A.address_parts(F.col("address"), DISTRICTS).alias("s")).select(
        "ck", "s.sigungu", "s.dong", "s.legal", "s.error")
