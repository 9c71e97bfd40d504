import pytest
from pyspark.sql import functions as F

from parcelgrid.functions import address as A, fields as C, ids, text as X, titles as N
from parcelgrid.operators import rules as R


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_ids(spark):
    df = spark.createDataFrame([("1129010100100100000",), ("  12 ",), ("1.13e+18",), ("",), ("1" * 20,)], "v string")
    out = [r[0] for r in df.select(ids.normalized_id(df, "v")).collect()]
    assert out == ["1129010100100100000", "0" * 17 + "12", None, None, None]
    with pytest.raises(TypeError):
        ids.normalized_id(spark.createDataFrame([(1.0,)], "v double"), "v")
    p = spark.createDataFrame([("1129010100200100003",)], "v string").select(ids.id_parts(F.col("v")).alias("s")).first()["s"]
    assert (p["sigungu"], p["is_mountain"], p["main_no"], p["sub_no"]) == ("11290", True, 10, 3)


def test_location(spark):
    out = column(spark, ["정릉동170-1", "장위동 233-42일대", "상도동 산65", "안암동2가59", "번지없음", "정릉 3"], A.location_parts)
    assert [tuple(o) if o else None for o in out] == [
        ("정릉동", 170, 1, False), ("장위동", 233, 42, False), ("상도동", 65, 0, True), ("안암동2가", 59, 0, False), None, None]
    assert column(spark, ["상도2동", "안암동2가"], A.legal_dong) == ["상도동", "안암동2가"]
    assert column(spark, ["179-3대", "산39-25임", "12"], A.land_class) == ["대", "임", None]


def test_titles(spark):
    assert column(spark, ["돈암제6 주택재개발정비구역 결정", "(흑석2,9구역)"], N.zone_tokens) == [["돈암6"], ["흑석2", "흑석9"]]
    assert column(spark, ["수색?증산", "수색·증산", "정말?"], N.clean_title) == ["수색증산", "수색증산", "정말?"]
    assert column(spark, ["정릉3 주택재건축 정비구역지정", "길음1 재개발 시행인가", "길음1 정비구역 지정"], N.is_designation_title) == [
        False, False, True]
    assert column(spark, ["응암동700", "돈암6", "가2"], N.region_of) == ["응암", "돈암", "가"]
    assert column(spark, ["가리봉 제1구역", "흑석2재정비촉진구역", None], N.norm_zone_name) == ["가리봉1", "흑석2", ""]
    assert column(spark, ["불광제5", "고척동253번지", "장위15구역"], N.name_core) == ["불광5", "고척동253", "장위15"]
    assert column(spark, ["2008", "2008-03-04 01:00"], N.sortable_date) == ["2008-01-01", "2008-03-04"]


def test_fields(spark):
    assert column(spark, ["32,500", "", "-", "x"], C.number_of) == [32500.0, None, None, None]
    assert column(spark, ["철근콘크리트구조", "경량철골구조", "조적", None], C.structure_class) == ["rc", "other", "other", "other"]
    assert column(spark, ["1991-09-02", "0000", "9999", None, "ab"], C.approval_year) == [1991, None, None, None, None]
    assert column(spark, [8.0, 50.0, 77.3, 100.0], C.rank_phrase, "double") == ["상위 8.0%", "상위 50.0%", "하위 22.7%", "하위 0.0%"]
    assert column(spark, [.058, .99, .65, .55], lambda v: C.confidence(v, F.lit(.618)), "double") == ["고신뢰", "고신뢰", "저신뢰", "저신뢰"]
    cols = ["pnu", *C.neighbour_columns(2)]
    assert len(C.feature_sets(cols)["B1+"]) == 50
    assert not [c for c in C.production_features(cols) if "zoning" in c]


def test_permit_and_stage(spark):
    out = column(spark, ["apartment", "villa", "shop"], lambda v: R.permit_status(v)["permit_applies"])
    assert out == [True, False, True]
    assert column(spark, ["villa"], lambda v: R.permit_status(v, in_complex=F.lit(True))["permit_applies"]) == [True]
    known = column(spark, ["착공", None, "다른"], lambda v: R.stage_remaining(v, F.lit(True))["known"])
    assert known == [True, False, False]
    assert column(spark, ["착공"], lambda v: R.stage_remaining(v, F.lit(False))["known"]) == [False]


def test_display(spark):
    assert column(spark, ["187,669.0"], lambda v: X.attribute_text("구역면적", v)) == ["187,669㎡"]
    assert column(spark, ["30이하"], lambda v: X.attribute_text("건폐율", v)) == ["30% 이하"]
    assert column(spark, ["599.96", "231.54%"], lambda v: X.attribute_text("용적률", v)) == ["599.96%", "231.54%"]
    assert column(spark, ["1. 2,464세대 190.0%"], X.number_tokens) == [["1", "190.0", "2464"]]


def test_focus_text(spark):
    text = "\n".join(["a", "b", "용적률 200%", "c", "d", "e", "f", "g", "세대 9", "h"])
    assert column(spark, [text], X.focus_text) == ["a\nb\n용적률 200%\nc\nd\n…\nf\ng\n세대 9\nh"]
    assert column(spark, ["x\ny"], X.focus_text) == ["x\ny"]
