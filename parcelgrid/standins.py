"""Parcels, buildings, trades and the rest derived from the driver's tables.

Each stand-in is a list of (column, expression) over one source. Expressions
are plain SQL that Spark and the checking engine both run; ``{div}`` is integer
division and ``{H}`` the number of parcel rows (customers / 25).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelgrid.functions import shapes
from parcelgrid.session import broadcast_by_measured_size

DISTRICTS = {"가온구": "11000", "나래구": "11010", "다솜구": "11020", "라온구": "11030", "마루구": "11040"}
DONGS = ["정릉동", "상도동", "안암동2가", "장위동", "석관동"]
ZONING = {"ECONOMY": "제2종일반주거지역", "LARGE": "자연녹지지역", "STANDARD": "제3종일반주거지역",
          "SMALL": "제1종일반주거지역", "MEDIUM": "준주거지역", "PROMO": "도시지역"}


def _case(expr: str, values: list[str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def sigungu_of(k: str) -> str:
    return f"CAST(11000 + 10 * (({k} % 25) {{div}} 5) AS STRING)"


def pnu_of(k: str, register: str = "1") -> str:
    return (f"({sigungu_of(k)} || '00000{register}' || lpad(CAST({k} {{div}} 10000 AS STRING), 4, '0')"
            f" || lpad(CAST({k} % 10000 AS STRING), 4, '0'))")


def year_of(k: str, order: str) -> str:
    block = f"(((({k} % 25) {{div}} 3) + (({k} {{div}} 25) {{div}} 3)) % 3)"
    return (f"CAST(CASE {block} WHEN 0 THEN 1965 + {order} % 20 WHEN 1 THEN 2005 + {order} % 20"
            f" ELSE 1965 + {order} % 60 END AS INT)")


_K = "c_custkey"
STANDINS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "parcels": ("customer", [
        ("ck", _K), ("pnu", pnu_of(_K)), ("sigungu", sigungu_of(_K)),
        ("gu", _case(f"(({_K} % 25) {{div}} 5)", list(DISTRICTS))),
        ("dong", _case(f"({_K} % 5)", DONGS)),
        ("main_no", f"({_K} {{div}} 10000)"), ("sub_no", f"({_K} % 10000)"),
        ("jimok", f"CASE WHEN {_K} % 13 = 5 THEN '도' ELSE '대' END"),
        ("x0", f"CAST(20 * ({_K} % 25) AS DOUBLE)"), ("y0", f"CAST(20 * ({_K} {{div}} 25) AS DOUBLE)"),
        ("w", f"CAST(CASE WHEN {_K} % 10 < 8 THEN 20 ELSE 17 END AS DOUBLE)"),
    ]),
    "buildings": ("orders", [
        ("ok", "o_orderkey"), ("ck", "o_custkey"), ("pnu", pnu_of("o_custkey")), ("sigungu", sigungu_of("o_custkey")),
        ("approval_year", year_of("o_custkey", "o_orderkey")),
        ("structure", "CASE WHEN o_orderstatus = 'F' THEN 'rc' ELSE 'other' END"),
        ("gross_floor_area", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 1000 END"),
    ]),
    "trades": ("lineitem JOIN orders ON l_orderkey = o_orderkey", [
        ("pnu", pnu_of("o_custkey")), ("sigungu", sigungu_of("o_custkey")),
        ("trade_type", "CASE WHEN o_custkey % 16 = 3 THEN 'apt' ELSE 'villa' END"),
        ("deal_amount", "l_extendedprice"), ("land_share_m2", "l_quantity"), ("area_m2", "l_quantity * 2"),
        ("build_year", "CAST(1990 + l_partkey % 36 AS INT)"),
        ("deal_ym", "CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT)"),
    ]),
    "zones": ("supplier", [
        ("sk", "s_suppkey"),
        ("zone_id", "'Z' || lpad(CAST(s_suppkey AS STRING), 7, '0')"),
        ("x0", "CAST(20 * (s_suppkey * 7 % 25) - 5 AS DOUBLE)"), ("y0", "CAST(20 * (s_suppkey * 11 % {H}) - 5 AS DOUBLE)"),
        ("w", "CAST(65 AS DOUBLE)"), ("area_ha", "CAST(0.4225 AS DOUBLE)"),
        ("t", "CAST(2001 + s_suppkey % 25 AS INT)"),
        ("t_date", "CAST(2001 + s_suppkey % 25 AS STRING) || '-06-01'"),
        ("t_source", "'ntfc_direct'"), ("t_alt", "CAST(NULL AS STRING)"),
        ("zone_type", "CASE WHEN s_suppkey % 2 = 0 THEN 'UQ1221' ELSE 'UQ1222' END"),
        ("sigungu", "CAST(11000 + 10 * ((s_suppkey * 7 % 25) {div} 5) AS STRING)"),
    ]),
    "zoning": ("part", [
        ("pk", "p_partkey"),
        ("a6", "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ZONING.items()) + " END"),
        ("sigungu", "CAST(11000 + 10 * ((p_partkey % 13) {div} 3) AS STRING)"),
        ("x0", "CAST(40 * (p_partkey % 13) - 3 AS DOUBLE)"),
        ("y0", "CAST(40 * (p_partkey * 17 % ({H} {div} 2)) - 3 AS DOUBLE)"), ("w", "CAST(45 AS DOUBLE)"),
    ]),
    "stations": ("supplier", [
        ("name", "s_name"), ("x", "CAST(20 * (s_suppkey * 7 % 25) + 27.5 AS DOUBLE)"),
        ("y", "CAST(20 * (s_suppkey * 11 % {H}) + 27.5 AS DOUBLE)"),
        ("open_year", "CAST(1995 + s_suppkey % 30 AS INT)"),
        ("open_source", "CASE WHEN s_suppkey % 30 < 6 THEN 'pre2001' ELSE 'compiled' END"),
    ]),
    "prices": ("orders", [
        ("pnu", pnu_of("o_custkey")), ("year", "CAST(year(o_orderdate) + 10 AS INT)"), ("part", "o_totalprice"),
    ]),
    "judged": ("documents JOIN labels ON documents.doc_id = labels.doc_id", [
        ("id", "documents.doc_id"), ("y", "quality"), ("p", "CAST(n_chars AS DOUBLE) / CAST(n_chars + 1500 AS DOUBLE)"),
        ("q", "CAST((documents.doc_id * 37) % 101 AS DOUBLE) / CAST(101 AS DOUBLE)"),
        ("aging", "CAST(CASE WHEN documents.doc_id % 5 < 2 THEN 0 ELSE 1 END AS DOUBLE) / 2"),
        ("neg_reason", "CASE WHEN toxic = 1 THEN 'cancelled' ELSE 'new_construction' END"),
        ("fold", "lang"),
    ]),
    "notices": ("supplier", [
        ("sk", "s_suppkey"),
        ("zone_id", "'Z' || lpad(CAST(s_suppkey AS STRING), 7, '0')"),
        ("sigungu", "CAST(11000 + 10 * (s_suppkey % 5) AS STRING)"),
        ("region", _case("(s_suppkey % 5)", ["정릉", "상도", "흑석", "장위", "석관"])),
        ("no", "(s_suppkey % 9 + 1)"),
    ]),
}


def rows_expr(name: str, div: str, h: str) -> list[str]:
    return [f"{e.replace('{div}', div).replace('{H}', h)} AS {c}" for c, e in STANDINS[name][1]]


def cte(*names: str) -> str:
    """``WITH`` body for the checking engine: the named stand-ins over the registered views."""
    h = "(SELECT count(*) // 25 FROM customer)"
    return ",\n".join(
        f"{n} AS (SELECT {', '.join(rows_expr(n, '//', h))} FROM {STANDINS[n][0]})" for n in names)


class Tables:
    """Stand-in DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._h: int | None = None
        broadcast_by_measured_size(spark)

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def height(self) -> int:
        if self._h is None:
            self._h = self.source("customer").count() // 25
        return self._h

    def __getattr__(self, name: str) -> DataFrame:
        if name not in STANDINS:
            raise AttributeError(name)
        src = STANDINS[name][0]
        if src.startswith("lineitem"):
            df = self.source("lineitem").join(self.source("orders"), F.expr("l_orderkey = o_orderkey"))
        elif src.startswith("documents"):
            docs, labels = self.source("documents").alias("documents"), self.source("labels").alias("labels")
            df = docs.join(labels, F.expr("documents.doc_id = labels.doc_id"))
        else:
            df = self.source(src)
        needs_h = any("{H}" in e for _, e in STANDINS[name][1])
        return df.selectExpr(*rows_expr(name, "div", str(self.height) if needs_h else "1"))

    def shaped(self, name: str) -> DataFrame:
        """A stand-in with its square as polygon column ``rings``."""
        x, y, w = F.col("x0"), F.col("y0"), F.col("w")
        return getattr(self, name).withColumn("rings", shapes.box(x, y, x + w, y + w))
