"""Query registry and helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelgrid.session import durable
from parcelgrid.sources.sinks import is_complete
from parcelgrid.standins import Tables, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, uses: tuple[str, ...] = ()):
    """Register ``fn(tables)`` under ``name``; ``sql`` is checked against it.

    ``uses`` names the stand-ins put in front of the SQL as WITH entries; SQL
    that starts with a comma continues that list.
    """
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            body = sql.strip()
            if uses:
                body = f"WITH {'RECURSIVE ' if 'reach AS' in body else ''}{cte(*uses)}{'' if body.startswith(',') else chr(10)}{body}"
            ORACLES[name] = body
        return fn

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double; adding 0 turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


# Old ratio of each parcel at a year, as SQL over ``buildings``.
def old_sql(t: str, name: str = "old_now") -> str:
    old = f"{t} - approval_year >= CASE WHEN structure = 'rc' THEN 30 ELSE 20 END"
    return (f"{name} AS (SELECT pnu, sum(CASE WHEN {old} THEN coalesce(gross_floor_area, 0) ELSE 0 END)"
            f" / nullif(sum(coalesce(gross_floor_area, 0)), 0) AS old_ratio"
            f" FROM buildings WHERE approval_year <= {t} GROUP BY pnu)")


# Scores of all parcels, as SQL after ``parcels`` and ``old_now``.
SCORES_SQL = ("scores AS (SELECT p.pnu, p.sigungu, p.ck, p.x0 + w / 2 AS x, p.y0 + w / 2 AS y,"
              " round(coalesce(old_ratio, 0) * 0.9 + (p.ck % 7) / 100.0, 6) AS score"
              " FROM parcels p LEFT JOIN old_now USING (pnu))")

# Edges between node parcels (both directions), as SQL after ``parcels``.
EDGES_SQL = """nodes AS (SELECT * FROM parcels WHERE jimok <> '도'),
edges AS (SELECT a.pnu AS src, b.pnu AS dst FROM nodes a JOIN nodes b
  ON a.sigungu = b.sigungu AND a.pnu <> b.pnu
 AND b.x0 BETWEEN a.x0 - 40 AND a.x0 + 40 AND b.y0 BETWEEN a.y0 - 40 AND a.y0 + 40
 AND sqrt(pow(greatest(0, greatest(a.x0, b.x0) - least(a.x0 + a.w, b.x0 + b.w)), 2)
        + pow(greatest(0, greatest(a.y0, b.y0) - least(a.y0 + a.w, b.y0 + b.w)), 2)) <= 2)"""

# Connected parts of passing nodes, as SQL after ``edges`` and ``ok(pnu)``.
REACH_SQL = """kept AS (SELECT src, dst FROM edges WHERE src IN (SELECT pnu FROM ok) AND dst IN (SELECT pnu FROM ok)),
reach AS (SELECT pnu AS a, pnu AS b FROM ok
 UNION SELECT reach.a, kept.dst FROM reach JOIN kept ON kept.src = reach.b),
comp AS (SELECT a AS pnu, min(b) AS cluster_id FROM reach GROUP BY a)"""

AVG_RANK = ("(rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0)"
            " / count(*) OVER (PARTITION BY {g})")


def scores_of(t: Tables) -> DataFrame:
    """(pnu, sigungu, ck, x, y, score) of all parcels."""
    from parcelgrid.operators.asof import building_stock, old_ratio_by_parcel

    old = old_ratio_by_parcel(building_stock(t.buildings), 2026)
    half = F.col("w") / 2
    p = t.parcels.select("pnu", "sigungu", "ck", (F.col("x0") + half).alias("x"), (F.col("y0") + half).alias("y"))
    ck = (F.col("ck") % 7) / F.lit(100.0)
    return p.join(old, "pnu", "left").select(
        "pnu", "sigungu", "ck", "x", "y",
        F.round(F.coalesce("old_ratio", F.lit(0.0)) * 0.9 + ck, 6).alias("score"))


_SHARED: dict[tuple[str, str, str], tuple[str, object]] = {}


def shared(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table several queries start from, written once per application and data folder."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    hit = _SHARED.get(key)
    if hit is None or not is_complete(t.spark, hit[0]):
        made = durable(build())
        hit = _SHARED[key] = (made._durable_path, made.schema)
    return t.spark.read.schema(hit[1]).parquet(hit[0])


def forget_shared() -> None:
    """Make the next query build its own tables again (used by the benchmark)."""
    _SHARED.clear()


def node_edges(t: Tables) -> DataFrame:
    from parcelgrid.operators.graph import adjacency, node_parcels

    return shared(t, "edges", lambda: adjacency(node_parcels(t.shaped("parcels"))))
