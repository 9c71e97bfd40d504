"""Registered queries against their SQL on the smallest data; all of them with PARCELGRID_ALL=1."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("PARCELGRID_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = ["A2_buildings", "A10_cancelled", "A12_projection", "B5_location_parts", "B14_zone_tokens", "B19_area_compactness", "B32_focus_windows",
        "B35_address_parts", "C1_lot_lookup", "C2_points_in_zones", "C8_nearest_station_as_of", "C13_notice_match", "C16_zone_dates", "D1_old_ratio_by_parcel",
        "D18_source_comparison", "E1_average_precision", "E7_topk_precision", "T1_screener", "T2_cosine_topk", "V1_verify_attribute", "W1_land_percentile"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PARCELGRID_ALL") else FAST


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(df):
    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return ""
        return repr(v.item() if hasattr(v, "item") else v)

    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    return sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
