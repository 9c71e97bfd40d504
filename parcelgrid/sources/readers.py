"""File scans: projection and district filters reach the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T



# Source column codes and the names used here.
PARCEL_COLUMNS = {"A1": "pnu", "A3": "dong_addr", "A4": "jibun", "A5": "jimok_raw", "A7": "sigungu"}
BUILDING_COLUMNS = {"A2": "pnu", "A13": "approval_raw", "A11": "structure_raw", "A14": "gross_floor_area",
                    "A7": "land_div", "A23": "sigungu"}
NATIONAL_BUILDING_COLUMNS = {"A1": "pnu", "A35": "approval_raw", "A28": "structure_raw",
                             "A24": "gross_floor_area", "A39": "sigungu"}
TRADE_ITEM = "umdNm STRING, jibun STRING, sggCd STRING, dealAmount STRING, excluUseAr STRING, landAr STRING, " \
             "buildYear STRING, dealYear STRING, dealMonth STRING, cdealType STRING"


def renamed(df: DataFrame, names: dict[str, str], extra: list[str] | None = None) -> DataFrame:
    """Only the named source columns, under their own names; absent ones are null."""
    have = set(df.columns)
    cols = [(F.col(k) if k in have else F.lit(None).cast("string")).alias(v) for k, v in names.items()]
    return df.select(*cols, *(extra or []))


def read_parcels(spark: SparkSession, path: str, codes: list[str], *, with_geometry: bool = True) -> DataFrame:
    """Raw parcels of some districts; the filter and column list reach the scan."""
    df = spark.read.parquet(path).where(F.col("A7").isin(*codes))
    return renamed(df, PARCEL_COLUMNS, ["rings"] if with_geometry else None)


def read_zoning(spark: SparkSession, path: str, codes: list[str]) -> DataFrame:
    """(a6, rings) of some districts."""
    df = spark.read.parquet(path).where(F.col("A4").isin(*codes))
    return df.select(F.col("A6").alias("a6"), "rings")


def read_zone_parts(spark: SparkSession, path: str, codes: list[str], classes: tuple[str, ...]) -> DataFrame:
    """Zone polygons of some districts and classes."""
    df = spark.read.parquet(path).where(F.col("SIGNGU_SE").isin(*codes) & F.col("SCLAS_CL").isin(*classes))
    return df.select(F.col("NTFC_SN").alias("zone_id"), F.col("SIGNGU_SE").alias("sigungu"),
                     F.col("SCLAS_CL").alias("zone_type"), "rings")


def read_text_csv(spark: SparkSession, path: str, columns: list[str], *, korean: bool = False) -> DataFrame:
    """CSV with a header, every column text, selected by name.

    ``korean`` reads code page 949, which Spark accepts only in sessions with
    ``spark.sql.legacy.javaCharsets``; ``build_session`` sets it.
    """
    reader = spark.read.option("header", "true").option("enforceSchema", "false")
    if not korean:
        return reader.csv(path).select(*columns)
    if spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise ValueError("code page 949 needs a session with spark.sql.legacy.javaCharsets")
    return reader.option("encoding", "x-windows-949").csv(path).select(*columns)


def read_trade_items(spark: SparkSession, path: str) -> DataFrame:
    """Trade XML replies, one row per item; the file name starts with the trade kind."""
    df = spark.read.format("xml").option("rowTag", "item").schema(TRADE_ITEM).load(path)
    kind = F.regexp_extract(F.input_file_name(), r"([a-z]+)_[0-9]{5}_[0-9]{6}\.xml$", 1)
    return df.withColumn("kind", kind)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """News lines per zone; the zone id is the partition folder or the file name."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "source", "text", "reply")])
    folder = F.regexp_extract("_file", r"zone_id=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract("_file", r"([^/]+)\.jsonl$", 1)
    lines = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path).withColumn("_file", F.input_file_name())
    return lines.withColumn("zone_id", F.when(folder != "", folder).otherwise(name)).drop("_file")


