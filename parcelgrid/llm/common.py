"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space that separates words, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a few numbers that may be sent to every executor: some 20 MB at most.
SMALL_ROWS = 400_000


def if_small(rows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``rows`` (a written table of a few numbers a row), to be broadcast only if they are few.

    Beyond the limit the join shuffles both sides.
    """
    return F.broadcast(rows) if rows.count() <= limit else rows


def normalised(text: Column) -> Column:
    """Text with every run of white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def both_ways(links: DataFrame, a: str, b: str) -> DataFrame:
    """(src, dst) of links, in both directions."""
    one = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return one.union(one.select("dst", "src"))


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """Batches of at most ``size`` bytes between Spark and Python for what runs inside, then the session's own again."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, own)
