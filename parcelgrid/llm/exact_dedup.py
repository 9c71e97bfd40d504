"""Exact dedup: distributed radix partitioning from the first byte on.

Each round splits every group of texts that agree so far by their next bytes.
Texts left alone drop out, texts that have ended stay with their group. The
digits widen from round to round, so a text of n bytes takes O(log n) rounds,
and only bytes of texts that still have company are dealt out. Two texts are
held equal because all their bytes were compared; no digest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.llm.common import if_small, normalised
from parcelgrid.session import durable, release

FIRST_WIDTH, WIDER, MOST_WIDTH = 64, 16, 1 << 20


def _split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` are shared, with _gid, the smallest row number of their group.

    Groups are counted with partial sums and written before the rows are joined
    to them, so a group with a third of all rows is an ordinary skewed join.
    """
    groups = durable(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_next"))
        .where("_n > 1").drop("_n"))
    return rows.join(groups, keys).withColumn("_gid", F.col("_next")).drop("_next")


def equal_rows(rows: DataFrame, value: Column) -> DataFrame:
    """(_rid, _gid) of rows whose ``value`` occurs more than once; _gid is the smallest _rid of the equals.

    ``rows`` is a written table with unique row numbers ``_rid``. The length is
    the first digit, as it tells where a text ends.
    """
    raw = F.encode(value, "UTF-8")
    first = rows.select("_rid", F.octet_length(value).alias("_size"), F.substring(raw, 1, FIRST_WIDTH).alias("_digit"))
    met = durable(_split(first, ["_size", "_digit"]).select("_rid", "_gid", "_size"))
    ended = met.where(F.col("_size") <= FIRST_WIDTH).select("_rid", "_gid")
    more = met.where(F.col("_size") > FIRST_WIDTH)
    live = durable(rows.join(if_small(more), "_rid").select(
        "_rid", "_gid", "_size", F.substring(raw, FIRST_WIDTH + 1, (1 << 31) - 1).alias("_rest")))
    at, width = FIRST_WIDTH, FIRST_WIDTH * WIDER
    while not live.isEmpty():
        digits = live.withColumn("_digit", F.substring("_rest", 1, width))
        met = durable(_split(digits, ["_gid", "_digit"]).select(
            "_rid", "_gid", "_size", F.substring("_rest", width + 1, (1 << 31) - 1).alias("_rest")))
        release(live)
        at += width
        width = min(width * WIDER, MOST_WIDTH)
        ended = ended.union(met.where(F.col("_size") <= at).select("_rid", "_gid"))
        live = met.where(F.col("_size") > at)
    return ended


def numbered(docs: DataFrame) -> DataFrame:
    """(row, _rid): ``docs`` written once, its columns as ``row``, with row numbers that stay as they are from then on."""
    return durable(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("_rid")))


def _classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(_rid, keep_id, _keep, group_size) of the rows that have equals."""
    pairs = durable(equal_rows(rows, normalised(F.col("row")[text])))
    ids = pairs.join(rows.select("_rid", F.col("row")[key].alias("_key")), "_rid")
    first = F.min(F.struct(F.col("_key").isNull(), F.col("_key"), F.col("_rid"))).alias("_first")
    groups = durable(ids.groupBy("_gid").agg(first, F.count(F.lit(1)).alias("group_size")).select(
        "_gid", F.col("_first._key").alias("keep_id"), F.col("_first._rid").alias("_keep"), "group_size"))
    return durable(pairs.join(groups, "_gid").drop("_gid"))


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                     extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, keep_id, group_size, kept) of every row, and ``extra`` columns made of its columns.

    Texts are equal when they are identical after each run of white space is
    one blank; null counts as empty, and empty texts are equal to one another.
    The row with the smallest key stays; among rows with that same key the
    first one read does; a null key comes after all others. Extra columns of
    ``docs`` are not looked at.
    """
    extra = extra or {}
    rows = numbered(docs)
    own = F.col("row")[key]
    return rows.select("_rid", own.alias("_key"), *[c.alias(n) for n, c in extra.items()]).join(
        _classes(rows, key, text), "_rid", "left").select(
            F.col("_key").alias(key), F.when(F.col("group_size").isNull(), F.col("_key")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
            F.coalesce(F.col("_keep") == F.col("_rid"), F.lit(True)).alias("kept"), *extra)


def without_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = numbered(docs)
    gone = durable(_classes(rows, key, text).where("_keep <> _rid").select("_rid"))
    return rows.join(if_small(gone), "_rid", "left_anti").select("row.*")
