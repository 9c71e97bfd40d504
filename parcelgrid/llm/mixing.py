"""Mixing sources to target weights.

Tokens are added up per source, targets are found from the sums, and each
document is emitted floor(rate) times plus one more copy with a probability
equal to the fraction. The draws are seeded by hashes and spread evenly over
documents of like size (systematic draws with a random start per stratum), so
every document keeps its exact probability while the taken words stay close to
the target even where a few documents are very long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.llm.common import if_small
from parcelgrid.session import durable

#: Rows of a stratum that are drawn from together.
STRATUM_ROWS = 96


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Tokens to take per source: ``share`` of all, split by weight.

    A target stops at ``cap`` times its source; what it leaves is split among
    the others by weight until none is above.
    """
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: (cap * sizes[i] / weights[i], i))
    rest, weight, level = share * sum(sizes), float(sum(weights)), 0.0
    for i in order:
        level = rest / weight
        if level <= cap * sizes[i] / weights[i]:
            break
        rest, weight = rest - cap * sizes[i], weight - weights[i]
    return [min(cap * s, level * w) for s, w in zip(sizes, weights)]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def drawn(docs: DataFrame, *, size: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
          key: str = "doc_id", source: str = "source", seed: str = "mix") -> DataFrame:
    """(row, size, source_size, target, copies) of every row of ``docs``; row holds all its columns.

    ``size`` is the tokens of a row, the words of its text unless given.
    ``weights`` repeat over the sources in code-point order, a null source
    last. One row per source comes to the driver. Rows without words are drawn
    like others; a source without any words has target 0 and no copies. Rows
    that repeat a key are drawn each. The result depends on keys, sources and
    sizes only, so reruns agree; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    sized = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).alias("_key"), F.col(source).alias("_source"),
                        (word_count(F.col("text")) if size is None else size).alias("size"))
    width = F.length(F.bin("size"))
    strata = durable(sized.groupBy(F.col("_source").alias("_of"), width.alias("_width")).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("_sum")))
    totals = strata.groupBy("_of").agg(F.sum("_sum").alias("n")).orderBy(F.asc_nulls_last("_of")).collect()
    weight = [float(weights[i % len(weights)]) for i in range(len(totals))]
    goal = targets([t.n for t in totals], weight, share, cap)
    plan = [(t["_of"], t.n, g, g / t.n if t.n else 0.0) for t, g in zip(totals, goal)]
    kind = docs.schema[source].dataType.simpleString()
    table = spark.createDataFrame(plan, f"_of {kind}, source_size bigint, target double, _rate double")
    parts = durable(strata.join(table, strata["_of"].eqNullSafe(table["_of"])).select(
        strata["_of"], "_width", F.ceil(F.col("_rows") / F.lit(STRATUM_ROWS)).cast("int").alias("_parts"),
        "source_size", "target", "_rate"))
    near = if_small(parts)
    rows = sized.withColumn("_w", width)
    rows = rows.join(near, rows["_source"].eqNullSafe(near["_of"]) & (rows["_w"] == near["_width"])).withColumn(
        "_part", F.floor(uniform(F.col("_key"), F.lit(seed)) * F.col("_parts")).cast("int"))
    number = F.row_number().over(Window.partitionBy("_of", "_width", "_part").orderBy(F.desc("size"), "_key")) - 1
    start = uniform(F.col("_of"), F.col("_width"), F.col("_part"), F.lit(seed))
    part = F.col("_rate") - F.floor("_rate")
    more = F.floor(start + (F.col("_i") + 1) * part) - F.floor(start + F.col("_i") * part)
    return rows.withColumn("_i", number).select(
        "row", "size", "source_size", "target", (F.floor("_rate") + more).cast("bigint").alias("copies"))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, with all its columns."""
    made = drawn(docs, **options).where("copies > 0")
    return made.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
