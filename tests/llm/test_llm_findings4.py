"""Cases of the findings of round 4."""

from pyspark.sql import functions as F

from parcelgrid.llm import mixing


def test_draws_are_spread_over_documents_of_like_size(spark):
    rows = [(i, f"s{i % 4}", (i * 7919) % 400 + (20_000 if i % 500 == 0 else 0)) for i in range(4000)]
    got = mixing.drawn(spark.createDataFrame(rows, "doc_id bigint, source string, n int"), size=F.col("n")).groupBy("row.source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 4 and all(abs(r.taken - r.target) < 0.03 * r.target for r in got)
