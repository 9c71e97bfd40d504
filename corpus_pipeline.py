"""Corpus pipeline: language ID, exact dedup, near dedup, source mixture, packing.

Each stage reads what its predecessor wrote and its decisions take effect: a
stage returns the columns of ``documents`` for the rows that go on, and the
last one returns packed pieces. ``python corpus_pipeline.py FOLDER`` prints
the number of rows of each stage.
"""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelgrid.llm.exact_dedup import without_copies
from parcelgrid.llm.language import with_clear_language
from parcelgrid.llm.mixing import emitted
from parcelgrid.llm.near_dedup import without_near_copies
from parcelgrid.llm.packing import packed
from parcelgrid.llm.queries import tokenizer_file
from parcelgrid.llm.registry import query
from parcelgrid.session import scratch_root


def _small_batches(spark: SparkSession) -> None:
    """Few bytes at once between Spark and Python: stages share executors with what earlier ones still hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the learned languages explain, one or several at once (operator 7)."""
    _small_batches(spark)
    return with_clear_language(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts (operator 6)."""
    return without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more (operator 1)."""
    _small_batches(spark)
    return without_near_copies(docs, size=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them (operator 2)."""
    return emitted(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens (operator 5)."""
    _small_batches(spark)
    return packed(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"), end=2, digest={"ids_crc32": F.crc32},
                  with_ids=False, block=1 << 18)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("packing", pack_stage),
]

#: Signatures, mixtures of n-grams and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet to the shared folder and read by the next."""
    root = f"{scratch_root(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs


query("pipeline")(run)


if __name__ == "__main__":
    from parcelgrid.session import build_session

    session = build_session("corpus pipeline")
    rows = session.read.parquet(f"{sys.argv[1]}/documents.parquet")
    print("documents", rows.count())
    for label, step in STAGES:
        target = f"{scratch_root(session)}/pipeline/{uuid.uuid4().hex}"
        step(session, rows, sys.argv[1]).write.parquet(target)
        rows = session.read.parquet(target)
        print(label, rows.count())
