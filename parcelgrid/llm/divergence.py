"""Source divergence audit by count cells.

Per language, each source's share of every kept term is held against the other
sources' shares and the language's. A term's value depends on two counts only,
so terms are grouped into cells of equal (group count, other count), the value
is worked out once per cell, cells of equal value are merged, and a group's
best terms are found by adding up multiplicities before any term is expanded.
All arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.llm.arrow import blocks, byte_table, coded, texts, translated, words
from parcelgrid.llm.common import if_small
from parcelgrid.session import durable

#: Everything below 128 that is no letter parts terms.
LETTERS = byte_table(space="".join(map(chr, [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))
BLOCK_BYTES = 8 << 20
UNIT = 1_000_000_000
SMOOTHING = 2


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) per block of texts: occurrences, and documents that hold the term.

    ``docs`` has text, lang and source, none of them null. A block has a row
    for what it holds; sums over blocks are left to the caller.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=BLOCK_BYTES):
            flat, at = words(translated(texts(b), LETTERS))
            code, names = coded(flat)
            if not len(code):
                continue
            lang, langs = coded(texts(b, "lang"))
            source, sources = coded(texts(b, "source"))
            group = lang * len(sources) + source
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))
            held, n = np.unique(doc * len(names) + code, return_counts=True)
            key, where = np.unique(group[held // len(names)] * len(names) + held % len(names), return_inverse=True)
            group, term = key // len(names), key % len(names)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), names.take(pa.array(term)),
                 pa.array(np.bincount(where, n).astype(np.int64)), pa.array(np.bincount(where))],
                ["lang", "source", "term", "n", "docs"])

    return docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTHING) / total), exactly; ``total`` is null where a language keeps no term."""
    whole = (count.cast("decimal(19,0)") + F.lit(SMOOTHING).cast("decimal(1,0)")) * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", whole, total.cast("decimal(19,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares of at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, lang_n, lead) of terms in at least ``least_docs`` documents of the language, n > 0.

    ``lead`` marks one row per (lang, term). Blocks have added up their own
    terms, so a term has at most one row per block and source.
    """
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("_docs"),
                         (F.col("source") == F.min("source").over(term)).alias("lead")).where(F.col("_docs") >= least_docs).drop("_docs")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms) of every group: N + 2V of the group and of its language (null if V = 0), V."""
    groups = docs.select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("lead").cast("long")).alias("terms"))
    both = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return both.select("lang", "source", (F.coalesce("n", F.lit(0)) + SMOOTHING * F.col("terms")).alias("total"),
                       (F.col("lang_n") + SMOOTHING * F.col("terms")).alias("lang_total"), F.coalesce("terms", F.lit(0)).alias("terms"))


def best_terms(kept: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of the ``top`` terms with a larger share in the group than in its language."""
    key = ["lang", "source"]
    cells = durable(kept.groupBy(*key, "n", "lang_n").agg(F.count(F.lit(1)).alias("many")).join(if_small(totals), key).select(
        *key, "n", "lang_n", "many", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q")
    ).where("p > q").select(*key, "n", "lang_n", "many", gap(F.col("p"), F.col("q")).alias("value")))
    best = Window.partitionBy(*key).orderBy(F.desc("value"))
    # Each value stands for a term at least, so the largest ``top`` values hold the answer.
    values = cells.groupBy(*key, "value").agg(F.sum("many").alias("many")).withColumn("_row", F.row_number().over(best)).where(
        F.col("_row") <= top)
    above = F.coalesce(F.sum("many").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = values.withColumn("_above", above).where(F.col("_above") < top).select(*key, "value")
    chosen = durable(cells.join(needed, [*key, "value"]).select(*key, "n", "lang_n", "value"))
    named = kept.join(if_small(chosen), [*key, "n", "lang_n"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("value"), "term"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select(*key, F.col("term").alias("item"), "value", "rank")


def pair_sums(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every two sources of a language, the values of all its kept terms added up.

    Terms that only one of the two holds depend on one count, so their sums
    come from the group's histogram of counts; terms that both hold come from
    cells of two counts; the rest share the value of two zero counts.
    """
    zero = F.lit(0)
    a = totals.select("lang", F.col("source").alias("a"), F.col("total").alias("ta"), "terms")
    b = totals.select("lang", F.col("source").alias("b"), F.col("total").alias("tb"))
    none = lambda: gap(share(zero, F.col("ta")), share(zero, F.col("tb")))
    pairs = durable(a.join(b, "lang").where("a < b").withColumn("none", none()))
    one_sided = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("many")).join(if_small(totals), ["lang", "source"]).select(
        "lang", F.col("source").alias("s"), F.col("total").alias("t"), "many", share(F.col("n"), F.col("total")).alias("p"))
    others = totals.select("lang", F.col("source").alias("o"), share(zero, F.col("total")).alias("q"), share(zero, F.col("total")).alias("q0"))
    own = totals.select("lang", F.col("source").alias("s"), share(zero, F.col("total")).alias("p0"))
    sides = one_sided.join(if_small(own), ["lang", "s"]).join(if_small(others), "lang").where("s <> o").select(
        "lang", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"),
        (F.col("many") * (gap(F.col("p"), F.col("q")) - gap(F.col("p0"), F.col("q0")))).alias("part"))
    left = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("na"))
    right = kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("nb"))
    cells = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("many"))
    pa_, pb, pa0, pb0 = (share(c, F.col(t)) for c, t in ((F.col("na"), "ta"), (F.col("nb"), "tb"), (zero, "ta"), (zero, "tb")))
    both = cells.join(if_small(pairs), ["lang", "a", "b"]).select(
        "lang", "a", "b", (F.col("many") * (gap(pa_, pb) - gap(pa_, pb0) - gap(pa0, pb) + F.col("none"))).alias("part"))
    sums = sides.groupBy("lang", "a", "b").agg(F.sum("part").alias("part")).union(
        both.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    full = durable(pairs.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", (F.coalesce(F.col("terms") * F.col("none"), zero) + F.coalesce("part", zero)).cast("long").alias("value")))
    mirrored = full.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        full.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    return mirrored.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audited(docs: DataFrame, *, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of ``docs`` (text, lang, source).

    Null text, lang and source count as empty. Terms are runs of letters A-Z,
    a-z (the former in lower case) and characters beyond ASCII; a language
    keeps those in at least ``least_docs`` of its rows. Rows count one by one,
    repeated ones too. Part ``pair`` ranks the language's other sources, part
    ``term`` the group's terms, ties in UTF-8 order. A language of one source
    has no pairs, one without kept terms has pairs of value 0 and no terms; an
    empty table gives no rows. Other columns are not looked at.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = durable(kept_counts(docs, least_docs))
    totals = durable(group_totals(docs, kept))
    parts = [rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
             for name, rows in (("pair", pair_sums(kept, totals)), ("term", best_terms(kept, totals, top)))]
    return parts[0].union(parts[1])
