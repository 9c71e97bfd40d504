"""Phrase collocation mining by relations of occurrences (SETM).

The occurrences of the phrases of one length are a stored relation, sorted by
piece and position. The next length is its merge join with itself on the piece
and the adjacent position; it is counted by group, and its semi-join with the
frequent groups is stored in turn. A stored row holds the occurrences of one
document, so the join runs along sorted positions and never moves a piece
between tasks; only counts of distinct phrases are shuffled.

Groups are first counted by a hash of language and phrase, which can only join
groups, and the semi-join goes through a bitmap of the hashes found frequent,
of at most 32 MB at any size. What passes is then counted by the phrase itself,
so collisions cost work and change no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from parcelgrid.llm.arrow import blocks, byte_table, coded, strings, texts, translated, words
from parcelgrid.llm.common import arrow_batches
from parcelgrid.llm.shingles import mixed
from parcelgrid.session import durable, release

#: A-Z in lower case, white space inside a piece as a blank, what ends a piece as a line feed.
PIECES = byte_table(space="\t", line=".,;:!?\n\x0b\x0c\r")
BLOCK_BYTES = 4 << 20
#: Bits of the bitmap: 16 per frequent phrase, within these powers of two.
LEAST_BITS, MOST_BITS = 16, 28
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
RELATION = "lang string, runs string"


def occurrences(docs: DataFrame) -> DataFrame:
    """The relation of single words, a row per document of ``docs`` (text, lang): its pieces, one a line."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pc.fill_null(b.column("lang").cast(pa.string()), "und"), translated(texts(b), PIECES)], ["lang", "runs"])

    return docs.select("text", "lang").mapInArrow(split, RELATION)


class Relation:
    """Occurrences of ``length`` words in some stored rows.

    A row's ``runs`` are lines of words; in a line every ``length`` words in a
    row are an occurrence, and nothing joins across lines. ``start`` has the
    first word of each occurrence, in order.
    """

    def __init__(self, rows: pa.RecordBatch, length: int):
        lines = pc.split_pattern(rows.column("runs").cast(pa.string()), "\n")
        flat, ends = words(lines.flatten())
        offsets = np.asarray(lines.offsets).astype(np.int64)
        self.code, self.names = coded(flat)
        of_line = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
        self.line = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.doc = of_line[self.line]
        self.end = ends[1:][self.line]
        self.lang, self.langs = coded(rows.column("lang").cast(pa.string()))
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, strings(self.names)), np.uint64, len(self.names))
        salt = np.fromiter((xxhash.xxh3_64_intdigest(x, 1) for x in strings(self.langs)), np.uint64, len(self.langs))
        self.hash, self.lang_hash = hashed[self.code], salt[self.lang]
        self.length = length
        self.start = np.flatnonzero(np.arange(len(self.code)) + length <= self.end)

    def joined(self) -> None:
        """Merge join with itself: an occurrence and the one a place further on in the same line make one of the next length."""
        next_ = np.append(self.start[1:], -1)
        adjacent = (next_ == self.start + 1) & (self.line[self.start] == self.line[next_])
        self.start = self.start[adjacent]
        self.length += 1

    def hashes(self) -> np.ndarray:
        """A number below 2^63 for each occurrence's language and phrase."""
        h = self.lang_hash[self.doc[self.start]]
        for k in range(self.length):
            h = mixed(h * _SPREAD + self.hash[self.start + k])
        return h >> np.uint64(1)

    def groups(self) -> pa.RecordBatch:
        """(lang, phrase, n) of the distinct phrases."""
        lang = self.lang[self.doc[self.start]]
        key, width = lang, max(len(self.names), 1)
        for k in range(self.length):
            # Kept small enough for the next factor by numbering what occurs.
            key = np.unique(key, return_inverse=True)[1] * width + self.code[self.start + k]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        parts = [self.names.take(pa.array(self.code[self.start[first] + k])) for k in range(self.length)]
        return pa.RecordBatch.from_arrays(
            [self.langs.take(pa.array(lang[first])), pc.binary_join_element_wise(*parts, " "), pa.array(n)], ["lang", "phrase", "n"])

    def stored(self) -> pa.RecordBatch:
        """Rows of the relation: adjacent occurrences share a line."""
        if not len(self.start):
            return pa.RecordBatch.from_arrays([pa.array([], pa.string())] * 2, ["lang", "runs"])
        fresh = np.ones(len(self.start), bool)
        fresh[1:] = (self.start[1:] != self.start[:-1] + 1) | (self.line[self.start[1:]] != self.line[self.start[:-1]])
        at = np.flatnonzero(fresh)
        size = np.diff(np.append(at, len(self.start))) + self.length - 1
        bounds = np.concatenate(([0], np.cumsum(size)))
        index = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.start[at], size)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), self.names.take(pa.array(self.code[index]))), " ")
        docs, first = np.unique(self.doc[self.start[at]], return_index=True)
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), lines), "\n")
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[docs])), runs], ["lang", "runs"])


def _joined(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[Relation]:
    """Occurrences of ``length`` words from the stored relation of one word less; single words from their own."""
    for b in blocks(batches, "runs", BLOCK_BYTES):
        r = Relation(b, max(length - 1, 1))
        if length > 1:
            r.joined()
        yield r


def hash_counts(relation: DataFrame, length: int) -> DataFrame:
    """(hash, n) of the phrases of ``length`` words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _joined(batches, length):
            hashes, n = np.unique(r.hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(n)], ["hash", "n"])

    return relation.mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def word_totals(relation: DataFrame) -> DataFrame:
    """(lang, n): all words of the relation of single words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "runs", BLOCK_BYTES):
            _, ends = words(b.column("runs").cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(np.diff(ends))], ["lang", "n"])

    return relation.mapInArrow(count, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")


def bitmap(frequent: DataFrame) -> tuple[int, Broadcast]:
    """(bits, one bit per hash of the frequent phrases): 2 to the power of ``MOST_BITS`` bits at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * max(frequent.count(), 1)))))
    slot = F.col("hash").bitwiseAND((1 << bits) - 1)
    parts = frequent.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << 15) - 1)).alias("held")).collect()
    out = bytearray(1 << (bits - 3))
    for part, held in parts:
        out[part << 12: (part << 12) + len(held)] = held
    return bits, frequent.sparkSession.sparkContext.broadcast(bytes(out))


def extended(relation: DataFrame, length: int, bits: int, held: Broadcast) -> DataFrame:
    """The relation of ``length`` words, of frequent phrases (and what shares a bit with them) only."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(held.value, np.uint8)
        for r in _joined(batches, length):
            slot = r.hashes() & np.uint64((1 << bits) - 1)
            r.start = r.start[(table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            yield r.stored()

    return relation.mapInArrow(extend, RELATION)


def counted(relation: DataFrame, length: int) -> DataFrame:
    """(lang, phrase, n): occurrences of each phrase of the stored relation of ``length`` words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "runs", BLOCK_BYTES):
            yield Relation(b, length).groups()

    return relation.mapInArrow(count, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n) of all phrases of up to ``longest`` words that occur ``least`` times or more, (lang, n) of all words)."""
    with arrow_batches(docs.sparkSession, "8m"):
        relation = durable(occurrences(docs))
        totals = durable(word_totals(relation))
        found = []
        for length in range(1, longest + 1):
            bits, held = bitmap(durable(hash_counts(relation, length).where(F.col("n") >= least)))
            longer = durable(extended(relation, length, bits, held))
            held.unpersist()
            release(relation)
            relation = longer
            level = durable(counted(relation, length).where(F.col("n") >= least))
            found.append(level.select("lang", "phrase", F.lit(length).alias("words"), "n"))
        release(relation)
    out = found[0]
    for level in found[1:]:
        out = out.union(level)
    return out, totals


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language of ``docs`` (text, lang).

    A null lang is ``und``, a null text empty; A-Z count as a-z. Texts fall
    into pieces at ``.,;:!?`` and line ends and pieces into words at blanks and
    tabs. Candidates are phrases of 2 to ``longest`` words in one piece with
    a >= ``least`` occurrences; a candidate scores what its worst cut gives,
    floor(10^6 a^2 / (l r)), the leftmost of equal ones, and is dropped where a
    longer candidate that holds it occurs at least half as often. Equal scores
    go by a, then by the phrase's bytes. Repeated rows count each time; empty
    tables and texts give no rows, other columns are not looked at.
    """
    phrases, totals = frequent_phrases(docs, longest, least)
    candidates = phrases.where("words > 1")
    cut = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).withColumns({
        "_left": F.expr("substring_index(phrase, ' ', k)"), "_right": F.expr("substring_index(phrase, ' ', k - words)")})
    side = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), whole("l") * whole("r"))
    scored = cut.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"]).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut"))
    # Parts of 2 words or more of every longer candidate.
    first = F.explode(F.sequence(F.lit(0), F.col("words") - F.col("m"))).alias("i")
    inside = candidates.where("words > 2").select("lang", "phrase", "words", F.col("n").alias("longer"), F.explode(
        F.sequence(F.lit(2), F.col("words") - 1)).alias("m")).select("lang", "phrase", "longer", "m", first).select(
            "lang", F.expr("array_join(slice(split(phrase, ' '), i + 1, m), ' ')").alias("phrase"), "longer").groupBy("lang", "phrase").agg(
                F.max("longer").alias("longer"))
    free = worst.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 50 * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
