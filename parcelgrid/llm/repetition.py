"""Quality rules on repetition, by suffix arrays.

For every text the suffixes of its words are sorted by prefix doubling, and
the common prefixes of neighbours in that order give, at every position, the
longest stretch that occurs again in the text. Stretches of a least length are
the text's maximal repeats; the union of their spans and the longest of them
decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parcelgrid.llm.arrow import blocks, coded, texts, words

#: Words from which a repeat counts, and the limits of the verdict.
LEAST_REPEAT = 5
MOST_COVERED_PERCENT = 50
LONGEST_SHARE_PERCENT = 30
LONGEST_FREE = 50
SYMBOLS = "#*$%&|<>"


def repeats(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At each word, the number of words from there on that occur again, in the same order, elsewhere in the same row.

    ``codes`` are the words of all rows, ``at`` the rows' offsets. Suffixes of
    all rows are sorted together; the row is part of the first rank, so no
    match crosses rows.
    """
    n = len(codes)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[1:][row]
    order = np.argsort(row * (int(codes.max()) + 1) + codes, kind="stable")
    same = (row[order][1:] == row[order][:-1]) & (codes[order][1:] == codes[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(n), 0))
    suffix = order
    levels = [rank.astype(np.int32) if n < 1 << 31 else rank]
    slots = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    paired = np.flatnonzero(same) + 1  # slots whose suffix shares its first word with the one before
    h = 1
    while len(slots):
        here = suffix[slots]
        second = np.where(here + h < end[here], rank[np.minimum(here + h, n - 1)] + 1, 0)
        first = rank[here]
        key = first * (n + 1) + second
        by = np.argsort(key, kind="stable")
        here, first, key = here[by], first[by], key[by]
        suffix[slots] = here
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[here] = np.maximum.accumulate(np.where(fresh, slots, 0))
        levels.append(rank.astype(np.int32) if n < 1 << 31 else rank)
        same = ~fresh[1:]
        slots = slots[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        h *= 2
    # Common prefix of neighbours: the largest power of two first.
    a, b = suffix[paired - 1].copy(), suffix[paired].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        inside = np.maximum(i, j) < n
        hit = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        common[hit] += 1 << k
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(length: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Whether each word lies in a repeat of ``least`` words or more (of which ``span`` words count from its start)."""
    start = np.flatnonzero(length >= least)
    stop = start + (length[start] if span is None else span)
    n = len(length)
    return np.cumsum(np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1))[:n] > 0


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def repetition(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST_REPEAT,
               percent: int = MOST_COVERED_PERCENT, longest_percent: int = LONGEST_SHARE_PERCENT, longest_free: int = LONGEST_FREE) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest_repeat, base_failed, kept) of every row.

    n_covered: words inside repeats of ``least`` words or more; longest_repeat:
    words of the longest repeat. kept is false if base_failed, if more than
    ``percent`` % of the words are covered, or if the longest repeat exceeds
    both ``longest_free`` words and ``longest_percent`` % of the words. A null,
    empty or blank text has 0 everywhere and is not kept. Whole texts are read;
    other columns of ``docs`` are not looked at, and repeated rows give a row
    each.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", 2 << 20):
            column = texts(b, "_text")
            flat, at = words(column)
            codes, _ = coded(flat)
            length = repeats(codes, at)

            def per_row(x: np.ndarray) -> np.ndarray:
                total = np.concatenate(([0], np.cumsum(x)))
                return total[at[1:]] - total[at[:-1]]

            longest = np.zeros(len(column), np.int64)
            if len(length):
                full = at[1:] > at[:-1]
                longest[full] = np.maximum.reduceat(length, at[:-1][full])
            chars = pc.utf8_length(flat).to_numpy(zero_copy_only=False)
            symbols = pc.count_substring_regex(column, f"[{SYMBOLS}]")
            lines = [duplicate_lines(t) for t in column.to_pylist()]
            measured = [at[1:] - at[:-1], per_row(chars), symbols, lines, per_row(covered(length, 3, 3)),
                        per_row(covered(length, least)), longest]
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), *[pc.cast(pa.array(m) if not isinstance(m, pa.Array) else m, pa.int64()) for m in measured]], names)

    made = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        measure, f"_key {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))
    n, longest = F.col("n_words"), F.col("longest_repeat")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    bad = (100 * F.col("n_covered") > percent * n) | ((longest > longest_free) & (100 * longest > longest_percent * n))
    return made.withColumn("base_failed", base).withColumn("kept", ~base & ~bad).withColumnRenamed("_key", key)
