"""Language ID as multilingual mixture inference.

Per language, counts of character n-grams (one to three letters, word ends
included) are added up in Spark into a fixed number of bins. A document is a
mixture of languages: expectation maximisation estimates the proportions from
the likelihoods of its n-grams, for the best one language, the best two and so
on, and the set with the highest penalised likelihood is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelgrid.llm.arrow import blocks, forget, texts

BINS = 1 << 16
#: Bytes of text a task looks at together; its n-grams take some 50 times that.
BLOCK = 1 << 18
#: Languages a task counts at a time before it hands its counts on.
HELD = 64
#: n-grams overlap: each letter is seen by this many of them.
OVERLAP = 6.0
ROUNDS = 12
UNKNOWN = "und"

_HASH = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bin, count) of the distinct n-gram bins of each text in row order, and letters per text.

    Letters are lower case; what is no letter is a word end.
    """
    low = [t.lower() for t in column.to_pylist()]
    size = np.fromiter(map(len, low), np.int64, len(low)) + 2
    c = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32) if low else np.zeros(0, np.uint32)
    letter = _is_letter()[c]
    c = np.where(letter, c, 32)
    row = np.repeat(np.arange(len(low)), size)
    letters = np.bincount(row[letter], minlength=len(low))
    one = c * _HASH[0]
    two = (one[:-1] ^ (one[:-1] >> 15)) * _HASH[1] + c[1:]
    three = (two[:-1] ^ (two[:-1] >> 13)) * _HASH[2] + c[2:]
    ends = np.cumsum(size)
    out = np.zeros(BINS, np.int32)
    found, counts, rows = [], [], []
    hashed = [(g * np.uint32(0x27D4EB2F)) >> 16 for g in (one, two, three)]
    keep = [letter, letter[:-1] | letter[1:], letter[1:-1] | (letter[:-2] & letter[2:])]
    for i, (a, b) in enumerate(zip((ends - size).tolist(), ends.tolist())):
        if not letters[i]:
            continue
        bins = np.concatenate([h[a: b - k][m[a: b - k]] for k, (h, m) in enumerate(zip(hashed, keep))])
        if len(bins) > 4096:
            out = np.bincount(bins, minlength=BINS)
            u = np.flatnonzero(out)
            n = out[u]
        else:
            u, n = np.unique(bins, return_counts=True)
        found.append(u)
        counts.append(n)
        rows.append(np.full(len(u), i))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(found).astype(np.int64), join(counts), letters


def language_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bin, n): n-gram counts per language over all rows whose language is known."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[str, np.ndarray] = {}

        def out():
            for name, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bin", "n"])
            held.clear()

        for b in blocks(batches, "_text", BLOCK):
            row, bins, n, _ = ngrams(texts(b, "_text"))
            names = np.array(b.column("_lang").to_pylist(), object)
            for name in sorted(set(names)):
                if len(held) >= HELD and name not in held:
                    yield from out()
                mine = (names == name)[row]
                held[name] = held.get(name, 0) + np.bincount(bins[mine], n[mine], BINS).astype(np.int64)
        yield from out()

    known = docs.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).where("_lang IS NOT NULL")
    return known.mapInArrow(count, "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def trained(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, bins x languages probabilities); languages x ``BINS`` rows at most come to the driver."""
    got = counts.where("n > 0").toPandas()
    names = sorted(set(got["lang"]))
    n = np.zeros((BINS, len(names)))
    n[got["bin"].to_numpy(np.int64), np.searchsorted(names, got["lang"].to_numpy(object)) if names else []] = got["n"].to_numpy()
    return names, ((n + 0.1) / (n + 0.1).sum(axis=0)).astype(np.float32)


def mixture(row: np.ndarray, bins: np.ndarray, n: np.ndarray, rows: int, model: np.ndarray) -> np.ndarray:
    """rows x languages proportions; languages outside the chosen set have 0, rows without n-grams are all 0."""
    langs = model.shape[1]
    out = np.zeros((rows, langs), np.float32)
    if not len(row) or not langs:
        return out
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    ids, of = row[first], np.cumsum(np.concatenate(([False], row[1:] != row[:-1])))
    p, c = model[bins], n.astype(np.float32)
    total = np.add.reduceat(c, first)
    alone = np.add.reduceat(c[:, None] * np.log(p), first, axis=0)
    order = np.argsort(-alone, axis=1, kind="stable")
    best = np.zeros((len(ids), langs), np.float32)
    best[np.arange(len(ids)), order[:, 0]] = 1
    value = alone.max(axis=1)
    chosen = best.astype(bool)
    active = np.arange(len(ids))
    for size in range(2, langs + 1):
        # Add to each set the language that gains most where the set explains least.
        take = np.isin(of, active) if len(active) < len(ids) else slice(None)
        ps, cs = p[take], c[take]
        o = of[take] if not isinstance(take, slice) else of
        start = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        local = np.cumsum(np.concatenate(([False], o[1:] != o[:-1])))
        now = (best[active][local] * ps).sum(axis=1)
        gain = np.add.reduceat(cs[:, None] * np.log1p(0.1 * (ps / now[:, None] - 1)), start, axis=0)
        gain[chosen[active]] = -np.inf
        extra = gain.argmax(axis=1)
        sets = chosen[active].copy()
        sets[np.arange(len(active)), extra] = True
        share = np.where(sets, 1.0 / size, 0).astype(np.float32)
        for _ in range(ROUNDS):
            w = share[local] * ps
            w *= (cs / w.sum(axis=1))[:, None]
            share = np.add.reduceat(w, start, axis=0) / total[active][:, None]
        like = np.add.reduceat(cs * np.log((share[local] * ps).sum(axis=1)), start)
        better = (like - value[active]) / OVERLAP > 0.5 * np.log(np.maximum(total[active] / OVERLAP, 2)) + 1
        up = active[better]
        best[up], chosen[up], value[up] = share[better], sets[better], like[better]
        active = up
        if not len(active):
            break
    out[ids] = best
    return out


def languages(docs: DataFrame, model: tuple[list[str], np.ndarray], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, langs, shares) of every row.

    lang_pred is the language with the largest share, score its share, langs
    and shares the chosen set, largest first. A null text, a text without a
    letter, and every text when no language was learned, is ``und`` with score
    0 and an empty set. Whole texts are read; equal shares go to the language
    whose name comes first. Other columns of ``docs`` are not looked at.
    """
    names, table = model
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BINS rows, one number per language

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in blocks(batches, "_text", BLOCK):
            row, bins, n, letters = ngrams(texts(b, "_text"))
            share = mixture(row, bins, n, b.num_rows, shared.value)
            order = np.argsort(-share, axis=1, kind="stable")
            pred, score, sets, shares = [], [], [], []
            for i in range(b.num_rows):
                top = [j for j in order[i] if share[i, j] > 0]
                pred.append(names[top[0]] if top else UNKNOWN)
                score.append(min(1.0, float(share[i, top[0]])) if top else 0.0)
                sets.append([names[j] for j in top])
                shares.append([float(share[i, j]) for j in top])
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                 pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["_key", "lang_pred", "score", "langs", "shares"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        guess, f"_key {kind}, lang_pred string, score double, langs array<string>, shares array<double>").withColumnRenamed("_key", key)


def held_out(key: str = "doc_id"):
    """Rows kept apart from training: a fixed quarter by checksum of the key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def explained(row: np.ndarray, bins: np.ndarray, n: np.ndarray, share: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text's n-grams under its mixture, less that under a uniform draw of bins; 0 without n-grams."""
    p = (share[row] * model[bins]).sum(axis=1, dtype=np.float64)
    return np.bincount(row, n * np.log(np.maximum(p, 1e-30) * BINS), len(share))


def with_clear_language(docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text the learned languages explain, with all their columns.

    A text stays if the chosen set of languages, one or several, makes its
    n-grams likelier than a uniform draw of bins. Null texts and texts without
    a letter go. Where no language can be learned (no labels) every text with a
    letter stays.
    """
    model = trained(language_counts(docs.where(~held_out(key))))
    names, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in blocks(batches, "text", BLOCK):
            row, bins, n, letters = ngrams(texts(b))
            stays = letters > 0
            if names:
                share = mixture(row, bins, n, b.num_rows, shared.value)
                stays &= explained(row, bins, n, share, shared.value) > 0
            yield b.filter(pa.array(stays))

    return docs.mapInArrow(keep, docs.schema)
