"""Packing: shortest-pack-first over the histogram of lengths.

Only the histogram of piece lengths, at most one row per possible length,
comes to the driver. Lengths are placed longest first, always into the
emptiest pack that has room, for all packs of a pattern at once. Pieces then
find their pack by their rank among the pieces of their length.

Where whole pieces would leave much padding, the emptiest packs are cut up to
fill the others, and what stays far from full is cut into sequences whose
lengths are powers of two.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelgrid.llm.arrow import blocks, coded, give_back, kept, strings, texts, words
from parcelgrid.llm.common import arrow_batches, if_small
from parcelgrid.llm.token_counts import REMEMBERED, tokenizer
from parcelgrid.session import durable

#: Share of padding below which no piece is cut for the sake of packing.
FINE = 0.0025
#: Words of letters that are encoded as one text.
JOINED = 256
#: Bytes of text a task encodes together.
BLOCK = 1 << 20


class Plan:
    """Where the pieces of each length go; a kind of piece is (generation, length)."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # free tokens -> (packs, items)
        self.free: list[int] = []
        self.cuts: list[tuple] = []  # kind, pieces, generation of the parts, [(start, length)]
        self._place({(0, n): c for n, c in histogram.items()})
        generation = 0
        packs = math.inf
        while self._padding() > FINE and self._count() < packs:
            generation += 1
            packs = self._count()
            self._place(self._dissolved(generation))
        self.packs = [(c, items) for r in sorted(self.room) for c, items in self.room[r] if r <= capacity // 64]
        for r in sorted(self.room):
            if r > capacity // 64:
                for c, items in self.room[r]:
                    self._split(c, items, generation + 1)

    def _count(self) -> int:
        return sum(c for some in self.room.values() for c, _ in some)

    def _gap(self) -> int:
        return sum(r * c for r, some in self.room.items() for c, _ in some)

    def _padding(self) -> float:
        return self._gap() / max(1, self._count() * self.capacity)

    def _put(self, free: int, packs: int, items: tuple) -> None:
        self.room[free].append((packs, items))
        heapq.heappush(self.free, -free)

    def _place(self, pieces: dict[tuple[int, int], int]) -> None:
        for kind, n in sorted(pieces.items(), key=lambda x: -x[0][1]):
            length = kind[1]
            while n:
                while self.free and not self.room[-self.free[0]]:
                    heapq.heappop(self.free)
                free = -self.free[0] if self.free else 0
                if free >= length:
                    packs, items = self.room[free].pop()
                    used, times = min(packs, n), 1
                    if packs > used:
                        self.room[free].append((packs - used, items))
                else:  # a new pack, which then is the emptiest one for those that follow
                    free, items = self.capacity, ()
                    times = min(n, self.capacity // length)
                    used = n // times
                self._put(free - length * times, used, (*items, (kind, times)))
                n -= used * times

    def _dissolved(self, generation: int) -> Counter:
        """Pieces of the emptiest packs, cut into powers of two, as many as the other packs have room for."""
        gaps = self._gap() // self.capacity
        loose: Counter = Counter()
        for free in sorted(self.room, reverse=True):
            while gaps and free and self.room[free]:
                packs, items = self.room[free].pop()
                used = min(packs, gaps)
                if packs > used:
                    self.room[free].append((packs - used, items))
                gaps -= used
                for kind, times in items:
                    parts = _powers(kind[1], 32, max(free, 32))
                    self.cuts.append((kind, used * times, generation, parts))
                    for _, length in parts:
                        loose[generation, length] += used * times
        return loose

    def _split(self, packs: int, items: tuple, generation: int) -> None:
        """Packs cut into sequences of a power of two each."""
        ends = [a + n for a, n in _powers(sum(k[1] * t for k, t in items), 1)]
        sequences: list[Counter] = [Counter() for _ in ends]
        at, s = 0, 0
        for kind, times in items:
            for _ in range(times):
                start, parts = at, []
                while at < start + kind[1]:
                    end = min(ends[s], start + kind[1])
                    parts.append((at - start, end - at))
                    sequences[s][generation, end - at] += 1
                    at = end
                    s += at == ends[s]
                self.cuts.append((kind, packs, generation, parts))
        self.packs += [(packs, tuple(x.items())) for x in sequences]

    def table(self) -> dict[tuple[int, int], list[tuple]]:
        """Ranges of ranks per kind: (first, rows, place) with place (sequence, offset, times) or parts (start, length, rank)."""
        taken: Counter = Counter()
        out: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        sequence = 0
        for packs, items in self.packs:
            offset = 0
            for kind, times in items:
                out[kind].append((taken[kind], packs * times, (sequence, offset, times)))
                taken[kind] += packs * times
                offset += kind[1] * times
            sequence += packs
        made: Counter = Counter()
        for kind, rows, generation, parts in self.cuts:
            ranked = []
            for start, length in parts:
                ranked.append((start, (generation, length), made[generation, length]))
                made[generation, length] += rows
            out[kind].append((taken[kind], rows, ranked))
            taken[kind] += rows
        return dict(out)


def _powers(n: int, least: int, most: int = 1 << 62) -> list[tuple[int, int]]:
    """(start, length) of cuts of n tokens at powers of two, largest first; under ``least`` the rest stays whole."""
    out, at = [], 0
    while n - at >= least:
        length = 1 << (min(n - at, most).bit_length() - 1)
        out.append((at, length))
        at += length
    if at < n:
        out.append((at, n - at))
    return out


def placed(table: dict, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in the piece, length, sequence, offset) of everything the pieces are cut into."""
    done = []
    todo = {(0, int(n)): (np.flatnonzero(length == n), rank[length == n], 0) for n in np.unique(length)}
    work = [(kind, row, at, np.zeros(len(row), np.int64)) for kind, (row, at, _) in todo.items()]
    while work:
        kind, row, at, start = work.pop()
        ranges = table[kind]
        firsts = np.array([x[0] for x in ranges])
        which = np.searchsorted(firsts, at, "right") - 1
        for k in np.unique(which):
            here = which == k
            first, _, place = ranges[k]
            r, a, s = row[here], at[here] - first, start[here]
            if isinstance(place, list):
                work += [(part, r, a + below, s + begin) for begin, part, below in place]
            else:
                sequence, offset, times = place
                done.append((r, s, np.full(len(r), kind[1]), sequence + a // times, offset + a % times * kind[1]))
    if not done:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*done))


@cache
def drops_blanks(path: str) -> bool:
    """Whether the tokenizer drops white space, so that words can be encoded one by one."""
    t = json.loads(tokenizer(path).to_str())
    norm, pre = t["normalizer"] or {}, t["pre_tokenizer"] or {}
    split = (pre.get("pretokenizers") or [{}])[0]
    plain = {"NFC", "Replace", "Lowercase"}
    return (t["post_processor"] is None and norm.get("type") == "Sequence" and {x["type"] for x in norm["normalizers"]} <= plain
            and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
            and all(not x["lstrip"] and not x["rstrip"] and " " not in x["content"] for x in t["added_tokens"]))


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after another."""
    total = np.cumsum(size)
    return pool[np.repeat(begin - total + size, size) + np.arange(total[-1] if len(total) else 0)]


class WordIds:
    """Ids of words, remembered; beyond ``most`` words only those met again stay."""

    def __init__(self, path: str, most: int = REMEMBERED // 2):
        self.most = most
        self.tokenizer = tokenizer(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self.index: dict[str, int] = {}
        self.pool, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one_by_one(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number per word). Words of letters alone are encoded many at a time: each has one id that ends a word."""
        whole = np.zeros(len(new), bool)
        if self.ends is not None and new:
            whole = pc.match_substring_regex(pa.array(new, pa.string()), r"^\p{L}+$").to_numpy(zero_copy_only=False)
        size = np.zeros(len(new), np.int64)
        parts, order = [], []
        letters = np.flatnonzero(whole)
        texts_ = [letters[k: k + JOINED] for k in range(0, len(letters), JOINED)]
        coded_ = self.tokenizer.encode_batch_fast([" ".join([new[i] for i in some]) for some in texts_], add_special_tokens=False)
        alone = [np.flatnonzero(~whole)]
        for some, e in zip(texts_, coded_):
            ids = np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(some) or last[-1] != len(ids) - 1:  # some letter is none to the tokenizer
                alone.append(some)
                continue
            size[some] = np.diff(last, prepend=-1)
            parts.append(ids)
            order.append(some)
        rest = np.concatenate(alone)
        ids, size[rest] = self._one_by_one([new[i] for i in rest])
        held = np.concatenate([*parts, ids])
        order = np.concatenate([*order, rest])
        begin = np.zeros(len(new), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return _gather(held, begin, size), size

    def __call__(self, names: list[str]) -> np.ndarray:
        """Place of each distinct word in ``begin`` and ``size``."""
        find = self.index.get
        at = np.fromiter((find(x, -1) for x in names), np.int64, len(names))
        new = [names[i] for i in np.flatnonzero(at < 0)]
        if len(self.index) + len(new) > self.most:
            met = np.flatnonzero(at >= 0)
            self.index = {names[i]: k for k, i in enumerate(met)}
            self.pool = _gather(self.pool, self.begin[at[met]], self.size[at[met]])
            self.size = self.size[at[met]]
            self.begin = np.cumsum(self.size) - self.size
            at[met] = np.arange(len(met))
        ids, size = self._encoded(new)
        at[at < 0] = len(self.size) + np.arange(len(new))
        self.index.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pool = np.concatenate((self.pool, ids))
        return at


@kept
def word_ids(path: str, most: int = REMEMBERED // 2) -> WordIds:
    return WordIds(path, most)


def text_ids(column: pa.Array, path: str, end: int, most: int = REMEMBERED // 2) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by ``end``; offsets per text); ``most`` words are remembered."""
    if drops_blanks(path):
        flat, at = words(column)
        codes, names = coded(flat)
        # A stop or comma between a letter and the word's end is a piece of its own.
        marked = pc.match_substring_regex(names, "[A-Za-z][.,]$")
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(names, -1, 1 << 30), "")
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(names, 0, -1), names)
        stems = pc.if_else(pc.match_substring(stems, "<|"), stems, pc.ascii_lower(stems))
        stem_codes, stems = coded(stems)
        mark_codes, marks = coded(marks)
        known = word_ids(path, most)
        # Looked up together, as a look-up may renumber what is remembered.
        both_codes, both = coded(pa.concat_arrays([stems, marks]))
        place = known(strings(both))[both_codes]
        whole, tail = place[: len(stems)][stem_codes], place[len(stems):][mark_codes]
        pool = _gather(known.pool, known.begin[parts := np.stack((whole, tail), axis=1).ravel()], known.size[parts])
        size = known.size[parts].reshape(-1, 2).sum(axis=1)
    else:
        names = strings(column)
        codes, at = np.arange(len(names)), np.arange(len(names) + 1)
        per = [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast(names, add_special_tokens=False)]
        pool = np.concatenate([*per, np.zeros(0, np.uint32)])
        size = np.fromiter(map(len, per), np.int64, len(per))
    pool = np.append(pool, np.uint32(end))
    size = np.append(size, 1)
    codes = np.insert(codes, at[1:], len(size) - 1)
    many = size[codes]
    total = np.concatenate(([0], np.cumsum(many)))
    return _gather(pool, (np.cumsum(size) - size)[codes], many), total[np.concatenate(([0], at[1:] + np.arange(1, len(at))))]


def token_pieces(docs: DataFrame, path: str, *, end: int, capacity: int = 4096, key: str = "doc_id", text: str = "text",
                 block: int = BLOCK) -> DataFrame:
    """(key, start, length, doc_tokens, ids) of every piece; ids are little-endian unsigned 32-bit numbers.

    The ids of a row are those of its whole text (null: empty) and ``end``; they
    are cut every ``capacity`` ids. A task encodes ``block`` bytes of text at a
    time and remembers as many words as a quarter of that, ``REMEMBERED`` / 2 at most.
    """
    most = min(REMEMBERED // 2, block // 4)
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in blocks(batches, "_text", block):
            ids, at = text_ids(texts(b, "_text"), path, end, most)
            n = np.diff(at)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, n[row] - start)
            raw = [ids[i: i + k].tobytes() for i, k in zip((at[row] + start).tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("_key").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]), pa.array(raw, pa.binary())],
                [key, "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        cut, f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, ids binary")


def _ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``pieces`` with _rank, their number among the pieces of their length from 0 on.

    A length is numbered in buckets of about the square root of all rows, so
    neither one bucket nor the list of a length's buckets gets long.
    """
    spark = pieces.sparkSession
    rows = max(64, math.isqrt(sum(histogram.values())) // 2)
    buckets = spark.createDataFrame([(n, -(-c // rows)) for n, c in histogram.items()], "length bigint, _buckets int")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn(
        "_bucket", F.pmod(F.xxhash64("_rid"), F.col("_buckets"))).drop("_buckets")
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = durable(counts.select("length", "_bucket", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before")))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_rid")) - 1
    return dealt.withColumn("_number", number).join(before, ["length", "_bucket"]).withColumn(
        "_rank", (F.col("_before") + F.col("_number")).cast("bigint")).drop("_bucket", "_number", "_before")


def packed(docs: DataFrame, path: str, *, end: int, capacity: int = 4096, key: str = "doc_id", text: str = "text",
           digest: dict[str, Callable[[Column], Column]] | None = None, with_ids: bool = True, block: int = BLOCK) -> DataFrame:
    """(key, start, length, doc_tokens, sequence_id, offset, ids) of every piece of every row of ``docs``.

    ``digest`` adds columns made of a piece's ids; ``with_ids=False`` leaves
    the ids themselves out, which saves a shuffle of them. Null and empty texts
    are one piece that holds ``end`` alone; rows that repeat a key have pieces
    each; an empty table has none. ``capacity`` is a power of two. ``block`` is
    the bytes of text a task encodes together, an eighth of a batch between Spark
    and Python: fewer need less memory.
    """
    digest = digest or {}
    made = token_pieces(docs, path, end=end, capacity=capacity, key=key, text=text, block=block)
    with arrow_batches(docs.sparkSession, f"{8 * block}b"):
        stored = durable(made.withColumn("_rid", F.monotonically_increasing_id()).withColumns(
            {n: f(F.col("ids")) for n, f in digest.items()}))
    histogram = {r.length: r.n for r in stored.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = Plan(histogram, capacity).table()
    keep = [c for c in stored.columns if c not in ("length", "ids")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            row, cut, some, sequence, offset = placed(table, length, rank)
            rows = b.select(keep).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, *map(pa.array, (cut, some, sequence, offset, some < length[row]))],
                [*keep, "_cut", "length", "sequence_id", "offset", "_part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name in keep)
    out = _ranked(stored.drop("ids"), histogram).mapInArrow(
        place, f"{schema}, _cut bigint, length bigint, sequence_id bigint, offset bigint, _part boolean")
    columns = [key, (F.col("start") + F.col("_cut")).alias("start"), "length", "doc_tokens", "sequence_id", "offset", *digest]
    ids = F.substring("ids", (F.col("_cut") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    raw = stored.select("_rid", "ids")
    if with_ids:
        return out.join(raw, "_rid").withColumn("ids", ids).withColumns(
            {n: f(F.col("ids")) for n, f in digest.items()}).select(*columns, "ids")
    if not any(isinstance(place, list) and len(place) > 1 for some in table.values() for *_, place in some):
        return out.select(*columns)
    out = durable(out)
    parts = durable(out.where("_part")).drop(*digest)
    wanted = parts.select("_rid").distinct()
    again = parts.join(raw.join(if_small(wanted), "_rid", "left_semi"), "_rid").withColumns({n: f(ids) for n, f in digest.items()})
    return out.where("NOT _part").select(*columns).union(again.select(*columns))
