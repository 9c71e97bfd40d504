"""Sharding: minimax contiguous partition of ordered, atomic groups of equal texts.

Groups stand in the order of their texts' SHA-256. The smallest capacity that
lets the wanted number of shards take them in that order, each filled greedily,
is found by binary search, and the cuts of that filling are the result: a few
digests, so that a document finds its shard by comparing its own with them.

The search never sees single groups where it need not. It starts from the bytes
per first digits of the digest, bounds the capacity from both sides (cuts only
between blocks, cuts anywhere inside them) and splits further, by two digits,
only the blocks in which a cut may still lie. When these hold one group each
the bounds have met. What reaches the driver grows with the square of the
number of shards and not with the corpus.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window, functions as F

from parcelgrid.llm.common import if_small
from parcelgrid.session import durable

#: Hexadecimal digits of the first blocks, and those a block is split by.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Rows aimed at in one window of slots, and rows beyond which such a window is cut by place in the input.
WINDOW_ROWS, LARGE_WINDOW = 1024, 1 << 18


class Blocks:
    """Blocks of consecutive groups: prefix of the digests, bytes, first and last digest."""

    def __init__(self, rows: list[tuple[str, int, str, str]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.total = self.ends[-1] if rows else 0

    def single(self, i: int) -> bool:
        return self.rows[i][2] == self.rows[i][3]

    def start(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def filled(self, capacity: int, shards: int, inside: bool) -> list[int]:
        """Bytes in front of the first cuts; the last one is the total where the capacity suffices.

        With ``inside`` a block of several groups may be cut at any byte, which
        reaches at least as far as the true filling; without, only at its ends.
        """
        at, cuts = 0, []
        while len(cuts) < shards and at < self.total:
            goal = at + capacity
            i = bisect_right(self.ends, goal)  # the block that holds byte ``goal``
            if goal >= self.total:
                to = self.total
            elif inside and not self.single(i):
                to = goal
            else:
                to = self.start(i)
            if to <= at:
                break
            cuts.append(to)
            at = to
        return cuts

    def smallest(self, shards: int, inside: bool) -> int:
        """Binary search of the smallest capacity that suffices."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.filled(mid, shards, inside)[-1:] == [self.total]:
                high = mid
            else:
                low = mid + 1
        return low

    def unsettled(self, shards: int) -> list[str]:
        """Prefixes of the blocks of several groups in which a cut may lie."""
        least, most = self.smallest(shards, True), self.smallest(shards, False)
        near, far = self.filled(least, shards, False), self.filled(most, shards, True)
        found = set()
        for k in range(shards - 1):
            # Where the cuts between blocks come to a stop, the block that stops them decides.
            a = near[k] if k < len(near) else near[-1] if near else 0
            b = far[k] if k < len(far) else self.total
            stopped = k >= len(near) and a < self.total
            i = bisect_right(self.ends, a)
            while i < len(self.rows) and (self.start(i) < b or stopped):
                if not self.single(i):
                    found.add(self.rows[i][0])
                i += 1
                if stopped:
                    break
            if stopped:
                break
        return sorted(found)


def _blocks(rows: DataFrame, digits: int) -> list[tuple[str, int, str, str]]:
    prefix = F.substring("digest", 1, digits).alias("prefix")
    return [tuple(r) for r in rows.groupBy(prefix).agg(F.sum("size"), F.min("digest"), F.max("digest")).collect()]


def minimax_cuts(rows: DataFrame, shards: int) -> list[str]:
    """First digest of each shard but the first, of ``rows`` (digest, size); fewer where fewer shards are filled."""
    blocks = Blocks(_blocks(rows, FIRST_DIGITS))
    while blocks.total:
        split = blocks.unsettled(shards)
        if not split:
            break
        parts = [r for r in blocks.rows if r[0] not in set(split)]
        for digits in sorted({len(p) for p in split}):
            inside = rows.where(F.substring("digest", 1, digits).isin([p for p in split if len(p) == digits]))
            parts += _blocks(inside, digits + MORE_DIGITS)
        blocks = Blocks(parts)
    if not blocks.total:
        return []
    cuts = blocks.filled(blocks.smallest(shards, False), shards, False)
    return [blocks.rows[bisect_right(blocks.ends, c)][2] for c in cuts if c < blocks.total]


def own_shards(rows: DataFrame, shards: int, total: int) -> list[tuple[str, int]]:
    """(digest, bytes) of groups above the fair share of what larger groups leave: at most ``shards`` of them."""
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    found, left = [], total
    for digest, size in groups.orderBy(F.desc("size"), "digest").limit(shards - 1).collect():
        if size * (shards - len(found)) <= left:
            break
        found.append((digest, size))
        left -= size
    return found


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs`` (doc_id bigint, text string).

    ``size`` is the text's UTF-8 bytes plus one, a null text counts as empty.
    The law is ``bytes``: shards hold nearly equal sizes, as far as rows of
    equal text, which stay together, allow. A group of more than the fair
    share of what is left takes a shard of its own, the largest first (equal
    ones in the order of their digests); the other groups go to the other
    shards by minimax contiguous partition. Shards stay empty where there are
    fewer groups than shards. ``slot`` counts a shard's rows from 0 in the
    order of the MD5 of doc_id (null as empty), then doc_id (null first), then
    digest; rows equal in all of these in any order. An empty table gives no
    rows; other columns are not looked at.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce("text", F.lit(""))
    rows = durable(docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("digest"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("mark"),
        F.shiftright(F.monotonically_increasing_id(), 33).alias("_part")))
    own = own_shards(rows, shards, rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    rest = rows.where(~F.col("digest").isin([d for d, _ in own])) if own else rows
    cuts = minimax_cuts(rest, shards - len(own))
    shard = F.lit(len(own))
    for cut in cuts:
        shard = shard + (F.col("digest") >= cut).cast("int")
    for k, (digest, _) in reversed(list(enumerate(own))):
        shard = F.when(F.col("digest") == digest, k).otherwise(shard)
    return slotted(rows.withColumn("shard", shard.cast("int"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def slotted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard; windows hold a few rows each, whatever a shard holds.

    A shard's rows are cut by the first digits of ``mark``; so many rows of one
    doc_id that these cannot part them are cut by ``_part``, their place in the input.
    """
    most = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    digits = 0
    while most > WINDOW_ROWS * 16 ** digits:
        digits += 1
    key = ["shard", "head"]
    rows = rows.withColumn("head", F.substring("mark", 1, digits))
    large = durable(rows.groupBy(*key).count().where(F.col("count") > LARGE_WINDOW).select(*key))
    parted = rows.join(if_small(large.withColumn("_large", F.lit(True))), key, "left").withColumn(
        "_cut", F.when(F.col("_large"), F.col("_part")).otherwise(F.lit(0)))
    key.append("_cut")
    counts = durable(parted.groupBy(*key).count())
    before = Window.partitionBy("shard").orderBy("head", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    first = durable(counts.select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first")))
    inside = Window.partitionBy(*key).orderBy("mark", F.asc_nulls_first("doc_id"), "digest")
    return parted.join(if_small(first), key).withColumn("slot", (F.col("_first") + F.row_number().over(inside) - 1).cast("long"))
