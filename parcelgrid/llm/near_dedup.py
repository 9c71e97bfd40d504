"""MinHash near-dedup with min-max hashing.

Every permutation of a text's shingles gives two components, its smallest and
its largest value, so half the hash evaluations fill a signature. Bands of six
components propose families of like texts: members of a bucket meet two
centres, and what these do not settle meets new ones. Inside a family, texts are dealt
into blocks of bounded size and compared exactly on their full sets: first
each block with itself and a few pivots, then only what is not yet connected.
A large family of near copies is settled by its pivots in the first step.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.llm.arrow import blocks, forget, give_back, texts
from parcelgrid.llm.common import both_ways, if_small
from parcelgrid.llm.shingles import mixed, shingle_sets
from parcelgrid.operators.graph import components
from parcelgrid.session import durable, release

BAND_ROWS = 6
#: Chance that a pair just at the threshold shares no band.
MISS = 1e-9
#: Pairs whose signatures agree in less than the threshold minus this (ten standard errors) join no families.
FAMILY_SLACK = 0.25
#: A pair's signatures that agree in this much settle it: signatures of what is linked with one of the two agree with it in the
#: threshold less six standard errors (0.15) or more, so with the other in the threshold less ``FAMILY_SLACK`` or more.
SETTLED = 1 - FAMILY_SLACK + 0.15
#: Sketches of a block, where every pair of a bucket is looked at.
SKETCHES = 256
#: Bytes of text a task signs together; what it holds beside the executor follows from that.
BLOCK = 1 << 18
BLOCK_TEXTS, BLOCK_SHINGLES, PIVOTS = 96, 400_000, 8
_VOCABULARY = 1 << 14


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** BAND_ROWS)))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(flat: np.ndarray, starts: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """(sets, 2 * permutations): smallest and largest value of each non-empty set under each permutation."""
    out = np.empty((len(starts), 2 * len(multipliers)), np.uint64)
    for p, m in enumerate(multipliers):
        y = flat * m
        out[:, 2 * p] = np.minimum.reduceat(y, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(y, starts)
    return out


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, bands, sketch) of every row; the last three are null for a text without words.

    digest: 128 bits of the whole set; bands: one number per band; sketch: one
    byte per component. ``docs`` has doc_id and text.
    """
    n_bands = bands_for(percent)
    multipliers = _multipliers(n_bands * BAND_ROWS // 2)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in blocks(batches, limit=BLOCK):
            flat, at = shingle_sets(texts(b), size)
            counts = np.diff(at)
            full = np.flatnonzero(counts)
            parts = min_max(flat, at[:-1][full], multipliers) if len(full) else np.empty((0, 2 * len(multipliers)), np.uint64)
            sketch = (mixed(parts) & np.uint64(255)).astype(np.uint8)
            key = np.zeros((len(full), n_bands), np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64)
            by_band = parts.reshape(len(full), n_bands, BAND_ROWS)
            for k in range(BAND_ROWS):
                key = mixed(key + by_band[:, :, k])
            digest, bands, sketches = ([None] * len(counts) for _ in range(3))
            for i, row in zip(full.tolist(), range(len(full))):
                digest[i] = xxhash.xxh3_128_digest(flat[at[i]: at[i + 1]].tobytes())
                bands[i] = key[row].view(np.int64)
                sketches[i] = sketch[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(counts), pa.array(digest, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n", "digest", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id bigint, n bigint, digest binary, bands array<bigint>, sketch binary")


def _tied(rows: DataFrame, sketches: DataFrame, least: float, order: Column) -> tuple[DataFrame, DataFrame]:
    """((a, b) of like nodes and centres, rows still open): ``rows``, with node and bucket, against two centres a bucket.

    The centres of a bucket are its first and last node by node XOR ``order``.
    The same order in all buckets gives a large family few centres, so few pairs.
    A node leaves its bucket as a centre or where it agrees with one in
    ``SETTLED`` or more: what is linked with it is then alike that centre as
    well. All others stay open, tied or not.
    """
    mark = F.col("node").bitwiseXOR(order)
    ends = [F.col(c).bitwiseXOR(order).alias(c) for c in ("lo", "hi")]
    met = durable(rows.groupBy("bucket").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"), F.count(F.lit(1)).alias("size")).where(
        "lo <> hi").select("bucket", *ends, "size"))
    pairs = durable(rows.join(met, "bucket").select("node", F.explode(F.array("lo", "hi")).alias("centre")).where(
        "node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct())

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                        for c in ("sa", "sb"))
                same = (x == y).mean(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("a"), b.column("b"), pa.array(same >= SETTLED)], ["a", "b", "settled"]).filter(pa.array(same >= least))

    one = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    like = durable(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(agree, "a bigint, b bigint, settled boolean"))
    # In buckets of three every pair has been looked at.
    open_ = rows.join(met.where("size > 3"), "bucket").where("node <> lo AND node <> hi")
    for c in ("lo", "hi"):
        open_ = open_.join(like.where("settled").select(F.col("a").alias("node"), F.col("b").alias(c)), ["node", c], "left_anti")
    return like.select("a", "b"), open_.select(*rows.columns)


def _order(turn: int) -> Column:
    """Another order of nodes for each turn, the same in all buckets."""
    return F.lit(int(mixed(np.array([turn + 1], np.uint64)).view(np.int64)[0]))


def _by_size(rows: DataFrame, percent: int) -> DataFrame:
    """(node, bucket): buckets of ``rows``, (node, n, bucket), cut by size of set: each node in its own and the next class, so that linked nodes still meet."""
    # A little more than the largest ratio of linked sets, against rounding.
    ratio = max(-math.log(percent / 100), 1e-3) * (1 + 1e-6)
    size_class = F.floor(F.log("n") / F.lit(ratio))
    return rows.select("node", F.explode(F.array(*(F.xxhash64("bucket", size_class + k) for k in (0, 1)))).alias("bucket"))


def _sketch_tasks(rows: DataFrame, family: DataFrame) -> DataFrame:
    """(bucket, i, j, node): every two nodes of a bucket of ``rows`` and of two families share a task.

    Pairs within a bucket's largest family are connected already, so only what
    is not of it is held against all blocks. A large family is the largest in
    up to two buckets a band, with much the same nodes in all: where that takes
    fewer rows, all buckets of a family are one.
    """
    of = durable(rows.join(family, "node", "left").select("bucket", "node", F.coalesce("family", "node").alias("family")))
    counts = of.groupBy("bucket", "family").agg(F.count(F.lit(1)).alias("size"))
    main = counts.groupBy("bucket").agg(
        F.max_by("family", F.struct("size", "family")).alias("main"), F.sum("size").alias("n"), F.max("size").alias("most")).where("n > most")
    blocks_of = lambda n: F.ceil(n / (SKETCHES // 2)).cast("int")

    def sized(groups: DataFrame, n: Column, rest: Column, *keys: str) -> DataFrame:
        return groups.select(*keys, blocks_of(n).alias("n_blocks"), blocks_of(rest).alias("n_rest"),
                             (n * blocks_of(rest) + rest * blocks_of(n)).alias("cost"))

    each = durable(sized(main, F.col("n"), F.col("n") - F.col("most"), "bucket", "main"))
    held = of.join(each.select("bucket", "main"), "bucket")
    once = durable(held.select(F.col("main").alias("bucket"), "main", "node", "family").distinct())
    whole = sized(once.groupBy("bucket", "main").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("family") != F.col("main")).alias("rest")),
                  F.col("n"), F.col("rest"), "bucket", "main")
    parts = each.groupBy("main").agg(F.sum("cost").alias("cost_parts"))
    whole = durable(whole.join(parts, "main").where("cost < cost_parts").drop("cost_parts"))
    sizes = each.join(whole.select("main"), "main", "left_anti").select("bucket", "n_blocks", "n_rest")
    placed = held.select(*once.columns).join(sizes, "bucket").unionByName(
        once.join(whole.select("bucket", "n_blocks", "n_rest"), "bucket")).withColumn(
            "i", F.pmod(F.xxhash64("node", F.lit(2)), "n_blocks").cast("int")).withColumn(
                "j", F.pmod(F.xxhash64("node", F.lit(1)), "n_rest").cast("int"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = placed.select("bucket", "node", "i", span("n_rest").alias("j"))
    rest = placed.where("family <> main").select("bucket", "node", span("n_blocks").alias("i"), "j")
    return every.union(rest).distinct().select("bucket", "i", "j", "node")


def _compared_sketches(rows: DataFrame, family: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(src, dst): links that connect what is alike in each bucket of ``rows``, looking at every pair of two families, block by block."""
    def compare(task: pa.Table) -> pa.Table:
        node = task.column("node").to_numpy()
        sketch = np.frombuffer(b"".join(task.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
        first = node[_parts(np.stack([(sketch == row).mean(axis=1) >= least for row in sketch]))]
        other = first != node
        return pa.table({"src": pa.array(node[other], pa.int64()), "dst": pa.array(first[other], pa.int64())})

    return _sketch_tasks(rows, family).join(sketches, "node").select("bucket", "i", "j", "node", "sketch").groupBy("bucket", "i", "j").applyInArrow(
        compare, "src bigint, dst bigint")


def _families(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, family) of nodes with a like node: parts of a graph in which nodes that may be linked are connected.

    Nodes meet two centres in each bucket first. What no centre settles goes on
    in buckets cut by size, as long as new centres settle half of it; every
    pair of the rest is looked at.
    """
    least = percent / 100 - FAMILY_SLACK
    sketches = nodes.select("node", "sketch")
    edges, rest = _tied(nodes.select("node", "n", F.explode("bands").alias("bucket")), sketches, least, _order(0))
    # A node's centres are tied to the smallest of them, and it alone to the node: members of a family share their centres.
    least_centre = durable(edges.groupBy("a").agg(F.min("b").alias("low")))
    ties = edges.join(least_centre, "a").where("b <> low").select("b", "low").distinct()
    links = durable(least_centre.union(ties))
    rest = durable(_by_size(rest, percent))
    found = durable(components(both_ways(links, "a", "low")))
    family = found.select(F.col("pnu").alias("node"), F.col("component").alias("family"))
    # Buckets whose nodes are all of one family have nothing left to connect.
    of = rest.join(family, "node", "left").select("bucket", F.coalesce("family", "node").alias("family"))
    mixed = of.groupBy("bucket").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi")
    rest = durable(rest.join(mixed, "bucket", "left_semi"))
    left, before, more = rest.count(), None, []
    while left and (before is None or 2 * left <= before):
        tied, rest = _tied(rest, sketches, least, _order(len(more) + 1))
        more.append(tied)
        rest = durable(rest)
        left, before = rest.count(), left
    if left:
        more.append(_compared_sketches(rest, family, sketches, least).toDF("a", "b"))
    for new in more:
        # Families stand for their nodes.
        for c in ("a", "b"):
            new = new.join(family.toDF(c, f"f{c}"), c, "left").withColumn(c, F.coalesce(f"f{c}", c)).drop(f"f{c}")
        links = links.union(new.where("a <> b").select("a", "b").distinct())
    if more:
        found = durable(components(both_ways(durable(links), "a", "low")))
    return found.select(F.col("pnu").alias("node"), F.col("component").alias("family"))


def _sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(node, digest, shingles): full sets of the members, as sorted 64-bit numbers."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=BLOCK):
            flat, at = shingle_sets(texts(b), size)
            sets = [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())],
                ["node", "digest", "shingles"])

    ids = members.select(F.col("node").alias("doc_id"))
    return docs.select("doc_id", "text").join(if_small(ids), "doc_id").mapInArrow(
        build, "node bigint, digest binary, shingles binary")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of pairs with 100 * intersection >= percent * union, counted on the full sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, word, met = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((len(sets), len(sets)))
    shared = met[word] > 1
    row, word = row[shared], (np.cumsum(met > 1) - 1)[word[shared]]
    order = np.argsort(word, kind="stable")
    row, word = row[order], word[order]
    for at in range(0, int(word[-1]) + 1 if len(word) else 0, _VOCABULARY):
        i, j = np.searchsorted(word, (at, at + _VOCABULARY))
        m = np.zeros((len(sets), _VOCABULARY), np.float32)
        m[row[i:j], word[i:j] - at] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    return (100 * both >= percent * union) & (sizes[:, None] > 0)


def _parts(mask: np.ndarray) -> np.ndarray:
    """Smallest index each index is connected to."""
    label = np.arange(len(mask))
    while True:
        low = np.where(mask, label[None, :], len(mask)).min(axis=1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compared(tasks: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(src, dst): links that connect what is linked inside each task."""
    def compare(task: pa.Table) -> pa.Table:
        node = task.column("node").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in task.column("shingles").to_pylist()]
        first = node[_parts(linked(sets, percent))]
        other = first != node
        del sets
        give_back()
        return pa.table({"src": pa.array(node[other], pa.int64()), "dst": pa.array(first[other], pa.int64())})

    return tasks.select(*keys, "node", "shingles").groupBy(*keys).applyInArrow(compare, "src bigint, dst bigint")


def _links(members: DataFrame, percent: int) -> DataFrame:
    """(src, dst) links that connect exactly what is linked; ``members``: (node, family, n, shingles)."""
    h = F.xxhash64("node")
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = durable(members.groupBy("family").agg(need.cast("int").alias("n_blocks")))
    placed = members.join(sizes, "family").withColumn("block", F.pmod(h, "n_blocks").cast("int"))
    wide = sizes.where("n_blocks > 1")
    pivot = durable(members.join(wide, "family", "left_semi").groupBy("family", F.pmod(h, F.lit(PIVOTS))).agg(
        F.min("node").alias("node")).select("family", "node"))
    beside = members.join(pivot, ["family", "node"]).join(wide, "family").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    columns = ["family", "block", "node", "shingles"]
    near = durable(_compared(placed.select(columns).union(beside.select(columns)), ["family", "block"], percent))

    # What is still apart in families of several blocks is compared with every block.
    part = durable(components(both_ways(near, "src", "dst")))
    apart = members.join(wide, "family").join(part.withColumnRenamed("pnu", "node"), "node", "left").withColumn(
        "part", F.coalesce("component", "node"))
    held = durable(apart.select("family", "node", "part", "n", "n_blocks", F.pmod(h, "n_blocks").cast("int").alias("block")))
    counts = durable(held.groupBy("family", "part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")))
    main = durable(counts.groupBy("family").agg(
        F.max_by("part", F.struct("size", "part")).alias("main"), F.sum("size").alias("size"), F.max("size").alias("most"),
        F.sum("n").alias("n"), F.max_by("n", F.struct("size", "part")).alias("main_n")).where("size > most").select(
            "family", "main", F.greatest(F.ceil((F.col("size") - F.col("most")) / BLOCK_TEXTS),
                                         F.ceil((F.col("n") - F.col("main_n")) / BLOCK_SHINGLES)).cast("int").alias("n_rest")))
    open_ = held.join(main, "family")
    span = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    every = open_.select("family", "node", "block", span(F.col("n_rest")).alias("rest"))
    rest = open_.where("part <> main").select(
        "family", "node", span(F.col("n_blocks")).alias("block"), F.pmod(F.xxhash64("node", F.lit(1)), "n_rest").cast("int").alias("rest"))
    tasks = durable(every.unionByName(rest).distinct())
    far = durable(_compared(tasks.join(members.select("node", "shingles"), "node"), ["family", "block", "rest"], percent))
    return near.union(far)


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id bigint, text string).

    Sets hold the distinct shingles of ``size`` words, A-Z in lower case; texts
    with fewer words have their whole sequence as the only one, and null, empty
    or blank texts have an empty set that is linked with nothing. Texts are
    linked when 100 * intersection >= ``percent`` * union; the component is the
    smallest doc_id that can be reached. Equal sets are one node of the graph.
    Rows that repeat a doc_id are one node too, whatever their texts; a row
    whose doc_id is null has no component and is kept. Other columns of
    ``docs`` are not looked at.
    """
    signed = durable(signatures(docs, size, percent))
    classes = signed.where("n > 0 AND doc_id IS NOT NULL")
    nodes = durable(classes.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.max("doc_id").alias("_last"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    family = _families(nodes, percent)
    sets = _sets(docs, family, size)
    known = nodes.select("digest", "node", "n").join(family, "node")
    members = durable(sets.dropDuplicates(["node", "digest"]).join(known, ["node", "digest"]).select(
        "node", "family", "n", "shingles"))
    found = components(both_ways(_links(members, percent), "src", "dst"))
    root = durable(nodes.select("digest", "node", "_last").join(found.withColumnRenamed("pnu", "node"), "node", "left").select(
        "digest", F.coalesce("component", "node").alias("_root"), (F.col("_last") != F.col("node")).alias("_copies")
    ).where("_copies OR _root <> node").select("digest", "_root"))
    release(members)
    out = signed.select("doc_id", "n", "digest").join(root, "digest", "left")
    component = F.coalesce("_root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    gone = durable(near_duplicates(docs, size=size, percent=percent).where("NOT kept").select("doc_id").distinct())
    return docs.join(if_small(gone), "doc_id", "left_anti").select(*docs.columns)
