"""Cases of the check failures of round 3."""

from collections import defaultdict
from itertools import product

from parcelgrid.llm import near_dedup as ND


def test_a_large_family_meets_what_is_apart_once_not_once_a_bucket(spark):
    large, apart = range(600), range(1000, 1010)
    rows = [(node, bucket) for bucket in range(20) for node in (*large, *apart[bucket % 2:])]
    # A bucket of its own, without the large family.
    rows += [(node, 99) for node in (2000, 2001, 2002)]
    family = [(node, 0) for node in large] + [(2000, 2000), (2001, 2000)]
    tasks = ND._sketch_tasks(spark.createDataFrame(rows, "node long, bucket long"), spark.createDataFrame(family, "node long, family long")).collect()
    # 5 blocks of the large family, each with what is apart; one set of them a bucket took 20 times as many.
    assert len(tasks) <= 700
    together = defaultdict(set)
    for t in tasks:
        together[t.bucket, t.i, t.j].add(t.node)
    met = {frozenset(p) for nodes in together.values() for p in product(nodes, nodes)}
    assert all(frozenset(p) in met for p in product(apart, (*large, *apart)))
    assert all(frozenset(p) in met for p in ((2002, 2000), (2002, 2001)))
