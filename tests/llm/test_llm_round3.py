"""Sharding, divergence audit and phrase mining against brute force on small tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelgrid.llm import divergence, html_text, phrases, shards, site_quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot int, size string, n int, phrase int, value int, term int, digest int, mark int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = ["Ab", "ab", "CÄ", "d", "x1y", "ü", "中文", "zz", "\x1c", "e,f", "g.", "h\th", "ß;", "the", "of", "the of"]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "s", 3, 4, 5, 6, 7, 8) for r in rows], DOCS).repartition(parts)


def rows_of(seed, n, langs=("en", "de", None), sources=("a", "b", "c", None)):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = " ".join(rng.choice(VOCABULARY, rng.integers(0, 40)))
        out.append((i, words, langs[rng.integers(len(langs))], sources[rng.integers(len(sources))]))
    return out


MIXED = rows_of(1, 160) + [(3, "the of the", "en", "a"), (3, "the of the", "en", "a"), (None, None, None, None), (None, "", "fr", "q"),
                           (7, "the of " * 3000, "en", "b"), (8, "\n \n", "es", "a"), (9, "ab " * 12, "es", "z")]


# --- sharding

def capacity(sizes, n):
    """Smallest capacity by dynamic programming over every cut."""
    ends = [0, *itertools.accumulate(sizes)]
    best = ends
    for _ in range(n - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


def shards_by_hand(rows, n):
    sizes = Counter()
    for _, t, *_ in rows:
        sizes[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    left, home = sum(sizes.values()), {}
    for d in sorted(sizes, key=lambda d: (-sizes[d], d))[: n - 1]:
        if sizes[d] * (n - len(home)) <= left:
            break
        home[d] = len(home)
        left -= sizes[d]
    rest = sorted(d for d in sizes if d not in home)
    c = capacity([sizes[d] for d in rest], n - len(home))
    shard, held = len(home), 0
    for d in rest:
        if held + sizes[d] > c:
            shard, held = shard + 1, 0
        held += sizes[d]
        home[d] = shard
    return home


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards_equal_dynamic_programming(spark, n, monkeypatch):
    # Short prefixes, so that the search has to split blocks more than once.
    monkeypatch.setattr(shards, "FIRST_DIGITS", 1)
    monkeypatch.setattr(shards, "MORE_DIGITS", 1)
    got = shards.sharded(table(spark, MIXED), n).collect()
    home = shards_by_hand(MIXED, n)
    assert len(got) == len(MIXED)
    of = defaultdict(set)
    for _, t, *_ in MIXED:
        of[zlib.crc32((t or "").encode())].add(home[hashlib.sha256((t or "").encode()).hexdigest()])
    slots = defaultdict(list)
    for r in got:
        assert {r.shard} == of[r.text_crc32] and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t, *_ in MIXED)


def test_a_third_of_the_rows_in_one_group_and_one_id(spark, monkeypatch):
    monkeypatch.setattr(shards, "LARGE_WINDOW", 50)
    monkeypatch.setattr(shards, "WINDOW_ROWS", 8)
    rows = [(5, "copy", "en", "a")] * 400 + [(i, f"text {i}", "en", "a") for i in range(800)]
    got = shards.sharded(table(spark, rows, 7), 4).collect()
    home = shards_by_hand(rows, 4)
    for t in ("copy", "text 0", "text 799"):
        assert {r.shard for r in got if r.text_crc32 == zlib.crc32(t.encode())} == {home[hashlib.sha256(t.encode()).hexdigest()]}
    for s, members in itertools.groupby(sorted(got, key=lambda r: r.shard), key=lambda r: r.shard):
        assert sorted(r.slot for r in members) == list(range(sum(r.shard == s for r in got)))


def test_blocks_find_the_same_capacity_as_single_groups():
    rng = np.random.default_rng(4)
    for trial in range(60):
        count, n = int(rng.integers(1, 120)), int(rng.integers(1, 9))
        groups = [(f"{i:04d}", int(s)) for i, s in enumerate(rng.integers(1, 200, count) ** (1 + trial % 2))]
        width = 2
        gather = lambda d, among: [(p, sum(s for _, s in g), g[0][0], g[-1][0]) for p, g in (
            (p, list(g)) for p, g in itertools.groupby(among, key=lambda x: x[0][:d]))]
        blocks = shards.Blocks(gather(width, groups))
        while split := blocks.unsettled(n):
            kept = [r for r in blocks.rows if r[0] not in split]
            for p in split:
                kept += gather(len(p) + 1, [g for g in groups if g[0].startswith(p)])
            blocks = shards.Blocks(kept)
        assert blocks.smallest(n, False) == blocks.smallest(n, True) == capacity([s for _, s in groups], n)


def test_shards_of_nothing(spark):
    assert shards.sharded(table(spark, MIXED).where("false")).collect() == []
    with pytest.raises(ValueError):
        shards.sharded(table(spark, MIXED), 0)


# --- divergence

def audit_by_hand(rows, least_docs, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        groups.add((lang, source))
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least_docs]
        total = {g: sum(counts[g][t] for t in kept) + 2 * len(kept) for g in groups if g[0] == lang}
        share = lambda c, n: 1 + 10**9 * (c + 2) // n
        mine = {t: share(counts[lang, source][t], total[lang, source]) for t in kept}
        found = {"pair": [], "term": []}
        for g in total:
            if g[1] != source:
                found["pair"].append((-sum(f(mine[t], share(counts[g][t], total[g])) for t in kept), g[1]))
        all_ = {t: sum(counts[g][t] for g in total) for t in kept}
        for t in kept:
            q = share(all_[t], sum(all_.values()) + 2 * len(kept))
            if counts[lang, source][t] and mine[t] > q:
                found["term"].append((-f(mine[t], q), t))
        for part, items in found.items():
            items = sorted(items, key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, t, -v, k) for k, (v, t) in enumerate(items[: top if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(10, 10), (3, 2), (10**6, 10)])
def test_audit_equals_brute_force(spark, least, top):
    got = divergence.audited(table(spark, MIXED), least_docs=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit_by_hand(MIXED, least, top)


def test_ties_in_cells_are_expanded_in_byte_order(spark):
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)] + ["é", "中", "z"]
    rows = [(i, " ".join(words) if i < 12 else "other", "en", "a" if i < 12 else "b") for i in range(24)]
    got = divergence.audited(table(spark, rows))
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, 10, 10)


def test_audit_of_nothing(spark):
    assert divergence.audited(table(spark, MIXED).where("false")).collect() == []


# --- phrases

def phrases_by_hand(rows, longest, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang, _ in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i: i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        good = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in good.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (4, 3, 7), (2, 2, 50)])
def test_phrases_equal_brute_force(spark, longest, least, top, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 900)
    got = phrases.collocations(table(spark, MIXED), longest=longest, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(MIXED, longest, least, top)


def test_collisions_in_the_bitmap_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 15)
    monkeypatch.setattr(phrases, "MOST_BITS", 15)
    monkeypatch.setattr(phrases.Relation, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    got = phrases.collocations(table(spark, MIXED))
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(MIXED, 3, 10, 2000)


def test_scores_beyond_64_bits(spark):
    big = 10**13
    phrase = spark.createDataFrame([(big,)], "a bigint").select(
        F.call_function("div", F.col("a").cast("decimal(19,0)") * F.col("a").cast("decimal(19,0)") * F.lit(1_000_000).cast("decimal(7,0)"),
                        F.col("a").cast("decimal(19,0)") * (F.col("a") + 1).cast("decimal(19,0)")).alias("score"))
    assert phrase.first().score == 10**6 * big * big // (big * (big + 1))


def test_phrases_of_nothing(spark):
    for rows in (table(spark, MIXED).where("false"), table(spark, [(1, None, None, None), (2, " . ", "en", "a")])):
        assert phrases.collocations(rows).collect() == []


# --- pages without, or with little, markup of their own

BODY = "Sentence one of the story, long enough to count. Sentence two goes on about it. Sentence three ends it."
MORE = "Readers say a lot here, and then some more, and more. " * 40
NAV = "<ul class=menu><li><a href=/>home</a><li><a href=/x>more pages</a></ul>"


@pytest.mark.parametrize("page,want", [
    (f"<body>{NAV}<div class=wrap><h1>Title</h1><p class=lead>The lead.</p><div class=entry-content><p>{BODY}</p></div></div>", f"Title The lead. {BODY}"),
    (f"<body><article><p>{BODY}</p></article><div class=commentlist><p>{MORE}</p></div>", BODY),
    (f"<body><main><p>{BODY}</p></main><p>{MORE}</p>", BODY),
    (f"<body><div class=post><h2>Title</h2><div class=post-body><p>{BODY}</p></div><div class=commentarea>{MORE}</div></div>", f"Title {BODY}"),
    (f"<body><div id=logo><h1>Site</h1></div><div class=content><p>{BODY}</p></div>", BODY),
    (f"<body><h1>Title</h1><div class=content><p>{BODY}</p></div><div class=sharebar>share this</div>", f"Title {BODY}"),
    (f"<body><div><div class=head><h1>Title</h1></div><div class=story-text><p>{BODY}</p></div></div>", f"Title {BODY}"),
    (f"<body><div class=commentary><p>{BODY}</p></div>", BODY),
    (f"<body><article><header><h1>Title</h1></header><p>{BODY}</p></article><aside>{MORE}</aside>", f"Title {BODY}"),
    (f"<body><section><h1>Title</h1><p>{BODY}</p></section><div class=footerlinks>a b c</div>", f"Title {BODY}"),
    (f"<body><p>{BODY}</p><div class=cookiebanner>We use cookies</div>", BODY),
    (f"<table><tr><td class=menubar><a href=/>home</a><td><h1>Title</h1><p>{BODY}</p></table>", f"Title {BODY}"),
    (f"<body><div class=page><h1>Title</h1><nav>home</nav><div class=article-body><p>{BODY}</p></div></div>", f"Title {BODY}"),
    (f"<body><div class=related-posts>{MORE}</div><div class=article-body><p>{BODY}</p></div>", BODY),
    (f"<body><div class=newsletterbox>{MORE}</div><div><h1>Title</h1><p>{BODY}</p></div>", f"Title {BODY}"),
])
def test_page_shapes(page, want):
    assert html_text.page_text(page, None) == want


# --- quality of sites

def site_rows():
    good = [(i, "the quick story of a long day told in plain words " * (1 + i % 4), f"h{i % 4}", "p" if i % 2 else None, "q", 1, 1) for i in range(60)]
    bad = [(100 + i, "BUY!! $$$ now " * (5 + i), "h3", "q", None, 2, 2) for i in range(30)]
    return [*good, *bad, (500, "lone page of its own", "solo", "x", "z", 3, 3), (501, None, None, None, None, None, None)]


def site_table(spark):
    return spark.createDataFrame(site_rows(), "doc_id bigint, text string, label string, n string, quality string, good int, _own int")


def test_priors_equal_plain_sums_without_the_row(spark):
    docs = site_table(spark)
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(0, 60, 3), *range(100, 130, 2), 9999]], "doc_id bigint, quality int")
    got = site_quality.classified(docs, labels, host="label", path="n").collect()
    x, y = site_quality.sample(docs, labels)
    base = site_quality.fitted(x, y)[1]
    known = {r.doc_id: r.quality for r in labels.collect()}
    own = {r.doc_id: known.get(r.doc_id, 1 / (1 + np.exp(-(r.log_odds + np.log(base / (1 - base)))))) for r in got}
    rows, total = len(got), sum(own.values())
    rate = (total + 1) / (rows + 2)

    def weight(groups, centre):
        some = [(n, g, centre(k)) for k, (n, g) in groups.items() if n > 1]
        ss, noise, n = (sum(n * (g / n - c) ** 2 for n, g, c in some), sum(c * (1 - c) for _, _, c in some), sum(n for n, *_ in some))
        return min(1e4, max(1.0, rate * (1 - rate) / max((ss - noise) / n, 1e-4)))

    hosts, paths = defaultdict(lambda: (0, 0.0)), defaultdict(lambda: (0, 0.0))
    for r in got:
        for groups, k in ((hosts, r.label), (paths, (r.label, r.n))):
            groups[k] = (groups[k][0] + 1, groups[k][1] + own[r.doc_id])
    k_host = weight(hosts, lambda k: rate)
    of = {h: (g + k_host * rate) / (n + k_host) for h, (n, g) in hosts.items()}
    k_path = weight(paths, lambda k: of[k[0]])
    for r in got:
        o, (hn, hg), (n, g) = own[r.doc_id], hosts[r.label], paths[r.label, r.n]
        host = (hg - o + k_host * (total - o + 1) / (rows + 1)) / (hn - 1 + k_host)
        prior = min(0.999, max(0.001, (g - o + k_path * host) / (n - 1 + k_path)))
        assert r.quality_score == pytest.approx(1 / (1 + np.exp(-(r.log_odds + np.log(prior / (1 - prior))))), abs=2e-5)
        assert r.host_rate == pytest.approx(of[r.label], abs=2e-5)


def test_the_label_of_a_lone_page_does_not_move_its_prior(spark, monkeypatch):
    docs = site_table(spark)
    model = site_quality.fitted(*site_quality.sample(docs, spark.createDataFrame([(0, 1), (100, 0)], "doc_id bigint, quality int")))
    monkeypatch.setattr(site_quality, "fitted", lambda *a: model)
    monkeypatch.setattr(site_quality, "sample", lambda *a: ())
    scores = []
    for q in (0, 1):
        labels = spark.createDataFrame([(0, 1), (100, 0), (500, q)], "doc_id bigint, quality int")
        scores.append(next(r.quality_score for r in site_quality.classified(docs, labels, host="label", path="n").collect() if r.doc_id == 500))
    assert abs(scores[0] - scores[1]) < 0.02  # what is left comes through the prior weights
