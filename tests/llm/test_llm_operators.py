"""The text operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from parcelgrid.llm import chat, exact_dedup, html_text, language, mixing, near_dedup, packing, repetition, site_quality, token_counts

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _rid int, size int, row string, _key string, digest int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n, vocabulary=None):
    x = seed * 2654435761 % (1 << 32)
    out = []
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % (1 << 32)
        v = vocabulary or WORDS
        out.append(v[(x >> 12) % len(v)] + ("" if x >> 31 else "."))
    return " ".join(out)


LONG = prose(9, 30_000)
ROWS = [
    (1, prose(1, 80), "en", "b", 5), (2, prose(1, 80).replace(" ", " \n\t"), "en", "b", 5), (3, prose(1, 80) + " more", "en", "a", 5),
    (4, "", "en", "a", 0), (5, None, None, None, None), (6, "   ", "de", "a", 0), (7, LONG, "en", "c", 9), (8, LONG + " end", None, "c", 9),
    (9, prose(2, 200), "de", None, 1), (9, prose(2, 200), "de", None, 1), (10, "one two", "de", "z", 1), (11, "one  two", "de", "z", 1),
    (12, "x " * 400, "en", "z", 1), (13, "ü ß é 中文", "de", "a", 1), (14, prose(3, 60).upper(), "en", "b", 1), (15, prose(3, 60), "en", "b", 1),
    (None, prose(4, 70), "en", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "r", "k", 3) for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_duplicates(docs):
    got = exact_dedup.exact_duplicates(docs, extra={"sha": F.sha2(exact_dedup.normalised(F.col("row.text")), 256)}).collect()
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(normal(t), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): sorted(ids, key=lambda i: (i is None, i)) for t, ids in groups.items()}
    assert len(got) == len(ROWS)
    for r in got:
        ids = by_sha[r.sha]
        assert (r.group_size, r.keep_id) == (len(ids), ids[0])
    assert sum(r.kept for r in got) == len(groups)
    assert sorted(r.doc_id for r in got if r.kept and r.doc_id is not None) == [1, 3, 4, 6, 7, 8, 9, 10, 12, 13, 14, 15]


def test_exact_duplicates_of_long_texts_that_part_late(spark):
    base = "a" * 70_000
    rows = [(1, base + "x"), (2, base + "y"), (3, base + "x"), (4, base), (5, base + "y"), (6, base + "z")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2, 6: 6}


def near_brute(rows, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k: k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(docs):
    got = near_dedup.near_duplicates(docs, size=3, percent=85).collect()
    want = near_brute([(i, t) for i, t, *_ in ROWS if i is not None], 3, 85)
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)


def test_large_family_of_near_copies_is_linked_as_brute_force_does(spark, monkeypatch):
    """Copies with more and more words changed: chains, outsiders and several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 8)
    base = prose(5, 120).split()
    rows = []
    for i in range(70):
        w = list(base)
        for k in range(i % 9):
            w[(7 * k + 13 * i) % 120] = f"own{i}x{k}"
        rows.append((100 + i, " ".join(w)))
    rows += [(i, prose(40 + i, 90)) for i in range(20)]
    for size, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), size=size, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows, size, percent)


@pytest.mark.parametrize("block", [2, 256])
def test_links_in_crowded_buckets_do_not_hang_on_the_centres(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "SKETCHES", block)
    rng = np.random.default_rng(5)
    crowd = {i: rng.integers(0, 256, 200, dtype=np.uint8) for i in range(1, 41)}
    changed = lambda s, k: np.r_[s[:k] ^ 1, s[k:]]
    # Alike each other but no centre; and one of two alike just within reach of a centre (node 1), the other just without.
    crowd[20], crowd[22] = crowd[21], changed(crowd[21], 20)
    crowd[25] = changed(crowd[1], 78)
    crowd[26] = np.r_[crowd[25][:180], crowd[25][180:] ^ 1]
    rows = [(i, 100 + i % 2, [0], s.tobytes()) for i, s in crowd.items()]
    nodes = spark.createDataFrame(rows, "node bigint, n bigint, bands array<bigint>, sketch binary")
    family = {r.node: r.family for r in near_dedup._families(nodes, 85).collect()}
    assert family[20] == family[21] == family[22] and family[25] == family[26] == family[1] != family[20]
    assert set(family) == {1, 20, 21, 22, 25, 26}


def test_mixture(docs):
    got = mixing.drawn(docs).collect()
    sizes = {}
    for _, t, _, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + len(normal(t).split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))], 1.5, 2.0)))
    assert len(got) == len(ROWS)
    for r in got:
        assert r.size == len(normal(r.row.text).split()) and r.source_size == sizes[r.row.source] and 0 <= r.copies <= 2
        assert r.target == pytest.approx(goal[r.row.source])
    again = mixing.drawn(docs.repartition(5)).collect()
    key = lambda x: sorted((r.row.doc_id or -1, r.size, r.copies) for r in x)
    assert key(got) == key(again)
    assert mixing.emitted(docs).columns == docs.columns and mixing.emitted(docs).count() == sum(r.copies for r in got)


def test_mixture_meets_its_targets(spark):
    rows = [(i, f"s{i % 4}", (i * 7919) % 400 + (20_000 if i % 500 == 0 else 0)) for i in range(4000)]
    got = mixing.drawn(spark.createDataFrame(rows, "doc_id bigint, source string, n int"), size=F.col("n")).collect()
    for source in {r.row.source for r in got}:
        mine = [r for r in got if r.row.source == source]
        rate = mine[0].target / mine[0].source_size
        part = rate % 1
        # Independent draws: within four standard errors, and every document floor(rate) times or once more.
        error = 4 * (part * (1 - part) * sum(r.size**2 for r in mine)) ** 0.5
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= error + 1e-6
        assert {r.copies for r in mine} <= {int(rate), int(rate) + 1}
        assert abs(sum(r.copies for r in mine) / len(mine) - rate) <= 4 * (part * (1 - part) / len(mine)) ** 0.5


def test_packing(docs):
    path = public.path("word_bpe_49k.json")
    t = token_counts.tokenizer(path)
    got = packing.packed(docs, path, end=2, digest={"crc": F.crc32}).collect()
    lean = packing.packed(docs, path, end=2, digest={"crc": F.crc32}, with_ids=False).collect()
    assert sorted(map(str, [r[:-1] for r in got])) == sorted(map(str, lean)) or len(got) == len(lean)
    ids = [t.encode(x or "", add_special_tokens=False).ids + [2] for _, x, *_ in ROWS]
    for rows in (got, lean):
        assert sum(r.length for r in rows) == sum(map(len, ids))
        for n, (i, *_) in enumerate(ROWS):
            mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
            if i != 9:
                assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
                assert sum(r.length for r in mine) == len(ids[n]) == mine[0].doc_tokens
            for r in mine:
                raw = b"".join(x.to_bytes(4, "little") for x in ids[n][r.start: r.start + r.length])
                assert zlib.crc32(raw) == r.crc
                assert "ids" not in r or bytes(r.ids) == raw
        seq = {}
        for r in rows:
            seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in seq.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 4096


def test_token_counts(docs):
    path = public.path("byte_bpe_50k.json")
    t = token_counts.tokenizer(path)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    assert got == sorted((i or -1, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in ROWS)


def test_repetition(docs):
    got = {(r.doc_id, r.n_words): r for r in repetition.repetition(docs).collect()}
    for i, t, *_ in ROWS:
        w = (t or "").split()
        r = got[i, len(w)]
        grams = [tuple(w[k: k + 3]) for k in range(len(w) - 2)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        hit = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        assert r.n_repeat_words == len(hit) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == sum((t or "").count(x) for x in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert got[12, 400].n_covered == 400 and got[12, 400].longest_repeat == 399 and not got[12, 400].kept
    assert got[1, 80].kept
    twice = repetition.repetition(docs.sparkSession.createDataFrame([(1, "\n".join(["a b", "", "a b", "c", " ", " ", "a b"]))], "doc_id int, text string"))
    assert twice.first().n_dup_lines == 2


def test_languages(spark, docs):
    en, de = "the and of was that with for".split(), "der und die nicht sich mit auch".split()
    rows = [(i, prose(i + 1, 40, en if i % 2 else de), "en" if i % 2 else "de") for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.trained(language.language_counts(train.where(~language.held_out())))
    got = {r.doc_id: r for r in language.languages(train, model).collect()}
    assert all(got[i].lang_pred == lang and 0 < got[i].score <= 1 for i, _, lang in rows)
    odd = language.languages(docs, model).collect()
    assert len(odd) == len(ROWS)
    for r in odd:
        assert (r.lang_pred == "und") == (r.doc_id in (4, 5, 6)) and (r.score == 0) == (r.lang_pred == "und")
    empty = language.trained(language.language_counts(train.where("lang IS NULL")))
    assert {r.lang_pred for r in language.languages(docs, empty).collect()} == {"und"}
    kept = language.with_clear_language(docs)
    assert kept.columns == docs.columns and not {r.doc_id for r in kept.collect()} & {4, 5, 6}


def test_site_quality(spark):
    good = [(i, prose(i + 1, 60), f"h{i % 3}", "p") for i in range(60)]
    bad = [(100 + i, "BUY!! $$$ " * (20 + i), "h3", None if i % 2 else "q") for i in range(30)]
    rows = [*good, *bad, (200, None, None, None), (201, "", "h0", "p"), (1, prose(2, 60), "h1", "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, path string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 30, 2)] + [(0, None), (2, 1)], "doc_id bigint, quality int")
    got = site_quality.classified(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(60)) and not any(by[100 + i].kept for i in range(30))
    assert by[100].host_rate < by[0].host_rate and 0 <= by[200].quality_score <= 1
    none = site_quality.classified(docs, labels.where("quality > 5")).collect()
    assert len(none) == len(rows) and all(0 <= r.quality_score <= 1 for r in none)


def test_pages(spark):
    body = "<html><body><nav>menu</nav><div class='{}'><p>{}</p></div><footer>foot text</footer></body></html>"
    rows = [(i, f"http://www.host.org/{i}", body.format("story", prose(i + 1, 50)), "x") for i in range(6)]
    rows += [(6, "http://host.org/6", body.format("story", "tiny"), "x"), (7, "https://HOST.org:80/7", "", "x"), (8, None, None, "x"),
             (9, "no host", "<p>just &amp; this", "x"), (9, "no host", "<p>just &amp; this", "x")]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")).collect()}
    assert got == {**{i: prose(i + 1, 50) for i in range(6)}, 6: "tiny", 7: "", 8: "", 9: "just & this"}


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "system", "s"), (2, 1, "Human", "q"), (2, 2, "user", "r"), (3, 0, "assistant", None),
            (4, 0, None, "?"), (4, 1, "tool", ""), (None, 5, "user", "u"), (5, 0, "user", "a"), (5, 0, "user", "a")]
    got = chat.repaired(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(got) == len(rows)
    whole = {}
    for r in sorted(got, key=lambda r: (r.conv_id or 0, r.position)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.rendered
    assert whole[1] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert whole[2] == "<|system|>\ns<|end|>\n<|user|>\nq\n\nr<|end|>\n<|assistant|>\n<|end|>\n"
    assert whole[4] == "<|user|>\n?<|end|>\n<|assistant|>\n<|end|>\n"
    for text in whole.values():
        roles = re.findall(r"<\|(system|user|assistant)\|>", text)
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles and len(roles) % 2 == 0 and roles == ["user", "assistant"] * (len(roles) // 2)


def test_chat_of_one_long_conversation_spans_tasks(spark):
    roles = [["user", "assistant", "user", "user", "tool"][i * 7 % 5] for i in range(3000)]
    rows = [(1, i, r, str(i)) for i, r in enumerate(roles)]
    got = chat.repaired(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    whole = chat.forward([chat.ROLES.index(r) + 1 if r in chat.ROLES else 0 for r in roles], [0, chat.FAR, chat.FAR, chat.FAR])[-1]
    assert sum(r.cost for r in got) == min(c + chat.ENDS[s][0] for s, c in enumerate(whole))
    assert sorted(r.position for r in got) == list(range(3000))


def test_chat_of_equal_turns_is_cut_into_tasks_and_stretches(spark, monkeypatch):
    written, real = [], chat.durable
    monkeypatch.setattr(chat, "STRETCH", 50, raising=False)
    monkeypatch.setattr(chat, "durable", lambda df: written.append(real(df)) or written[-1])
    equal = spark.range(2000).selectExpr("1L AS conv_id", "0L AS turn", "'user' AS role", "'' AS text")
    rows = equal.union(spark.range(2000).selectExpr("2L", "id", "CASE WHEN id % 3 < 2 THEN 'user' ELSE 'assistant' END", "''"))
    got = chat.repaired(rows).collect()
    assert next(d for d in written if "_turns" in d.columns).agg(F.max("_n")).first()[0] <= 50
    assert next(d for d in written if "_part" in d.columns).where("conv_id = 1").select("_part").distinct().count() > 1
    for conv, roles in ((1, [chat.USER] * 2000), (2, [chat.USER if i % 3 < 2 else chat.ASSISTANT for i in range(2000)])):
        mine = [r for r in got if r.conv_id == conv]
        whole = chat.forward(roles, [0, chat.FAR, chat.FAR, chat.FAR])[-1]
        assert sum(r.cost for r in mine) == min(c + chat.ENDS[s][0] for s, c in enumerate(whole))
        assert sorted(r.position for r in mine) == list(range(2000))


def test_empty_tables(spark, nothing):
    b, w = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
    model = language.trained(language.language_counts(nothing))
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    sites = nothing.select("doc_id", "text", "source", F.col("lang").alias("path"))
    for df in (exact_dedup.exact_duplicates(nothing), near_dedup.near_duplicates(nothing), mixing.drawn(nothing), packing.packed(nothing, w, end=2),
               token_counts.token_counts(nothing, b), repetition.repetition(nothing), language.languages(nothing, model),
               site_quality.classified(sites, labels), html_text.extracted(spark.createDataFrame([], "page_id int, url string, html string")),
               chat.repaired(spark.createDataFrame([], "conv_id int, turn int, role string, text string"))):
        assert df.collect() == []


def test_pipeline_stages(spark, docs, nothing):
    rows, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
        seen.append([r.doc_id for r in rows.select("doc_id").collect()])
    language_ids, exact, near, mix, packed = seen
    assert not {4, 5, 6} & set(language_ids) and {1, 3, 7, 9, 10, 12, 14, 15} <= set(language_ids)
    assert exact.count(9) == 1 and not {2, 11} & set(exact) and {1, 3, 7, 8, 10} <= set(exact)
    left = {r[0]: r[1] for r in ROWS if r[0] is not None and r[0] in exact}
    assert sorted(x for x in near if x is not None) == sorted({c for _, c in near_brute(list(left.items()), 5, 80).values()})
    assert set(mix) <= set(near) and set(packed) == set(mix)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").collect() == []
