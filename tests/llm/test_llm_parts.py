"""Parts of the text operators that need no session, against brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from parcelgrid.llm import chat, html_text, language, mixing, near_dedup, packing, repetition, shingles, token_counts
from parcelgrid.llm.arrow import blocks, words

public = pytest.importorskip("public_tokenizers")
ODD = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "é", "1", "23", "'s", "'", "!", "<|endoftext|>", "<|EndOfText|>", "<|",
       "中", "́", "😀", "\x00", "\r\n", "Σ", "word.", "word,", "<|startoftext|>"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_blocks_keep_every_row():
    b = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 100, 1, 1, 50)] + [None]})
    got = list(blocks(iter([b, b.slice(0, 0)]), limit=10))
    assert sum(x.num_rows for x in got) == 7 and pa.Table.from_batches(got).column("text").to_pylist() == b.column("text").to_pylist()


def test_words_are_runs_between_ascii_space():
    flat, at = words(pa.array([" a b  c\x0b", "", "\n", "D\x1ce"]))
    assert flat.to_pylist() == ["a b", "c", "D\x1ce"] and at.tolist() == [0, 2, 2, 2, 3]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(name):
    path, some = public.path(name), odd_texts(1500)
    t = token_counts.tokenizer(path)
    want = [len(t.encode(s)) if name.endswith(".model") else len(t.encode(s, add_special_tokens=False).ids) for s in some]
    assert token_counts.text_lengths(pa.array(some), path).tolist() == want


def test_ids_of_words_equal_the_ids_of_the_text():
    path, some = public.path("word_bpe_49k.json"), odd_texts(1500, 2)
    assert packing.drops_blanks(path) and not packing.drops_blanks(public.path("byte_bpe_50k.json"))
    ids, at = packing.text_ids(pa.array(some), path, 2)
    t = token_counts.tokenizer(path)
    for s, a, b in zip(some, at[:-1], at[1:]):
        assert ids[a:b].tolist() == t.encode(s, add_special_tokens=False).ids + [2]


def test_shingle_sets_count_like_sets_of_words():
    r = random.Random(3)
    some = [" ".join(r.choice("abAB") for _ in range(r.randint(0, 40))) for _ in range(60)]
    flat, at = shingles.shingle_sets(pa.array(some), 3)

    def brute(s):
        w = s.lower().split()
        return {tuple(w[i: i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    sets = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    assert [len(s) for s in sets] == [len(brute(s)) for s in some]
    mask = near_dedup.linked(sets, 85)
    for i in range(60):
        for j in range(60):
            x, y = brute(some[i]), brute(some[j])
            assert shingles.common(sets[i], sets[j]) == len(x & y)
            assert i == j or mask[i, j] == (bool(x) and 100 * len(x & y) >= 85 * len(x | y))


def test_min_max_signature_estimates_similarity():
    r = np.random.default_rng(5)
    a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 1 << 63, 200).astype(np.uint64)])
    s = near_dedup.min_max(np.concatenate([a, b]), np.array([0, 1000]), near_dedup._multipliers(600))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


def test_repeats_equal_brute_force():
    r = random.Random(0)
    for _ in range(150):
        docs = [[r.randint(0, r.choice([1, 3, 9])) for _ in range(r.choice([0, 1, 2, 7, 25]))] for _ in range(r.randint(0, 5))]
        codes = np.array([x for d in docs for x in d], np.int64)
        at = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)

        def common(d, i, j):
            k = 0
            while max(i, j) + k < len(d) and d[i + k] == d[j + k]:
                k += 1
            return k

        want = [max((common(d, i, j) for j in range(len(d)) if j != i), default=0) for d in docs for i in range(len(d))]
        length = repetition.repeats(codes, at)
        assert length.tolist() == want
        spans = np.zeros(len(codes), bool)
        for i, n in enumerate(want):
            if n >= 3:
                spans[i: i + 3] = True
        assert repetition.covered(length, 3, 3).tolist() == spans.tolist()


def test_targets_are_those_of_resharing_until_none_is_above():
    r = random.Random(7)
    for _ in range(200):
        sizes = [r.choice([0, 1, 10, 1000, r.randint(1, 10**6)]) for _ in range(r.randint(1, 25))]
        weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
        free, goal = set(range(len(sizes))), [0.0] * len(sizes)
        rest = 1.5 * sum(sizes)
        while free:
            level = rest / sum(weights[i] for i in free)
            over = {i for i in free if level * weights[i] > 2 * sizes[i]}
            if not over:
                for i in free:
                    goal[i] = level * weights[i]
                break
            for i in over:
                goal[i] = 2.0 * sizes[i]
                rest -= goal[i]
            free -= over
        assert mixing.targets(sizes, weights, 1.5, 2.0) == pytest.approx(goal, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("histogram", [{100: 1}, {3000: 500}, {3000: 7, 1: 3}, {4096: 5}, {1: 9000}, {2049: 3000, 100: 50}, {}, {5: 1, 4000: 2, 90: 70}])
def test_plan_places_every_piece_once(histogram):
    plan = packing.Plan(histogram, 4096)
    length = np.array([n for n, c in histogram.items() for _ in range(c)], np.int64)
    rank = np.array([i for c in histogram.values() for i in range(c)], np.int64)
    row, cut, some, sequence, offset = packing.placed(plan.table(), length, rank)
    assert (np.bincount(row, weights=some, minlength=len(length)) == length).all()
    spans, fills = {}, {}
    for r, c, n, s, o in zip(row.tolist(), cut.tolist(), some.tolist(), sequence.tolist(), offset.tolist()):
        spans.setdefault(r, []).append((c, n))
        fills.setdefault(s, []).append((o, n))
    for parts in (*spans.values(), *fills.values()):
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    used = [sum(n for _, n in parts) for parts in fills.values()]
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used)
    assert all(n <= 4096 for n in used) and padding <= 0.02 * max(1, sum(used))


def legal(roles):
    body = roles[1:] if roles[:1] == [1] else roles
    return len(body) % 2 == 0 and all(x == (2, 3)[i % 2] for i, x in enumerate(body)) and (bool(body) or not roles)


def cheapest(roles):
    """Cheapest repair by trying everything: roles, merges and up to one empty turn before each turn."""
    best = {(): 0}
    for role in roles:
        then = {}
        for out, paid in best.items():
            for q in (1, 2, 3):
                name = 0 if q == role else chat.GUESS if role == 0 else chat.RELABEL
                ways = [((*out, q), paid + name)] + [((*out, e, q), paid + name + chat.INSERT) for e in (2, 3)]
                if out and out[-1] == q:
                    ways.append((out, paid + name + chat.MERGE))
                for new, cost in ways:
                    if legal(list(new)) or legal([*new, 3]) or legal([*new, 2, 3]):
                        then[new] = min(then.get(new, 1 << 30), cost)
        best = then
    return min(c + (0 if legal(list(o)) else 5 if legal([*o, 3]) else 10) for o, c in best.items())


def test_repair_costs_equal_trying_everything_however_cut():
    r = random.Random(11)
    for _ in range(120):
        roles = [r.randint(0, 3) for _ in range(r.randint(1, 6))]
        want = cheapest(roles)
        for k in (1, 2, 6):
            parts = [roles[i: i + k] for i in range(0, len(roles), k)]
            states = chat.joined_states([chat.stretch(p) for p in parts])
            paid = sum(c for p, (a, b) in zip(parts, states) for *_, c in chat.choices(p, a, b)) + chat.ENDS[states[-1][1]][0]
            assert paid == want, (roles, k)


def test_mixture_finds_both_languages():
    texts = ["the cat and the dog were in the house with the other " * 6, "der hund und die katze sind nicht im haus " * 6]
    model = np.zeros((language.BINS, 2))
    row, bins, n, _ = language.ngrams(pa.array(texts))
    np.add.at(model, (bins, row), n)
    model = ((model + 0.1) / (model + 0.1).sum(axis=0)).astype(np.float32)
    some = [texts[0][:90], texts[1][:90], texts[0][:120] + texts[1][:60], "", "12 !?"]
    row, bins, n, letters = language.ngrams(pa.array(some))
    share = language.mixture(row, bins, n, 5, model)
    assert share[0].tolist() == [1, 0] and share[1].tolist() == [0, 1]
    assert 0.5 < share[2, 0] < 0.8 and share[2].sum() == pytest.approx(1, abs=1e-5)
    assert share[3:].sum() == 0 and letters[3:].tolist() == [0, 0]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>home</a></nav>
<div class="cookie-notice">We use cookies</div><main><div class="post-42 entry"><h1>Head &amp; line</h1><p>One <b>bo</b>ld<p>Two<br>three
<script>var t="</p>";</script><form>field</form><ul><li>a<li>b</ul></div><section class="comments"><p>nice page, really, so much text here</p></section>
</main><aside>more</aside><footer>&copy; site</footer>"""


def test_page_text_leaves_furniture_out():
    assert html_text.page_text(PAGE, None) == "Head & line One bold Two three a b"
    path = html_text.scored(*html_text.parse(PAGE))[0][1].path
    assert path == ">html>body>main" and html_text.page_text(PAGE, path) == html_text.page_text(PAGE, None)
    assert html_text.page_text(PAGE, path + ">div.entry") == html_text.page_text(PAGE, None)


@pytest.mark.parametrize("page, want", [("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b < c <!-- open", "a b < c"),
                                        ("<div>x</b></span>y</div", "x y"), ("<script>only", ""), ("<<<>>>", "<<<>>>")])
def test_broken_pages(page, want):
    assert re.sub(r"\s", "", html_text.page_text(page, None)) == re.sub(r"\s", "", want)


TEXT = "The whole article is here, and it goes on for some more words."


@pytest.mark.parametrize("page, path, want", [
    (f"<body><div class='content has-sidebar'><p>{TEXT}</p></div></body>", None, TEXT),
    (f"<body><div class='no-sidebar'><article>{TEXT}</article></div></body>", None, TEXT),
    (f"<body><form action=/><nav>menu</nav><div><p>{TEXT}</p></div></form></body>", None, TEXT),
    (f"<body><form action=/><main>{TEXT}</main></form><p>foot</p></body>", None, TEXT),
    (f"<body><div id=widget><div><p>{TEXT}</p></div></div><p>x</p></body>", None, TEXT),
    (f"<body><aside><article>{TEXT}</article></aside></body>", None, TEXT),
    (f"<article><section id='hidden-markov-models'>{TEXT}</section><h2 id='search'>Search</h2><p>b</p></article>", None, f"{TEXT} Search b"),
    (f"<body><div class=a><nav>menu</nav></div><div class=b>{TEXT}</div></body>", ">body>div.a", TEXT),
    (f"<body><div class=post><p>{TEXT}</p></div><div class=comments>{TEXT * 3}</div></body>", None, TEXT),
    (f"<body><div class=post><p>{TEXT}</p></div><div class='main-sidebar'>side</div><div class=related><article>card</article></div></body>", None, TEXT),
])
def test_no_page_loses_its_text_to_a_word_around_it(page, path, want):
    assert html_text.page_text(page, path) == want


def test_deep_and_long_pages_take_linear_time():
    assert len(html_text.page_text('<div class="a">x' * 20_000, None)) > 39_900
    assert html_text.page_text("<b>x </i>" * 20_000, None).count("x") == 20_000


def test_crc_of_cut_pieces_needs_only_their_bytes():
    ids = np.arange(10, dtype="<u4")
    assert zlib.crc32(ids[3:7].tobytes()) == zlib.crc32(ids.tobytes()[12:28])
