"""HTML extraction by consensus host paths.

Every page's containers are scored by the text they hold outside links and
page furniture. Pages vote for the generalised tag-class path of their best
containers, votes are added up per host in Spark, and each page is extracted
again from the containers on its host's winning path. A page without text on
that path falls back to its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelgrid.llm.arrow import blocks, texts
from parcelgrid.session import durable

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

# Fixed values of HTML: elements without content, with raw text, inside a line, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr img".split())
BLOCK_STOPS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                          "header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "body": ("head",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("table ul ol dl article section div main body select td th".split())

# Fixed values of this extractor: furniture by element, by role and by words of class and id.
DROPPED = frozenset("nav aside footer form button select menu dialog object canvas svg head".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget "
    "footer foot comment comments disqus respond reply replies related recommended share sharing social toolbar pagination pager search skip "
    "masthead topbar copyright hidden".split())
#: What these name is no part of the page's own text, however long it is.
FOREIGN_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter comment "
    "comments disqus respond reply replies related recommended".split())
#: Classes that begin so tell of the layout around something else.
LAYOUT_WORDS = frozenset("has no with without not".split())
#: Elements whose ids are made from headings.
HEADED = frozenset("h1 h2 h3 h4 h5 h6 section article".split())
#: Why an element is dropped: by a layout word or as a form, as furniture by element, role or foreign word, or as never shown.
SHOWN, LAYOUT, FURNITURE, UNSEEN = range(4)
UNSEEN_TAGS = frozenset("head object canvas svg button select".split()) | RAW
TRUSTED_WORDS = frozenset("article content post entry story main text body".split())
CONTAINERS = frozenset("article main section div td body".split())
#: Elements further down share the path of the last named one.
DEEPEST = 64
#: Words of furniture written as one with what they hold, as in commentlist.
_GLUED = re.compile(r"^(comments?|sidebar|footer|cookie|newsletter|breadcrumbs?|related|share|social|advert|nav|menu)"
                    r"(?:list|area|form|box|section|block|wrap|wrapper|thread|container|bar|links?|notice|banner|widget|inner|items?|posts)$")


class Node:
    __slots__ = ("tag", "path", "parent", "depth", "why", "dropped", "trusted", "linked", "start", "end", "chars", "links")

    def __init__(self, tag, path, parent, depth, why, trusted, start):
        self.tag, self.path, self.parent, self.depth, self.why, self.dropped, self.trusted = tag, path, parent, depth, why, False, trusted
        self.linked = tag == "a" or parent is not None and parent.linked
        self.start, self.end, self.chars, self.links = start, -1, 0, 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)}


def _step(tag: str, names: list[str]) -> str:
    """tag.class with numbers and id-like classes left out."""
    plain = sorted({n for n in names if not any(ch.isdigit() for ch in n)})
    return ".".join([tag, *plain[:3]])


def _furniture(tag: str, classes: list[str], name: str) -> int:
    """LAYOUT or FURNITURE where a class, or the id ``name``, has a word of furniture; else SHOWN."""
    parts = [_SPLIT.split(n) for n in classes]
    if tag not in HEADED:
        parts.append(_SPLIT.split(name))
    words = {w for n in parts if n[0] not in LAYOUT_WORDS for w in n}
    words = (words | {m[1] for w in words if (m := _GLUED.match(w))}) & DROPPED_WORDS
    if not words or tag in ("body", "html", "main") or tag == "article" and not words & {"comment", "comments", "related"}:
        return SHOWN
    return FURNITURE if words & FOREIGN_WORDS else LAYOUT


def _settle(nodes: list[Node], pieces) -> None:
    """Set ``dropped``, inherited by what is inside.

    A layout element with an article, main or more than half of the page's text
    inside is not dropped; furniture is not where all articles and mains of the
    page would be, with more text than is left. If nothing is left, all but furniture and the unseen is kept.
    """
    def spread(least):
        for node in nodes[1:]:
            node.dropped = node.parent.dropped or node.why >= least

    def up(node):
        while node is not None:
            yield node
            node = node.parent

    spread(FURNITURE)
    mass = dict.fromkeys(nodes, 0)
    for node, text, _ in pieces:
        if not node.dropped:
            mass[node] += len(text) - text.count(" ") // 2
    for node in reversed(nodes[1:]):
        mass[node.parent] += mass[node]
    holds = set()
    for node in reversed(nodes[1:]):
        if node.tag in ("article", "main") and not node.dropped or node in holds:
            holds.add(node.parent)
    for node in nodes[1:]:
        if node.why == LAYOUT and (node in holds or 2 * mass[node] > mass[nodes[0]]):
            node.why = SHOWN
    spread(LAYOUT)
    own = [n for n in nodes if n.tag in ("article", "main") and n.why == SHOWN]
    long = [len(text) - text.count(" ") // 2 for _, text, _ in pieces]
    shown = sum(n for n, (node, _, _) in zip(long, pieces) if not node.dropped)
    if own and all(n.dropped for n in own) and sum(sum(long[n.start: n.end]) for n in own if not n.parent.trusted) > shown:
        cleared = set()
        for n in own:
            line = []
            for x in up(n.parent):
                if x in cleared:
                    break
                line.append(x)
            if all(x.why != UNSEEN for x in line):
                for x in line:
                    x.why = SHOWN
            cleared.update(line)
        spread(LAYOUT)
    if not any(text.strip() and not node.dropped for node, text, _ in pieces):
        spread(FURNITURE)


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str, bool]]]:
    """(elements in page order, pieces of text with their element and whether a block starts before them)."""
    root = Node("", "", None, 0, SHOWN, False, 0)
    nodes, pieces, here, fresh, at = [root], [], root, True, 0
    open_tags: Counter = Counter()

    def close(node, last):
        while True:
            last.end = len(pieces)
            open_tags[last.tag] -= 1
            if last is node:
                return node.parent
            last = last.parent

    def say(text):
        nonlocal fresh
        if text:
            pieces.append((here, html.unescape(text), fresh))
            fresh = False

    end_of_page = len(page)
    while at < end_of_page:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at: m.start()])
        at = max(m.end(), m.start() + 1)
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if tag not in INLINE:
            fresh = True
        if m["close"]:
            if not open_tags[tag]:
                continue
            up = here
            while up is not root and up.tag != tag:
                if up.tag in ("article", "main", "body") and tag in INLINE | {"p"}:
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = close(up, here)
            continue
        stops = ("p",) if tag in BLOCK_STOPS_P else CLOSES.get(tag, ())
        if stops:
            up = here
            while up is not root and up.tag not in stops and (up.tag in INLINE or up.tag in stops or (stops != ("p",) and up.tag not in SCOPES)):
                up = up.parent
            if up is not root and up.tag in stops:
                here = close(up, here)
        raw = m["attrs"]
        attrs = _attributes(raw) if raw.strip(" /") else {}
        classes = attrs.get("class", "").lower().split()
        inside = here.trusted
        trusted = inside or tag in ("article", "main") or attrs.get("role") in ("main", "article")
        if (tag in UNSEEN_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true"
                or "display:none" in attrs.get("style", "").replace(" ", "").lower()):
            why = UNSEEN
        elif tag == "form" or attrs.get("role", "").lower() == "form":
            why = max(LAYOUT, _furniture(tag, classes, attrs.get("id", "").lower()))
        elif tag in DROPPED or (tag == "header" and not inside) or attrs.get("role", "").lower() in DROPPED_ROLES:
            why = FURNITURE
        else:
            why = _furniture(tag, classes, attrs.get("id", "").lower())
        if tag in VOID or raw.endswith("/") and tag not in INLINE and tag not in CONTAINERS and tag != "p":
            continue
        named = tag not in INLINE and tag != "p" and here.depth < DEEPEST
        here = node = Node(tag, here.path + ">" + _step(tag, classes) if named else here.path, here, here.depth + named, why,
                           trusted, len(pieces))
        nodes.append(node)
        open_tags[tag] += 1
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end_of_page
            here = close(node, node)
            fresh = True
    close(root, here)
    _settle(nodes, pieces)
    return nodes, pieces


def _visible(pieces, start: int, end: int) -> str:
    """Text of a range of pieces: white space is one blank, blocks are joined by one."""
    out = []
    for node, text, fresh in pieces[start:end]:
        if not node.dropped:
            if fresh:
                out.append(" ")
            out.append(text)
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def scored(nodes: list[Node], pieces) -> list[tuple[float, Node]]:
    """Containers with their scores, best first: own text less link text, with a premium for named content."""
    for node, text, _ in pieces:
        if not node.dropped:
            n = len(text) - text.count(" ") // 2
            node.chars += n
            node.links += n * node.linked
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.links += node.links
    # A page that marks its article is not read as a whole, however much stands beside it.
    marked = any(n.tag in ("article", "main") and not n.dropped and n.chars > 2 * n.links for n in nodes)
    best = []
    for node in nodes:
        if node.tag in CONTAINERS and not node.dropped and node.chars > 0 and not (marked and node.tag == "body"):
            words = set(_SPLIT.split(node.path.rpartition(">")[2]))
            premium = 1.5 if node.tag in ("article", "main") else 1.2 if words & TRUSTED_WORDS and node.tag != "body" else 1.0
            best.append(((node.chars - 2 * node.links) * premium * (1 + 0.02 * min(node.depth, 8)), node))
    return sorted(best, key=lambda x: (-x[0], x[1].start))


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user, port and a leading www; empty if there is none."""
    name = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(name, r"^www\.", "")


def path_votes(pages: DataFrame, *, url: str = "url", body: str = "html", choices: int = 3) -> DataFrame:
    """(host, path, votes, pages): scores of the generalised paths of each page's best containers, added up per host."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_html"):
            hosts, paths, votes = [], [], []
            for host, page in zip(b.column("_host").to_pylist(), texts(b, "_html").to_pylist()):
                best = scored(*parse(page))[:choices]
                for score, node in best:
                    if score > 0:
                        hosts.append(host)
                        paths.append(node.path)
                        votes.append(score / best[0][0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.float64())], ["host", "path", "vote"])

    cast = pages.select(host_of(F.col(url)).alias("_host"), F.col(body).alias("_html")).mapInArrow(
        vote, "host string, path string, vote double")
    return cast.groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"), F.count(F.lit(1)).alias("pages"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path): the path with most votes; of equal ones the longest, then the first by name."""
    order = F.struct("votes", F.length("path"), F.col("path"))
    return votes.groupBy("host").agg(F.max_by("path", order).alias("path"))


def _titled(nodes: list[Node], winner: Node) -> int:
    """Piece from which to read: the first heading that stands before ``winner`` in its parent, else the winner's own start.

    What follows the heading there, such as the lead, is read too. Right below
    the body only a heading of its own counts, not one in a box beside.
    """
    if winner.tag in ("article", "main", "body"):
        return winner.start
    outer = winner.parent
    for level in ("h1", "h2"):
        for node in nodes:
            if node.tag == level and not node.dropped and outer.start <= node.start < winner.start and node.end <= winner.start:
                if outer.tag not in ("body", "html", "") or node.parent is outer:
                    return node.start
    return winner.start


def page_text(page: str, path: str | None) -> str:
    """Main text of a page, from the containers on ``path`` or else from its own best container.

    A title and what follows it in front of the container, inside its parent,
    belong to the text.
    """
    nodes, pieces = parse(page)
    spans, end = [], -1
    for node in nodes:
        if path and node.path == path and node.tag in CONTAINERS and not node.dropped and node.start >= end:
            spans.append((node.start if spans else _titled(nodes, node), node.end))
            end = node.end
    found = " ".join(t for a, b in spans if (t := _visible(pieces, a, b)))
    if found:
        return found
    best = scored(nodes, pieces)
    if best:
        return _visible(pieces, _titled(nodes, best[0][1]), best[0][1].end)
    return _visible(pieces, 0, len(pieces))


def extracted(pages: DataFrame, *, key: str = "page_id", url: str = "url", body: str = "html", few_hosts: int = 50_000) -> DataFrame:
    """(key, url, text) of every page.

    Null or empty html gives an empty text; a page whose url has no host votes
    and is read with the others of that kind; repeated rows give a row each.
    The winners, one row per host, are broadcast up to ``few_hosts``; beyond
    that pages are joined to them by a shuffle. Other columns are not looked at.
    """
    winners = durable(winning_paths(path_votes(pages, url=url, body=body)))
    near = F.broadcast(winners) if winners.count() <= few_hosts else winners
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_html"):
            out = [page_text(page, path) for page, path in zip(texts(b, "_html").to_pylist(), b.column("_path").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_url"), pa.array(out, pa.string())], ["_key", "_url", "text"])

    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(body).alias("_html"), host_of(F.col(url)).alias("host"))
    return rows.join(near, "host", "left").select("_key", "_url", "_html", F.col("path").alias("_path")).mapInArrow(
        read, f"_key {kinds[key]}, _url {kinds[url]}, text string").withColumnsRenamed({"_key": key, "_url": url})
