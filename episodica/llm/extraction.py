"""HTML extraction (3): equivalence-class template deduction.

A page is a sequence of structural tokens (a block element with its class and id, under its block ancestors) with text
between them.  It is read once; what later steps need of it is kept as a table.  Over the pages of a host, and over those of each
of its layouts (pages whose text lies for the most part in the same containers):

* tokens that stand more than once on some page are told apart by their context: the last token before them, and the first one
  inside them, of those that stand exactly once on nearly all pages, and the kind of content they begin with.  So a menu, an article
  and a footer that are all plain div elements are three tokens, and what lies below them is told apart with them;
* tokens with the same occurrence vector (how often the token stands on each page) form an equivalence class.  A vector is kept
  as its support and a sum of hashes of (page, count), so classes come from sums and no host's pages meet in one task;
* classes that stand on enough pages are held against all pages again: a token that is out of the order of its class (not in a
  longest ordered part of it) on more than a few of its pages is not valid, nor is one whose nearest counted ancestor is not valid, and
  so on down.  The valid tokens nest by ancestry and are the template;
* the slots are the places under template nodes.  Slots under navigation, forms and the like (by element, class or id) are
  boilerplate.  The main slot is found from the root down: to the child slot that holds most of the text, as long as it holds the
  greater part of it, until a slot has text of its own that differs from page to page.  Among children an article or main element with a
  fair share goes first.  There is no main slot if more text stands in places that the pages do not share (a path that holds the
  page's name, say);
* slots outside the main slot's own text that are the same on nearly all pages, though the pages differ, are text of the template.

A page gives the blocks of text in the main slot of its layout, or else of its host (whose slot goes first if it lies inside).  A page that holds neither gives those of its
article or main element, or of its own container with most text, before all in places that the pages do not share.  Nothing else is
dropped: text that pages share in an article is kept.

Defined results: a null or empty page, and one without main text, gives the empty text and 0; pages without a host share the
empty one; broken markup is read on to its end, elements deeper than DEPTH count as the one they are in; a page is read in time and
memory proportional to its length; equal rows each get their own result row; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import itertools
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, shared, small_batches

#: Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style template noscript svg math iframe object canvas head title select textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr pre blockquote figcaption caption summary address".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote address".split())
NOT_MAIN = frozenset("nav footer aside form dialog menu fieldset".split())
#: Words in class, id and role that mark parts that are not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form login menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget alert complementary contentinfo search gdpr feedback reviews".split())
MAIN_MARKS = frozenset("article post entry story content main body".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*+(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
CONTEXT = re.compile(r"\.@[0-9a-f]{16}")
#: Share of pages that repeat a slot's text for it to be the template's, and of pages on which a token may be out of order.
SAME_SHARE, MISPLACED = 0.9, 0.05
#: Share of a host's pages that a template token stands on; that a token stands on, once on each, to be a context of others.
SUPPORT, ONCE = 0.5, 0.95
#: Share of a page's text in a container that makes it part of the page's layout; share of a host's pages (two at least) that a
#: layout needs for a template of its own.
HEAVY, LAYOUT = 0.2, 0.01
#: Shares of a slot's text: of a child to go down to, of an article or main element to go first, of own text to stop at.
GREATER, MARKED, OWN = 0.5, 0.3, 0.1
#: Nested elements that are told apart, and characters of a label that are kept as they are.
DEPTH, LABEL = 100, 80
#: Bytes of templates that may be broadcast.
BROADCAST = 32 << 20


class Node:
    __slots__ = ("tag", "path", "plain", "off", "main", "parent", "depth")

    def __init__(self, tag: str, path: str, off: bool, main: int, parent: Node | None):
        # main: 2 in an article element, 1 in a main element, else 0; path: plain, with contexts once they are known
        self.tag, self.path, self.plain, self.off, self.main, self.parent = tag, path, path, off, main, parent
        self.depth: int = parent.depth + 1 if parent else 0


def _marks(tag: str, attributes: str) -> tuple[str, set[str]]:
    found = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)] if "=" in attributes else []
    names = [x for k, v in found for x in v.lower().split()]
    label = tag + "".join(f".{re.sub(r'[0-9]+', '0', x).replace('/', '|')}" for x in names)
    if len(label) > LABEL:
        label = f"{tag}.{_hash(label):016x}"
    return label, {w for x in names for w in re.split(r"[^a-z]+", x) if w}


class Tree:
    """The place in the tree of elements while a page is read."""

    def __init__(self) -> None:
        self.node = Node("", "", False, 0, None)
        self.open: dict[str, int] = defaultdict(int)  # elements of each tag that the node is in
        self.deep: dict[str, int] = defaultdict(int)  # open elements below DEPTH, which have no node
        self.paths: dict[tuple[str, str], str] = {}

    def pop(self) -> None:
        self.open[self.node.tag] -= 1
        self.node = self.node.parent

    def close(self, tag: str) -> None:
        if self.deep[tag]:
            self.deep[tag] -= 1
        elif self.open[tag]:
            while self.node.tag != tag:
                self.pop()
            self.pop()

    def start(self, tag: str, said: str) -> bool:
        """Open an element given by its tag and markup; False if it gets no node."""
        if tag in TEXT and self.open[tag]:  # a paragraph, item or cell ends an open one of its kind
            up = self.node
            while up.tag in TEXT and up.tag != tag:
                up = up.parent
            if up.tag == tag:
                while self.node is not up.parent:
                    self.pop()
        while self.node.tag == "p":
            self.pop()
        node = self.node
        if node.depth >= DEPTH:
            if not said.endswith("/>"):
                self.deep[tag] += 1
            return False
        label, marks = _marks(tag, said)
        off = node.off or tag in NOT_MAIN or (tag == "header" and not node.main) or bool(marks & MARKS and tag not in ("article", "main", "body", "html"))
        off = off or (tag == "article" and bool(marks & {"comment", "comments", "reply"}))
        main = node.main
        if not off and tag == "article":
            main = 2
        elif not off and (tag == "main" or "main" in marks and tag in ("div", "section") and "role" in said.lower()):
            main = max(main, 1)
        path = self.paths.setdefault((node.path, label), f"{node.path}/{label}")
        self.node = Node(tag, path, off, main, node)
        self.open[tag] += 1
        return True


def read(page: str, texts: bool = True) -> Iterator[tuple[str, Node, str]]:
    """("open", node, "") of each block element, and ("text", node, text) of each block's text, white space in order."""
    tree = Tree()
    held: list[str] = []
    unclosed: set[str] = set()  # skipped elements that end nowhere on the rest of the page

    def flush() -> Iterator[tuple[str, Node, str]]:
        if held:
            text = SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                yield "text", tree.node, text

    at, n = 0, len(page)
    while at < n:
        found = TAG.search(page, at)
        stop = found.start() if found else n
        if stop > at and texts:
            held.append(entities.unescape(page[at:stop]))
        if not found:
            break
        at = found.end()
        if page[stop + 1 : stop + 2] in "!?":
            if page.startswith("<![CDATA[", stop) and texts:
                held.append(page[stop + 9 : at].removesuffix("]]>"))
            continue
        tag = NAME.match(page, stop)[1].lower()
        closing = page[stop + 1] == "/"
        if tag in SKIP and not closing:
            if page[at - 2 : at] != "/>" and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                if end or tag in ("script", "style"):
                    at = end.end() if end else n
                else:
                    unclosed.add(tag)
        elif tag == "br":
            held.append(" ")
        elif tag in VOID:
            if tag == "hr":
                yield from flush()
        elif tag not in INLINE and tag not in SKIP:
            yield from flush()
            if closing:
                tree.close(tag)
            elif tree.start(tag, page[stop:at]):
                node = tree.node
                if page[at - 2 : at] == "/>":
                    tree.pop()
                yield "open", node, ""
    yield from flush()


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)))


def _container(node: Node) -> Node:
    while node.parent is not None and node.tag in TEXT:
        node = node.parent
    return node


def _masses(blocks: list[tuple[Node, str]]) -> dict[Node, int]:
    """Characters of text in each container, with what it holds."""
    mass: dict[Node, int] = defaultdict(int)
    for node, text in blocks:
        up: Node | None = node
        while up is not None:
            if up.tag not in TEXT:
                mass[up] += len(text)
            up = up.parent
    return mass


def _place(path: str) -> str:
    """The token of a container: text outside of all elements has one, too."""
    return path or "/"


def layout(blocks: list[tuple[Node, str]]) -> str:
    """The layout of a page: the paths of the containers that hold much of its text."""
    free = [(node, text) for node, text in blocks if not node.off]
    mass: dict[str, int] = defaultdict(int)
    for node, n in _masses(free).items():
        mass[node.path] += n
    total = sum(len(text) for _, text in free)
    return f"{_hash(*sorted(p for p, n in mass.items() if n >= HEAVY * total)):016x}"


def _begins(first: Node | None, text_first: bool) -> str:
    """The kind of content that an element begins with."""
    if text_first:
        return "text"
    if first is None:
        return ""
    return "flow" if first.tag in FLOW else first.tag


class Page:
    """What is kept of a page: its block elements in the order they open, and its blocks of text."""

    def __init__(self, nodes: list[Node], blocks: list[tuple[Node, str]], seen: list[int]):
        # nodes[0] is the place outside of all elements; seen: nodes that were there before each block
        self.nodes, self.blocks, self.seen = nodes, blocks, seen

    @classmethod
    def of(cls, html: str) -> Page:
        nodes: list[Node] = []
        blocks: list[tuple[Node, str]] = []
        seen = []
        for what, node, text in read(html):
            if what == "open":
                if not nodes:
                    nodes.append(_root(node))
                nodes.append(node)
            else:
                if not nodes:
                    nodes.append(_root(node))
                blocks.append((node, text))
                seen.append(len(nodes))
        return cls(nodes, blocks, seen)

    def packed(self) -> str:
        number = {node: k for k, node in enumerate(self.nodes)}
        inner = self.nodes[1:]
        steps = [node.plain[len(node.parent.plain) + 1 :] for node in inner]
        said = [[number[node.parent] for node in inner], steps, [2 * node.main + node.off for node in inner], [number[node] for node, _ in self.blocks], self.seen, [text for _, text in self.blocks]]
        return json.dumps(said, ensure_ascii=False)

    @classmethod
    def unpacked(cls, packed: str) -> Page:
        ups, steps, flags, held, seen, texts = json.loads(packed)
        nodes = [Node("", "", False, 0, None)]
        paths: dict[tuple[str, str], str] = {}
        for up, step, flag in zip(ups, steps, flags, strict=True):
            path = paths.setdefault((nodes[up].plain, step), f"{nodes[up].plain}/{step}")
            nodes.append(Node(step.split(".")[0], path, bool(flag & 1), flag >> 1, nodes[up]))
        return cls(nodes, [(nodes[k], text) for k, text in zip(held, texts, strict=True)], seen)

    def tell(self, contexts: dict[str, list[str]] | None) -> None:
        """Give the nodes the paths in which tokens of many places are told apart by their contexts."""
        once = set(contexts["once"]) if contexts else set()
        many = set(contexts["many"]) if contexts else set()
        if not many:
            for node in self.nodes:
                node.path = node.plain
            return
        inside: dict[Node, str] = {}
        for node in self.nodes:
            up = node.parent if node.plain in once else None
            while up is not None and up not in inside:
                inside[up] = node.plain
                up = up.parent
        first = {after.parent: after for after in reversed(self.nodes[1:])}
        # a text that comes before any element has opened since its own did
        early = {node for (node, _), n in zip(self.blocks, self.seen, strict=True) if n and self.nodes[n - 1] is node}
        paths: dict[tuple[str, str], str] = {}
        before = ""
        for node in self.nodes[1:]:
            step = node.plain[len(node.parent.plain) + 1 :]
            if node.plain in many and node.tag not in TEXT:
                step += f".@{_hash(before, inside.get(node, ''), _begins(first.get(node), node in early)):016x}"
            node.path = paths.setdefault((node.parent.path, step), f"{node.parent.path}/{step}")
            if node.plain in once:
                before = node.plain


def _root(node: Node) -> Node:
    while node.parent is not None:
        node = node.parent
    return node


def page_tokens(page: Page, number: int) -> dict[str, list[int]]:
    """token: pages, vector, place of its first occurrence among those of all tokens, characters of text, least and greatest
    hash of its text.  The token "" stands for the page."""
    count: dict[str, int] = defaultdict(int)
    chars: dict[str, int] = defaultdict(int)
    texts: dict[str, int] = defaultdict(int)
    whole = 0
    for node in page.nodes[1:]:
        if node.tag not in TEXT:
            count[node.path] += 1
    first = places(page)
    if "/" in first:
        count["/"] = 1
    for node, text in page.blocks:
        own = _place(_container(node).path)
        if not node.off:
            chars[own] += len(text)
        texts[own] = (texts[own] * 31 + _hash(text)) % (1 << 62)
        whole = (whole * 31 + _hash(text)) % (1 << 62)
    out = {"": [1, _hash(number) >> 33, 0, sum(chars.values()), whole, whole]}
    for t, n in count.items():
        h = texts.get(t, 0)
        out[t] = [1, _hash(number, n) >> 33, first[t], chars.get(t, 0), h, h]
    return out


def places(page: Page) -> dict[str, int]:
    """The place of each token's first occurrence among those of all tokens."""
    first: dict[str, int] = {}
    bare = next((n for (node, _), n in zip(page.blocks, page.seen, strict=True) if not _container(node).path), None)
    for k, node in enumerate(page.nodes):
        if k == bare:
            first.setdefault("/", len(first))
        if k and node.tag not in TEXT:
            first.setdefault(node.path, len(first))
    if bare is not None:
        first.setdefault("/", len(first))
    return first


COLUMNS = ["pages", "vector", "first", "chars", "low", "high"]
TOKENS = "host string, layout string, token string, " + ", ".join(f"{c} long" for c in COLUMNS)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        pages = [Page.of(x if isinstance(x, str) else "") for x in frame["html"]]
        kinds = [layout(page.blocks) for page in pages]
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "host": frame["host"], "layout": kinds, "page": [page.packed() if page.nodes else None for page in pages]})


def _unpacked(packed: object) -> Page:
    return Page.unpacked(packed) if isinstance(packed, str) else Page([Node("", "", False, 0, None)], [], [])


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages that hold each plain path, and how often one page does, for hosts (layout "") and their layouts; "" stands for the page."""
    for frame in batches:
        sums: dict[tuple[str, str, str], list[int]] = {}
        for host, kind, packed in zip(frame["host"], frame["layout"], frame["page"], strict=True):
            count: dict[str, int] = defaultdict(int)
            for node in _unpacked(packed).nodes:
                count[node.plain] += 1
            for key, (path, n) in itertools.product(("", kind), count.items()):
                y = sums.setdefault((host, key, path), [0, 0])
                y[0] += 1
                y[1] = max(y[1], n)
        yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "layout", "token", "pages", "most"])


def contexts(rows: pd.DataFrame) -> dict[str, list[str]]:
    """once: paths that stand once on nearly all pages; many: paths of containers that some page holds more than once."""
    n = rows.loc[rows["token"] == "", "pages"].iloc[0]
    inner = rows[rows["token"] != ""]
    once = inner.loc[(inner["most"] == 1) & (inner["pages"] >= ONCE * n), "token"]
    many = [t for t in inner.loc[inner["most"] > 1, "token"] if t.rpartition("/")[2].split(".")[0] not in TEXT]
    return {"once": sorted(once) if many else [], "many": sorted(many)}


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    told = Plans()
    for frame in batches:
        sums: dict[tuple[str, str, str], list[int]] = {}
        for page_id, url, host, kind, packed, said in zip(frame["page_id"], frame["url"], frame["host"], frame["layout"], frame["page"], frame["told"], strict=True):
            page = _unpacked(packed)
            # each page counts for its host (layout "") and for its layout of it
            for key in ("", kind):
                page.tell(told[said].get(key))
                for token, x in page_tokens(page, _hash(page_id, url)).items():
                    y = sums.get((host, key, token))
                    if y is None:
                        sums[host, key, token] = list(x)
                    else:
                        for k in range(4):
                            y[k] += x[k]
                        y[4], y[5] = min(y[4], x[4]), max(y[5], x[5])
        yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["host", "layout", "token", *COLUMNS])


def classes(rows: pd.DataFrame) -> list[list[str]]:
    """The equivalence classes of the tokens of a host, or of a layout of it, each in the order of the tokens' mean places."""
    rows = rows[rows["token"] != ""]
    rows = rows.assign(mean=rows["first"] / rows["pages"]).sort_values(["mean", "token"])
    return [x["token"].tolist() for _, x in rows.groupby(["pages", "vector"])]


def misplaced(order: list[int]) -> set[int]:
    """Indexes of the numbers that are not in a longest ascending part."""
    tops: list[int] = []  # index of the least number that ends an ascending part of each length
    before: list[int] = []
    for k, x in enumerate(order):
        at = bisect_left(tops, x, key=order.__getitem__)
        before.append(tops[at - 1] if at else -1)
        tops[at : at + 1] = [k]
    kept, k = set(), tops[-1] if tops else -1
    while k >= 0:
        kept.add(k)
        k = before[k]
    return set(range(len(order))) - kept


def _up(token: str) -> str:
    """The nearest ancestor that is counted: elements in TEXT are none."""
    up = token.rpartition("/")[0]
    while up and up.rpartition("/")[2].split(".")[0] in TEXT:
        up = up.rpartition("/")[0]
    return up


def valid(rows: pd.DataFrame) -> set[str]:
    """The tokens that are in the order of their classes and hang, over all their counted ancestors, below such tokens."""
    known = {""} | set(rows.loc[(rows["token"] != "") & (rows["wrong"] <= MISPLACED * rows["pages"]), "token"])
    for t in sorted(known, key=len):  # ancestors first
        if t and _up(t) not in known:
            known.discard(t)
    return known - {""}


def _tagged(token: str) -> bool:
    return token.rpartition("/")[2].split(".")[0] in ("article", "main")


def template(rows: pd.DataFrame) -> dict[str, list[str]]:
    """main: path of the main slot, if the pages share it; drop: paths of slots that hold the template's text; other: paths of the slots
    with text that are neither.  rows: the tokens of a host, or of a layout of it, that its pages share."""
    host = rows[rows["token"] == ""].iloc[0]
    rows = rows[rows["token"].isin(valid(rows))]
    n = int(host["pages"])
    free = {r.token: r.chars for r in rows.itertuples() if r.chars}
    children: dict[str, list[str]] = defaultdict(list)
    mass: dict[str, float] = defaultdict(float)
    for t in rows["token"]:
        children[_up(t)].append(t)
    for t, chars in free.items():
        mass[""] += chars
        while t:
            mass[t] += chars
            t = _up(t)
    data = {r.token for r in rows.itertuples() if r.chars and (r.low != r.high or n == 1)}  # slots whose text differs
    main, own = "", False
    while mass[main]:
        own = main in data and free[main] >= OWN * mass[main]
        below = [t for t in children[main] if mass[t] >= MARKED * mass[main]]
        if own or not below:
            break
        best = max(below, key=lambda t: (_tagged(t), mass[t], t))
        if mass[best] < GREATER * mass[main] and not _tagged(best) or _tagged(main) and not _tagged(best):
            break
        main = best
    inside = lambda t: t == main or t.startswith(main + "/")
    varied = host["low"] != host["high"]
    drop = [r.token for r in rows.itertuples() if varied and r.low == r.high and r.low and r.pages >= SAME_SHARE * n and not (inside(r.token) and (own or _tagged(main)))]
    # text in places that the pages do not share may be the main text of each page, whatever stands beside it
    if not main or float(host["chars"]) - float(rows["chars"].sum()) > mass[main]:
        return {"main": [], "drop": drop, "other": sorted(t for t in free if t not in drop)}
    return {"main": [main], "drop": drop, "other": sorted(t for t in free if not inside(t) and t not in drop)}


def _keyed(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)", 1), "^.*@", ""), ":.*$", ""))
    return rows.withColumn("host", F.coalesce(host, F.lit("")))


def _with(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """rows with the JSON of their host as a column, which is sent to all tasks if it is small."""
    weight = found.agg(F.coalesce(F.sum(F.length("host") + F.length("json") + 64), F.lit(0))).first()[0]
    found = found.withColumnRenamed("json", name)
    return rows.join(F.broadcast(found) if weight <= BROADCAST else found, "host", "left")


def _by_host(often: DataFrame, make: Callable[[pd.DataFrame], object]) -> DataFrame:
    """host, json: the results of make for the tokens of each layout, by layout."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "layout": [frame["layout"].iloc[0]], "json": [json.dumps(make(frame))]})

    each = often.groupBy("host", "layout").applyInPandas(run, "host string, layout string, json string")
    said = F.transform(F.array_sort(F.collect_list(F.struct("layout", "json"))), lambda x: F.concat(F.lit('"'), x["layout"], F.lit('": '), x["json"]))
    return each.groupBy("host").agg(F.concat(F.lit("{"), F.concat_ws(", ", said), F.lit("}")).alias("json"))


class Plans:
    """Parsed JSON by its text."""

    def __init__(self) -> None:
        self.known: dict[str, dict] = {}

    def __getitem__(self, text: object) -> dict:
        if not isinstance(text, str):
            return {}
        if text not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[text] = json.loads(text)
        return self.known[text]


def _order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many pages hold a token out of the order of its class, for the tokens that some page does."""
    plans, told = Plans(), Plans()
    for frame in batches:
        wrong: dict[tuple[str, str, str], int] = defaultdict(int)
        for host, kind, packed, said, plan in zip(frame["host"], frame["layout"], frame["page"], frame["told"], frame["json"], strict=True):
            page = _unpacked(packed)
            for key in ("", kind):
                if not plans[plan].get(key):
                    continue
                page.tell(told[said].get(key))
                first = places(page)
                for own in plans[plan][key]:
                    held = [t for t in own if t in first]
                    for k in misplaced([first[t] for t in held]):
                        wrong[host, key, held[k]] += 1
        yield pd.DataFrame([(*k, v) for k, v in wrong.items()], columns=["host", "layout", "token", "wrong"])


def _often(tokens: DataFrame, *columns: str) -> DataFrame:
    """The tokens that many pages of a host share, or of a layout that is large enough."""
    size = tokens.where("token = ''").select("host", "layout", F.col("pages").alias("n"))
    whole = size.where("layout = ''").select("host", F.col("n").alias("whole"))
    size = size.join(whole, "host").where((F.col("layout") == "") | (F.col("n") >= F.greatest(F.lit(2.0), LAYOUT * F.col("whole"))))
    # what half of the pages share is no more than twice what a page holds: a layout's tokens fit a task
    return tokens.join(size, ["host", "layout"]).where(F.col("pages") >= SUPPORT * F.col("n")).select("host", "layout", "token", *columns)


def told(pages: DataFrame) -> DataFrame:
    """The pages as they are kept (page_id, url, host, layout, page), with the contexts of their host as JSON by layout."""
    small_batches(pages.sparkSession)
    kept = shared(_keyed(pages).mapInPandas(_read, "page_id string, url string, host string, layout string, page string"))
    counts = kept.select("host", "layout", "page").mapInPandas(_counts, "host string, layout string, token string, pages long, most long")
    counts = shared(counts.groupBy("host", "layout", "token").agg(F.sum("pages").alias("pages"), F.max("most").alias("most")))
    return _with(kept, shared(_by_host(_often(counts, "pages", "most"), contexts)), "told")


def templates(rows: DataFrame) -> DataFrame:
    """host, json (template() by layout, "" for all pages) of pages told(), from the classes of equal occurrence vectors."""
    agg = [F.sum(c).alias(c) for c in ("pages", "vector", "first", "chars")] + [F.min("low").alias("low"), F.max("high").alias("high")]
    tokens = shared(rows.mapInPandas(_tokens, TOKENS).groupBy("host", "layout", "token").agg(*agg))
    often = shared(_often(tokens, *COLUMNS))
    ordered = shared(_by_host(often, lambda frame: [x for x in classes(frame) if len(x) > 1]))
    wrong = _with(rows, ordered, "json").mapInPandas(_order, "host string, layout string, token string, wrong long")
    wrong = wrong.groupBy("host", "layout", "token").agg(F.sum("wrong").alias("wrong"))
    judged = often.join(wrong, ["host", "layout", "token"], "left").withColumn("wrong", F.coalesce("wrong", F.lit(0)))
    return _by_host(judged, template)


def heaviest(blocks: list[tuple[Node, str]]) -> list[str]:
    """The text of the innermost container that holds most of the text."""
    if not blocks:
        return []
    mass = _masses(blocks)
    most = max(mass.values())
    held = [node for node, n in mass.items() if n >= 0.8 * most]
    best = max(held, key=lambda node: node.path.count("/"))

    def inside(node: Node | None) -> bool:
        while node is not None and node is not best:
            node = node.parent
        return node is best

    return [text for node, text in blocks if inside(node)]


def main_text(page: Page, kind: str, plans: dict[str, dict[str, list[str]]], said: dict[str, dict[str, list[str]]]) -> str:
    """The text of the blocks in the main slot of a page of a layout, given the templates and contexts of its host by layout."""
    inside = lambda node, roots: any(node.path == r or node.path.startswith(r + "/") or r == "/" and not _container(node).path for r in roots)
    kept = [(node, text) for node, text in page.blocks if not node.off]
    known: set[Node] = set()
    own, whole = plans.get(kind), plans.get("")
    # pages of short texts can be a layout whose slots show no main one below the body, say: the host's slot inside goes first
    finer = own and whole and own["main"] and whole["main"] and CONTEXT.sub("", whole["main"][0]).startswith(CONTEXT.sub("", own["main"][0]) + "/")
    for key in ("", kind) if finer else (kind, ""):
        plan = plans.get(key)
        if plan:
            page.tell(said.get(key))
            kept = [(node, text) for node, text in kept if _place(_container(node).path) not in plan["drop"]]
            main = [text for node, text in kept if inside(node, plan["main"])]
            if main:
                return " ".join(main)
            known.update(node for node, _ in kept if _place(_container(node).path) in plan["other"])
    marked = max((node.main for node, _ in kept), default=0)
    if marked:
        return " ".join(text for node, text in kept if node.main == marked)
    # places that the pages share beside their main text come last
    left = [(node, text) for node, text in kept if node not in known]
    if sum(len(text) for _, text in left) < HEAVY * sum(len(text) for _, text in kept):
        left = kept
    return " ".join(heaviest(left))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    rows = told(pages.withColumn("page_id", F.col("page_id").cast("long")))
    rows = _with(rows, shared(templates(rows)), "json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans, said = Plans(), Plans()
        for frame in batches:
            whole = zip(frame["layout"], frame["page"], frame["json"], frame["told"], strict=True)
            texts = [main_text(_unpacked(page), kind, plans[plan], said[context]) for kind, page, plan, context in whole]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": np.fromiter(map(len, texts), np.int64, len(texts))})

    return by_batch(rows.select("page_id", "url", "layout", "page", "json", "told"), run, "page_id long, url string, text string, n_chars long", ("page_id",))
