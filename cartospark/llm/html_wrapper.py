"""HTML main text by wrapper induction over the pages of a host.

Pages of one host share a template.  Up to SEEDS pages of each host, each of another layout and the most frequent among them,
stand for it; every page's DOM tree is aligned with the seed of its layout, or the one that it matches best, by simple
tree matching: nodes match if their labels do and their parents match, children in order, and as many nodes as possible.
Over all pages of the host that aren't copies of the seed, each node of the seed collects how often it matched, how often its text was the
same, and how much varying text stands in it.  Nodes that stay the same are template; nodes whose text varies are slots.

The content is the smallest element that holds nearly all text of the slots, or several of them where it's spread; a host's only
page is judged by its own text.  Text that varies with every page can also be an advert or a reader's comment, which no
alignment tells from content: there the roles of elements speak (tags such as nav, footer or form, hidden elements, class and id names that say
nothing else), as they do inside of the content.  Text in links doesn't count for finding the content.

Passes over the pages: one that counts layouts, one that fetches the seeds, one that votes (a row per host, node and task comes back), and
the extraction.  Wrappers are sent to the tasks if their checked size allows, and joined by host otherwise, where adaptive execution
splits a hot host.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .store import Scratch, free_names

SEEDS = 3
BROADCAST_BYTES = 16 << 20
BROADCAST_KEYS = 500_000  # of a long and a count each
#: A node's text inside of the content is template if so many other pages matched it and this share of them had the same text.
LEAST_PAGES = 3
LEAST_SHARE = 0.95
#: A page with a smaller share of text that differs from the seed's is a copy of it, which says nothing about the template.
LEAST_CHANGE = 0.2
#: The content: the smallest element with this share of the varying text.
REGION_SHARE = 0.85
#: An article element's text counts so many times when the content is looked for.
ARTICLE_WEIGHT = 4
CELLS = 40_000
VOTES = 500_000

#: Trees are walked by plain Python calls, which take heap and no stack, however deep a page is.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(\"[^\"]*+\"?|'[^']*+'?|[^\s\"'>]++))?")
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)"
_LAYOUT = r"(?i)<(?:main|article|section|aside|nav|header|footer|form|div|table)\b[^>]*"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open one of these, up to the boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Elements that never hold main text; a form does where it's wrapped round the page's text.
NOT_CONTENT = frozenset("head nav footer aside form button select dialog svg canvas object audio video map datalist menu".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
CONTROLS = frozenset("input button select textarea form".split())
#: Words that stand for parts that aren't content, and words that may stand beside them in a class or id name.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation "
    "notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar skip social sponsor sponsored toolbar tracking widget".split()
)
#: Such parts only with a control in them, or where their text is template.
SOFT = frozenset("login signup register subscribe subscription newsletter feedback".split())
FILLERS = frozenset("article articles area bar block body bottom box button buttons container content count entry fixed form global group header holder inner item items left link links list main outer page panel post posts right section site slot text thread title top unit user wrap wrapper zone".split())

NEVER, MARKED, PERHAPS, SITE_HEADER = 1, 2, 3, 4


def _mark(names: str) -> int:
    """What a class or id attribute says: a name counts if it's made of the known words alone."""
    found = 0
    for name in names.split():
        parts = {x for x in re.split(r"[_\-\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if x}
        if parts & (MARKS | SOFT) and parts <= MARKS | SOFT | FILLERS:
            found = MARKED if parts & MARKS else found or PERHAPS
    return found


class Node:
    __slots__ = ("tag", "label", "parts", "kids", "kind", "size", "sign", "depth")

    def __init__(self, tag: str, attributes: str, depth: int):
        self.tag, self.depth = tag, depth
        self.parts: list = []  # text and nodes in order
        self.kids: list[Node] = []
        self.label = tag
        self.kind = NEVER if tag in NOT_CONTENT else 0
        if attributes and not attributes.isspace():
            self._attributes(attributes)

    def _attributes(self, raw: str) -> None:
        for name, value in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), value.strip("\"'")
            if name == "class" and value:
                self.label = f"{self.tag}.{re.sub(r'[0-9]+', '#', value.lower())}"
            if name in ("class", "id") and self.tag not in ("html", "body", "main", "article"):
                self.kind = self.kind or _mark(value)
            elif name == "hidden" or name == "style" and "display:none" in value.lower().replace(" ", "") or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
                self.kind = NEVER

    def text(self) -> str:
        """The node's own text, without its children's."""
        return " ".join("".join(x for x in self.parts if type(x) is str).split())


class _Ends:
    """Where tags end whose quotes don't all close; every quote is looked at once, however many tags ask."""

    def __init__(self, html: str):
        self.html, self.known, self.next = html, {}, (0, -1)

    def _special(self, at: int) -> int:
        lo, hit = self.next
        if not (lo <= at and (at <= hit or hit < 0 and lo)):
            m = _SPECIAL.search(self.html, at)
            self.next = (max(at, 1), m.start() if m else -1)
        return self.next[1]

    def __call__(self, at: int) -> int:
        """The place of the > that ends the tag, outside quotes if possible; -1 if there's none."""
        path, i = [], at
        while True:
            j = self._special(i)
            if j < 0 or self.html[j] == ">" or j in self.known:
                end = self.known.get(j, j) if j >= 0 else -1
                break
            path.append(j)
            close = self.html.find(self.html[j], j + 1)
            if close < 0:
                end = -1
                break
            i = close + 1
        for j in path:
            self.known[j] = end
        return end if end >= 0 else self.html.find(">", at)


def parse(html: str) -> Node:
    root = Node("#page", "", 0)
    stack, at, begin, size = [root], 0, 0, len(html)
    last, ends = html.rfind(">"), None
    places: dict[str, list[int]] = {}  # of open elements in the stack, by tag

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def close(tags, borders) -> None:
        """Closes the innermost open element of the tags, unless a border is open within it."""
        k = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if k and k > max((places[t][-1] for t in borders if places.get(t)), default=0):
            cut(k)

    def text(to: int) -> None:
        if to > begin:
            stack[-1].parts.append(unescape(html[begin:to]))

    while 0 <= (lt := html.find("<", at)) < last:
        if html.startswith("<!--", lt) or html.startswith("<![CDATA[", lt):
            text(lt)
            mark, skip = ("-->", 4) if html[lt + 2] == "-" else ("]]>", 9)
            end = html.find(mark, lt + skip)
            if skip == 9:
                stack[-1].parts.append(html[lt + 9 : end if end >= 0 else size])
            begin = at = end + 3 if end >= 0 else size
            continue
        if html[lt + 1] in "!?":
            text(lt)
            begin = at = html.find(">", lt) + 1
            continue
        m = _TAG.match(html, lt) if ends is None else None
        if m:
            closing, tag, attributes, end = m[1], m[2], m[3], m.end()
        elif m := _NAME.match(html, lt):
            ends = ends or _Ends(html)
            stop = ends(m.end())
            closing, tag, attributes, end = m[1], m[2], html[m.end() : stop], stop + 1
        else:
            at = lt + 1
            continue
        text(lt)
        begin = at = end
        tag = tag.lower()
        if closing:
            if held := places.get(tag):
                cut(held[-1])
            continue
        if tag in CLOSES_P and places.get("p"):
            close(("p",), ("td", "th", "button", "caption", "object", "table"))
        if tag in CLOSES:
            close(*CLOSES[tag])
        node = Node(tag, attributes, len(stack))
        stack[-1].parts.append(node)
        stack[-1].kids.append(node)
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if tag in ("title", "textarea"):
                node.parts.append(unescape(html[at : m.start() if m else size]))
            stop = html.find(">", m.end()) if m else -1
            begin = at = stop + 1 if stop >= 0 else size
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    # what stands after the last >
    if (tail := html.find("<!--", max(begin, last))) >= 0:
        size = tail
    text(size)
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Sizes and signatures of all subtrees, and the kinds that depend on what stands in or beside an element."""
    for node in reversed(list(preorder(root))):
        node.size = 1 + sum(k.size for k in node.kids)
        node.sign = hash((node.label, *[k.sign for k in node.kids]))
        beside = {k.tag for k in node.kids}
        for k in node.kids:
            if k.tag == "header" and not k.kind and (node.tag in ("#page", "html", "body") or node.tag not in ("article", "section", "main") and beside & {"nav", "footer", "main", "article", "aside"}):
                k.kind = SITE_HEADER
            elif k.tag == "form" and k.kind == NEVER and (tags := [x.tag for x in preorder(k)]) and ({"article", "main", "h1"} & set(tags) or tags.count("p") >= 3):
                k.kind = 0
            elif k.kind == PERHAPS and any(x.tag in CONTROLS for x in preorder(k)):
                k.kind = MARKED


def preorder(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(node.kids)


# --- simple tree matching --------------------------------------------------------------------------


def _best(a: list[Node], b: list[Node], memo: dict) -> list[tuple[int, int]]:
    """Indices of the matched children, in order, that match most nodes."""
    weight = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    own = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x.label == y.label:
                own[i, j] = matched_nodes(x, y, memo)
        row = weight[i, :-1] + own[i]
        weight[i + 1, 1:] = np.maximum.accumulate(np.maximum(weight[i, 1:], row))
    out, i, j = [], len(a), len(b)
    while i and j:
        if weight[i, j] == weight[i - 1, j]:
            i -= 1
        elif weight[i, j] == weight[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def _pairs(a: list[Node], b: list[Node], memo: dict) -> list[tuple[Node, Node]]:
    """Matched children. Equal subtrees at either end match as they are, which loses no match."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo].sign == b[lo].sign:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi].sign == b[-1 - hi].sign:
        hi += 1
    out = list(zip(a[:lo], b[:lo]))
    left, right = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if left and right:
        if len(left) * len(right) <= CELLS:
            out += [(left[i], right[j]) for i, j in _best(left, right, memo)]
        else:
            out += [(left[i], right[j]) for i, j in _best_wide(left, right, memo)]
    if hi:
        out += zip(a[-hi:], b[-hi:])
    return out


def _best_wide(a: list[Node], b: list[Node], memo: dict) -> list[tuple[int, int]]:
    """As many nodes as _best finds, in memory of one row and the pairs of distinct subtrees: a is halved, and b where both
    halves together match most."""
    classes = {x.sign: x for x in b}
    place = {sign: k for k, sign in enumerate(classes)}
    kind = np.array([place[x.sign] for x in b])
    own: dict = {}
    for x in a:
        if x.sign not in own:
            own[x.sign] = np.array([matched_nodes(x, y, memo) if x.label == y.label else 0 for y in classes.values()])

    def last_row(left: list[Node], kinds: np.ndarray) -> np.ndarray:
        weight = np.zeros(len(kinds) + 1, np.int64)
        for x in left:
            weight[1:] = np.maximum.accumulate(np.maximum(weight[1:], weight[:-1] + own[x.sign][kinds]))
        return weight

    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        if k - i <= 1 or (k - i) * (m - j) <= CELLS:
            if k > i and m > j:
                if k - i == 1:
                    at = j + int(np.argmax(own[a[i].sign][kind[j:m]]))
                    out += [(i, at)] if own[a[i].sign][kind[at]] else []
                else:
                    out += [(i + x, j + y) for x, y in _best(a[i:k], b[j:m], memo)]
            continue
        half = (i + k) // 2
        cut = j + int(np.argmax(last_row(a[i:half], kind[j:m]) + last_row(a[half:k][::-1], kind[j:m][::-1])[::-1]))
        todo += [(half, k, cut, m), (i, half, j, cut)]
    return out


def matched_nodes(a: Node, b: Node, memo: dict) -> int:
    """Nodes of the largest top-down match of two trees with equal labels."""
    if a.sign == b.sign:
        return a.size
    key = (a.sign, b.sign)
    if key not in memo:
        total = 1
        for x, y in _pairs(a.kids, b.kids, memo):
            total += matched_nodes(x, y, memo)
        memo[key] = total
    return memo[key]


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """All matched pairs of nodes of two pages."""
    memo: dict = {}
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo += _pairs(x.kids, y.kids, memo)
    return out


# --- the wrapper of a host --------------------------------------------------------------------------

_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure li dd dt".split())
_HEADINGS = frozenset("h1 h2 h3".split())


def _skipped(node: Node) -> bool:
    return node.kind in (NEVER, MARKED, SITE_HEADER)


def _loose(root: Node) -> Iterator[tuple[Node, Node | None, int]]:
    """(node, parent, characters of its own text that isn't in links) of all nodes that may be content, in page order."""
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while todo:
        node, parent, linked = todo.pop()
        linked = linked or node.tag == "a"
        yield node, parent, 0 if linked else len(node.text())
        todo += [(k, node, linked) for k in reversed(node.kids) if not _skipped(k)]


def _regions(root: Node, own: dict[int, float]) -> list[Node]:
    """The smallest elements that hold nearly all of the text; own: each node's own text, by id."""
    nodes = list(preorder(root))
    mass: dict[int, float] = {}
    for node in reversed(nodes):
        n = own.get(id(node), 0.0) + sum(mass[id(k)] for k in node.kids)
        mass[id(node)] = n * ARTICLE_WEIGHT if node.tag == "article" else n
    node = root
    while node.tag != "article":
        kids = [k for k in node.kids if mass[id(k)] > 0 and k.tag not in INLINE]
        total = own.get(id(node), 0.0) + sum(mass[id(k)] for k in node.kids)
        if not kids:
            break
        best = max(kids, key=lambda k: mass[id(k)])
        blocks = [k for k in kids if k.tag in _BLOCK]
        inline = total - sum(mass[id(k)] for k in kids)
        if best.tag in _BLOCK or any(k.tag in _HEADINGS for k in blocks) or inline + sum(mass[id(k)] for k in blocks) >= 0.05 * total:
            break
        if mass[id(best)] < REGION_SHARE * total:
            return [k for k in kids if mass[id(k)] >= 0.1 * total]
        node = best
    return [node]


class Template:
    """A seed page, its nodes numbered in page order, and what the host's pages say of them."""

    def __init__(self, html: str, votes: list[dict] | None = None):
        self.root = parse(html)
        self.nodes = list(preorder(self.root))
        self.number = {id(n): i for i, n in enumerate(self.nodes)}
        self.texts = [n.text() for n in self.nodes]
        self.constant: list[bool] = [False] * len(self.nodes)
        mass = {}
        for v in votes or ():
            self.constant[v["node"]] = v["matched"] > LEAST_PAGES - 1e-6 and v["same"] >= LEAST_SHARE * v["matched"] - 1e-6
            if v["mass"]:
                mass[id(self.nodes[v["node"]])] = v["mass"]
        self.regions: list[Node] = _regions(self.root, mass) if mass else []

    def votes(self, page: Node) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(matched, same, characters of varying text) of each node; None from a copy of the seed."""
        matched, same, mass = (np.zeros(len(self.nodes)) for _ in range(3))
        place: dict[int, int] = {}
        for mine, theirs in align(self.root, page):
            i = place[id(theirs)] = self.number[id(mine)]
            matched[i] = 1
            same[i] = self.texts[i] == theirs.text()
        every, nearest = 0, {}
        for node, parent, n in _loose(page):
            i = place.get(id(node))
            fixed = i is not None and same[i]
            nearest[id(node)] = i if i is not None else nearest[id(parent)]
            every += n
            if n and not fixed:
                mass[nearest[id(node)]] += n
        if mass.sum() < LEAST_CHANGE * every or not every:
            return None
        return matched, same, mass

    def apply(self, page: Node) -> tuple[list[Node], set[int]]:
        """(the page's nodes that stand at the template's regions, ids of its nodes that hold template text)."""
        if not self.regions:
            return [], set()
        wanted = {id(r) for r in self.regions}
        found, fixed, placed = [], set(), set()
        for mine, theirs in align(self.root, page):
            placed.add(id(theirs))
            i = self.number[id(mine)]
            if self.constant[i] and self.texts[i] and self.texts[i] == theirs.text():
                fixed.add(id(theirs))
            if id(mine) in wanted:
                found.append(theirs)
        # one more article than the seed has
        labels = {r.label for r in found if r.tag == "article"}
        if labels:
            hit = {id(r) for r in found}
            extra = lambda node: [k for k in node.kids if id(k) not in placed and k.label in labels and not k.kind]
            parents = [n for n in preorder(page) if any(id(k) in hit for k in n.kids)]
            found += [k for n in parents for k in extra(n)]
        return found, fixed


def best_template(templates: list[Template], layouts: list[int], layout: int, page: Node) -> Template | None:
    """The seed of the page's layout, or the one that it matches best."""
    if layout in layouts:
        return templates[layouts.index(layout)]
    if len(templates) < 2:
        return templates[0] if templates else None
    return max(templates, key=lambda t: matched_nodes(t.root, page, {}) / (t.root.size + page.size))


def _inner(nodes: list[Node], fixed: set[int]) -> str:
    """Text of the nodes in page order; blocks are set apart by a space."""
    out: list[str] = []

    def walk(n: Node) -> None:
        inline = n.tag in INLINE
        if not inline:
            out.append(" ")
        for x in n.parts:
            if type(x) is str:
                if id(n) not in fixed:
                    out.append(x)
            elif not (_skipped(x) or x.kind == PERHAPS and fixed and all(id(y) in fixed or not y.text() for y in preorder(x))):
                walk(x)
        if not inline:
            out.append(" ")

    for node in nodes:
        walk(node)
    return " ".join("".join(out).split())


def main_text(html: str, templates: list[Template] = (), layouts: list[int] = (), layout: int = 0) -> str:
    page = parse(html)
    template = best_template(list(templates), list(layouts), layout, page)
    regions, fixed = template.apply(page) if template else ([], set())
    if not regions:
        own = {id(node): n for node, _, n in _loose(page) if n and id(node) not in fixed}
        if not own:  # links alone
            own = {id(node): len(node.text()) for node, _, _ in _loose(page) if node.text()}
        regions = _regions(page, own)
    hit = {id(r) for r in regions}
    regions = [n for n in preorder(page) if id(n) in hit] if len(regions) > 1 else regions
    text = _inner(regions, fixed)
    whole = _inner(regions, set()) if fixed else text
    return text if 2 * len(text) >= len(whole) else whole  # what holds most of the content isn't template


# --- Spark ------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def layout_of(html: Column) -> Column:
    """A hash of the kinds of container elements that a page has, numbers in their names aside."""
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(_LAYOUT), F.lit(0))))
    return F.xxhash64(F.regexp_replace(F.lower(F.array_join(tags, " ")), "[0-9]+", "#"))


class _Wrappers:
    """The templates of hosts, a bounded number of them at a time."""

    def __init__(self, most: int = 2000):
        self.held: dict = {}
        self.most = most

    def get(self, host: str, seeds: list[dict] | None) -> tuple[list[Template], list[int]]:
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            own = list(seeds or [])
            self.held[host] = ([Template(x["html"], x.get("votes")) for x in own], [x["layout"] for x in own])
        return self.held[host]


def _with_seeds(pages: DataFrame, seeds: DataFrame, size: int, host: str, out: str):
    """(pages with each one's seeds as `out`, or nothing added and the seeds of all hosts in a broadcast variable)."""
    if size > BROADCAST_BYTES:
        return pages.join(seeds.select(F.col("host").alias(f"{host}x"), F.col("seeds").alias(out)), F.col(host) == F.col(f"{host}x"), "left").drop(f"{host}x"), None
    every = {r["host"]: r["seeds"] for r in (x.asDict(recursive=True) for x in seeds.collect())}  # behind the check
    return pages, pages.sparkSession.sparkContext.broadcast(every)


def _seed_rows(batch: pa.RecordBatch, host: str, out: str, held) -> Iterator[tuple[str, list[dict] | None]]:
    """(host, its seeds) of each row."""
    hosts = batch.column(host).to_pylist()
    if held is not None:
        return ((h, held.value.get(h)) for h in hosts)
    seeds = batch.column(out)
    return ((h, _Lazy(seeds, r)) for r, h in enumerate(hosts))


class _Lazy:
    """A row's seeds, read when the host isn't known yet."""

    def __init__(self, column: pa.Array, row: int):
        self.column, self.row = column, row

    def __iter__(self):
        return iter(self.column[self.row].as_py() or [])


def _sent(keys: DataFrame) -> DataFrame:
    """A written table of keys, sent to all tasks if its checked rows allow, so that the pages needn't move to meet it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def induce_wrappers(pages: DataFrame, url_col: str, html_col: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """((host, seeds: layout, html, votes) and their bytes): the wrappers of every host, from all its pages."""
    html = F.col(f"`{html_col}`")
    base = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), html.alias("html")).where("html is not null and html != ''")
    base = base.withColumns({"layout": layout_of(F.col("html")), "h": F.xxhash64("html")})
    counts = scratch.keep(base.groupBy("host", "layout", "h").agg(F.count("*").alias("copies")), "counts")
    by_layout = counts.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min("h").alias("h"))
    # a limit by group, of which every task keeps only SEEDS rows before the exchange
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "layout"))
    key = F.xxhash64("host", "layout", "h").alias("key")
    chosen = scratch.keep(by_layout.withColumn("rank", rank).where(F.col("rank") <= SEEDS).select(key), "chosen")
    base = base.withColumn("key", key)
    seeds = base.join(_sent(chosen), "key", "left_semi").groupBy("host", "layout").agg(F.min("html").alias("html"))
    seeds = scratch.keep(seeds, "seeds")
    size = seeds.agg(F.sum(F.octet_length("html") + 64)).first()[0] or 0
    per_host = seeds.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("layout", "html"))).alias("seeds"))  # SEEDS at most
    repeated = scratch.keep(counts.where("copies > 1").groupBy(key).agg(F.max("copies").alias("copies")), "repeated")
    voters = base.join(_sent(repeated), "key", "left").select("host", "html", "layout", (1 / F.coalesce("copies", F.lit(1))).alias("weight"))
    voters, held = _with_seeds(voters, per_host, size, "host", "seeds")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers, sums, n = _Wrappers(), {}, 0
        names = ["host", "layout", "node", "matched", "same", "mass"]

        def flush():
            hosts, layouts, nodes, rest = [], [], [], []
            for (host, layout), total in sums.items():
                on = np.flatnonzero(total[0])
                hosts += [host] * len(on)
                layouts += [layout] * len(on)
                nodes.append(on)
                rest.append(total[:, on])
            rest = np.concatenate(rest, axis=1) if rest else np.zeros((3, 0))
            columns = [pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(np.concatenate(nodes) if nodes else [], pa.int32()), *map(pa.array, rest)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            rows = zip(_seed_rows(batch, "host", "seeds", held), *(batch.column(c).to_pylist() for c in ("html", "layout", "weight")))
            for (host, own), html, layout, weight in rows:
                page = parse(html)
                template = best_template(*wrappers.get(host, own), layout, page)
                found = template.votes(page) if template else None
                if found is None:
                    continue
                key = (host, layouts_of(wrappers, host, template))
                if key not in sums:
                    sums[key] = np.zeros((3, len(template.nodes)))
                    n += len(template.nodes)
                sums[key] += weight * np.stack(found)
            if n > VOTES:
                yield flush()
                sums, n = {}, 0
        yield flush()

    votes = voters.mapInArrow(vote, "host string, layout long, node int, matched double, same double, mass double")
    votes = votes.groupBy("host", "layout", "node").agg(*(F.sum(c).alias(c) for c in ("matched", "same", "mass")))
    votes = votes.groupBy("host", "layout").agg(F.array_sort(F.collect_list(F.struct("node", "matched", "same", "mass"))).alias("votes"))  # a page's nodes
    told = seeds.join(votes, ["host", "layout"], "left").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("layout", "html", F.coalesce("votes", F.array().cast("array<struct<node:int,matched:double,same:double,mass:double>>")).alias("votes")))).alias("seeds"))
    told = scratch.keep(told, "wrappers")
    scratch.drop("counts", "seeds", "chosen", "repeated")
    return told, 4 * size


def layouts_of(wrappers: _Wrappers, host: str, template: Template) -> int:
    templates, layouts = wrappers.held[host]
    return layouts[templates.index(template)]


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """pages with `out_col`: the main text of the whole html, white space collapsed, blocks joined by a space.

    A null or empty html gives the empty text, and so does a page without content.  Pages without a url form one host.  A
    host's only page, and pages that are copies of each other, are judged by their own text; from two different pages on the varying text
    decides.  Copies count as one page.  Repeated pages give one row each; other columns, null or not, stay as they are.  A column
    named `out_col` is replaced.
    """
    left = [c for c in pages.columns if c.lower() != out_col.lower()]
    scratch = Scratch(pages.sparkSession, "wrappers")
    wrappers, size = induce_wrappers(pages, url_col, html_col, scratch)
    host, layout, seeds = free_names(pages.columns, "host", "layout", "seeds")
    kept = pages.select(*[F.col(f"`{c}`") for c in left], host_of(F.col(f"`{url_col}`")).alias(host), layout_of(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))).alias(layout))
    schema = T.StructType([pages.schema[c] for c in left] + [T.StructField(out_col, T.StringType())])
    kept, held = _with_seeds(kept, wrappers, size, host, seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Wrappers()
        for batch in batches:
            rows = zip(_seed_rows(batch, host, seeds, held), batch.column(html_col).to_pylist(), batch.column(layout).to_pylist())
            texts = [main_text(html, *known.get(name, own), kind) if html else "" for (name, own), html, kind in rows]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in left] + [pa.array(texts, pa.string())], schema.names)

    return kept.mapInArrow(run, schema)


def to_pandas_pairs(a: str, b: str) -> pd.DataFrame:
    """The alignment of two pages as a table, for inspection."""
    return pd.DataFrame([(x.label, x.text(), y.label, y.text()) for x, y in align(parse(a), parse(b))], columns=["left", "left_text", "right", "right_text"])
