"""Main text of web pages by wrapper induction.

1. Pages are parsed into trees of block elements. Runs of like siblings (list items, paragraphs, rows) are one
   node, labels are element names alone, and a tree has at most ``NODES`` nodes and ``DEPTH`` levels: what is deeper
   or beyond belongs to the last node that has its place. Texts are always whole.
2. Different trees of a host are aligned by simple tree matching and merged into the host's template. Equal trees
   count once, so a template is as large as the structure of the host's pages, not as their number or their classes.
3. Every page is aligned with its host's template, and texts are counted by template node over all different pages.
   A text that more than half of the pages with its place have, and ``SUPPORT`` at least, is constant: template.
   What varies is content.
4. The host's content region is the deepest container that most pages have and that holds most of the varying text
   outside links: from the root down, the child with two thirds of it. Of a page that has the region, its blocks are
   the main text, with headings that stand beside the way to it, but for constant ones and nodes of links.

Marks break ties: what the markup itself marks as no part of an article (navigation, adverts, comments, forms and so
on) counts for nothing when the region is chosen and is dropped. A host with one page, or a page without its host's
region, has the text of its article or main element, or else all that is not marked.

Pages of equal texts are copies, and count as one different page. Templates merge in groups of ``GROUPS``, so
that no task sees all trees of a host. The result depends on the set of a host's pages, but for ties between
alignments, which the order of trees by their hash settles.

Results: null html is empty and has an empty text; text before or after a broken tag counts as text; a page
without a url belongs to the host ''. Repeated pages give a row each. Extra columns are not read.
"""

from __future__ import annotations

import base64
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_batches, written

#: Different pages that have a constant text, at least.
SUPPORT = 3
#: Bounds of a tree, and of the children that a node keeps apart by place.
NODES, DEPTH, PLACES = 1000, 48, 48
#: Trees of a host are dealt into so many groups first.
GROUPS = 64
#: Bytes of templates that may be broadcast.
BROADCAST_BYTES = 16_000_000
#: The part of a container's varying text that a child needs to be the region instead.
MOST = 2 / 3

#: Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext textarea title".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
ITEMS = frozenset("blockquote dd dt figure h1 h2 h3 h4 h5 h6 li option p pre td th tr".split())
DROPPED = frozenset("head script style noscript template nav aside footer header form button select textarea input iframe svg math object canvas dialog menu xmp noembed noframes title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id that mark what is no part of an article.
MARKS = frozenset("ad ads advert advertisement advertisements adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Open elements that a start tag closes.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th"}
CLOSES |= dict.fromkeys(BLOCK - {"br", "html", "head", "body", "option", "caption", "tr", "td", "th", "thead", "tbody", "tfoot", "legend", "summary", "title", "select"} - CLOSES.keys(), "p")
CLOSES = {name: frozenset(closed.split()) for name, closed in CLOSES.items()}
SCOPES = frozenset("html body table article section main div ul ol dl form td th aside nav header footer blockquote".split())

TOKEN = re.compile(r"""<!--.*?-->|<!--.*|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
#: Labels of nodes: the root, other elements that are no blocks, and blocks.
LABELS = ["#", "?", *sorted(BLOCK)]
LABEL = {name: n for n, name in enumerate(LABELS)}
ITEM_LABELS, HEADING_LABELS = frozenset(LABEL[n] for n in ITEMS), frozenset(LABEL[n] for n in HEADINGS)


class Tree:
    """Labels and parents of nodes; node 0 is the root and parents come before their children."""

    def __init__(self, labels: list[int] | None = None, parents: list[int] | None = None):
        self.labels, self.parents = labels or [0], parents or [-1]
        self.children: list[list[int]] = [[] for _ in self.labels]
        for node, parent in enumerate(self.parents[1:], 1):
            self.children[parent].append(node)

    def add(self, parent: int, label: int, place: int | None = None) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.children.append([])
        self.children[parent].insert(len(self.children[parent]) if place is None else place, len(self.labels) - 1)
        return len(self.labels) - 1

    def order(self) -> list[int]:
        """Nodes by their places: each before its children, and these from the first to the last."""
        order, todo = [], [0]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += reversed(self.children[node])
        return order

    def packed(self) -> bytes:
        """Labels and parents, with nodes numbered by their places."""
        order = self.order()
        new = {node: place for place, node in enumerate(order)} | {-1: -1}
        return np.array([[self.labels[n] for n in order], [new[self.parents[n]] for n in order]], np.int16).tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Tree:
        labels, parents = np.frombuffer(data, np.int16).reshape(2, -1).tolist()
        return Tree(labels, parents)


class _Builder(Tree):
    """The tree of a page while it is read: an element finds its node among its parent's."""

    def __init__(self):
        super().__init__()
        self.depth = [0]
        #: For each node, the place after that of the child opened last.
        self.cursor = [0]

    def open(self, parent: int, label: int) -> int:
        children, at = self.children[parent], self.cursor[parent]
        # An item may be one more of a run; other elements stand after the one before. Of a node that is opened
        # once more, as by the next item of a run, the children are those that it has.
        start = max(0, at - 1) if label in ITEM_LABELS else at
        found = next((n for n in range(start, len(children)) if self.labels[children[n]] == label), None)
        if found is None and (len(children) >= PLACES or len(self.labels) >= NODES):
            found = next((n for n, child in enumerate(children) if self.labels[child] == label), None)
        if found is None:
            if len(self.labels) >= NODES or self.depth[parent] >= DEPTH:
                return parent
            found = len(children)
            self.depth.append(self.depth[parent] + 1)
            self.cursor.append(0)
            self.add(parent, label)
        self.cursor[parent] = found + 1
        node = children[found]
        self.cursor[node] = 0
        return node


class Block:
    __slots__ = ("text", "node", "dropped", "region", "outside")

    def __init__(self, text: str, node: int, dropped: bool, region: int, outside: int):
        self.text, self.node, self.dropped, self.region, self.outside = text, node, dropped, region, outside

    @property
    def key(self) -> int:
        return _key(self.text)


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _marked(attributes: str, name: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is dropped, and whether it is a main region."""
    dropped, main = name in DROPPED, name == "main"
    if name == "header" and inside:
        dropped = False
    if attributes and not attributes.isspace():
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html.unescape(value.strip("\"'"))
            if key in ("class", "id"):
                if name not in ("html", "body", "main") and MARKS.intersection(w.lower() for w in WORDS.split(value)):
                    dropped = True
            elif key == "role":
                main = main or value == "main"
                dropped = dropped or value in ROLES
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value):
                dropped = True
    return dropped, main


def parse(source: str | None) -> tuple[Tree, list[Block]]:
    """The tree of a page's block elements and its blocks of text in order."""
    source = source or ""
    tree, blocks, parts = _Builder(), [], []
    linked, opened = 0, Counter()
    # Open elements: name, node, dropped, region (2 article, 1 main, 0 none).
    stack: list[tuple[str, int, bool, int]] = [("#", 0, False, 0)]

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                _, node, dropped, region = stack[-1]
                blocks.append(Block(text, node, dropped, region, max(0, len(text) - linked)))
        linked = 0

    def close(depth: int) -> None:
        opened.subtract(s[0] for s in stack[depth:])
        del stack[depth:]

    at, stop = 0, source.rfind(">") + 1
    while at < stop:
        found = TOKEN.search(source, at, stop)
        if not found:
            break
        if found.start() > at:
            parts.append(source[at : found.start()])
            if opened["a"]:
                linked += found.start() - at
        at = found.end()
        name = found[2]
        if not name:
            if found[0].startswith("<![CDATA["):
                parts.append(html.escape(found[0][9:-3]))
            continue
        name = name.lower()
        if found[1]:
            if name in BLOCK:
                end_block()
            if not opened[name]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if stack[-1][2] != stack[depth - 1][2]:
                        end_block()
                    close(depth)
                    break
                if stack[depth][0] in SCOPES and name not in SCOPES:
                    break
            continue
        if name in BLOCK:
            end_block()
        if (closes := CLOSES.get(name)) and any(opened[c] for c in closes):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in closes:
                    close(depth)
                    break
                if stack[depth][0] in SCOPES and stack[depth][0] not in closes:
                    break
        if name in VOID:
            continue
        _, parent, parent_dropped, region = stack[-1]
        dropped, main = _marked(found[3], name, region > 0)
        if name in HEADINGS and stack[-1][0] == "header" and region:
            dropped = parent_dropped
        elif region and stack[-1][0] == "header":
            dropped = True
        dropped = dropped or parent_dropped
        if dropped != parent_dropped:
            end_block()
        region = 2 if name == "article" else max(region, int(main))
        node = parent
        if name in BLOCK or dropped != parent_dropped:
            node = tree.open(parent, LABEL.get(name, 1))
        if name in RAW:
            ends = re.compile(rf"</{name}", re.I).search(source, at)
            at = ends.start() if ends else stop
            if name in DROPPED:
                end = source.find(">", at) if ends else -1
                at = end + 1 if end >= 0 else len(source)
                continue
        if found[3].endswith("/") and name not in BLOCK:
            continue
        stack.append((name, node, dropped, region))
        opened[name] += 1
    if max(at, stop) < len(source):
        tail = source[max(at, stop) :]
        broken = tail.find("<")
        parts.append(tail if broken < 0 or not re.match(r"<[a-zA-Z/!?]", tail[broken:]) else tail[:broken])
    end_block()
    return tree, blocks


# --- alignment


def match(a: Tree, b: Tree, x: int, y: int, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two subtrees: the largest number of node pairs that keeps labels, parents and order, and the pairs of children."""
    if a.labels[x] != b.labels[y]:
        return 0, []
    if (x, y) in memo:
        return memo[x, y]
    rows, columns = a.children[x], b.children[y]
    m, n = len(rows), len(columns)
    if not m or not n:
        memo[x, y] = 1, []
        return memo[x, y]
    weight = [[match(a, b, p, q, memo)[0] for q in columns] for p in rows]
    score = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        above, row, own = score[i - 1], score[i], weight[i - 1]
        for j in range(1, n + 1):
            row[j] = max(above[j], row[j - 1], above[j - 1] + own[j - 1])
    pairs, i, j = [], m, n
    while i and j:
        if weight[i - 1][j - 1] and score[i][j] == score[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((rows[i], columns[j]))
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    memo[x, y] = score[m][n] + 1, pairs[::-1]
    return memo[x, y]


def align(template: Tree, tree: Tree) -> list[int]:
    """For each node of a tree the template's node, or -1. Trees are no deeper than ``DEPTH``, so recursion is bounded."""
    found, todo, memo = [-1] * len(tree.labels), [(0, 0)], {}
    while todo:
        x, y = todo.pop()
        found[y] = x
        todo += match(template, tree, x, y, memo)[1]
    return found


def merge(template: Tree, tree: Tree) -> Tree:
    """The template with a tree: nodes of the tree alone go beside their siblings while there is room."""
    found = align(template, tree)
    todo = [0]
    while todo:
        node = todo.pop()
        home, place = found[node], 0
        for child in tree.children[node]:
            todo.append(child)
            if found[child] >= 0:
                place = template.children[home].index(found[child]) + 1
            elif home >= 0 and len(template.labels) < NODES:
                found[child] = template.add(home, tree.labels[child], place)
                place += 1
    return template


class Plan:
    """What a host's template says: its tree, constant texts by slot, and the nodes whose text is kept."""

    def __init__(self, tree: Tree, stats: dict[int, tuple[int, int, int]], constants: set[tuple[int, int]]):
        """``stats``: node -> (different pages, varying characters outside links, varying characters)."""
        self.tree, self.constants = tree, constants
        size = len(tree.labels)
        own, mass = [stats.get(n, (0, 0, 0))[1] for n in range(size)], [0] * size
        for node in sorted(range(size), key=self._depths().__getitem__, reverse=True):
            mass[node] += own[node]
            if node:
                mass[tree.parents[node]] += mass[node]
        pages = stats.get(0, (0, 0, 0))[0]
        self.region, path = 0, [0]
        while True:
            inner = [n for n in tree.children[self.region] if tree.labels[n] not in ITEM_LABELS and 2 * stats.get(n, (0, 0, 0))[0] > pages]
            best = max(inner, key=lambda n: (mass[n], -n), default=None)
            if best is None or not mass[best] or mass[best] < MOST * mass[self.region]:
                break
            self.region = best
            path.append(best)
        self.known = pages > 1 and self.region > 0
        self.kept = set()
        if self.known:
            for above, below in zip(path, path[1:], strict=False):
                self.kept |= {n for n in tree.children[above][: tree.children[above].index(below)] if tree.labels[n] in HEADING_LABELS}
            todo = [self.region]
            while todo:
                node = todo.pop()
                self.kept.add(node)
                todo += tree.children[node]
        # Nodes that hold links in the main, on several pages.
        self.links = {n for n, (seen, outside, every) in stats.items() if seen >= SUPPORT and 2 * outside < every}
        self.slot = slots(tree)
        self.aligned: dict[bytes, list[int]] = {}

    def _depths(self) -> list[int]:
        depths, todo = [0] * len(self.tree.labels), [0]
        while todo:
            node = todo.pop()
            for child in self.tree.children[node]:
                depths[child] = depths[node] + 1
                todo.append(child)
        return depths

    def align(self, tree: Tree) -> list[int]:
        return aligned(self.aligned, self.tree, tree)


def aligned(known: dict[bytes, list[int]], template: Tree, tree: Tree) -> list[int]:
    """``align``, made once for trees with equal places; the table of what is known is bounded."""
    data = tree.packed()
    if data not in known:
        if len(known) >= 1000:
            known.clear()
        known[data] = align(template, Tree.unpacked(data))
    found = [-1] * len(tree.labels)
    for node, home in zip(tree.order(), known[data], strict=True):
        found[node] = home
    return found


def slots(template: Tree) -> list[int]:
    """For each node the first like sibling: constant texts are sought among like siblings together."""
    first: dict[tuple[int, int], int] = {}
    for children in template.children:
        for node in children:
            first.setdefault((template.parents[node], template.labels[node]), node)
    return [first.get((parent, label), node) for node, (parent, label) in enumerate(zip(template.parents, template.labels, strict=True))]


def main_text(source: str | None, plan: Plan | None = None, marks: bool = True) -> str:
    """The main text of a page by its host's plan; without ``marks``, what the markup says of itself is not heeded."""
    tree, blocks = parse(source)
    if not marks:
        for block in blocks:
            block.dropped, block.region = False, 0
    if plan is not None:
        home = plan.align(tree)
        slot = plan.slot
        fresh = [b for b in blocks if (node := home[b.node]) < 0 or (slot[node], b.key) not in plan.constants and node not in plan.links]
        if plan.known and any(node == plan.region for node in home):
            inside = [b for b in fresh if home[b.node] in plan.kept or home[b.node] < 0 and _under(tree, home, b.node, plan.kept)]
            return " ".join(b.text for b in inside if not b.dropped)
        blocks = fresh
    kept = [b for b in blocks if not b.dropped]
    region = max((b.region for b in kept), default=0)
    return " ".join(b.text for b in kept if b.region >= region)


def _under(tree: Tree, home: list[int], node: int, kept: set[int]) -> bool:
    """Whether the nearest node above that the template knows is kept."""
    while home[node] < 0:
        node = tree.parents[node]
    return home[node] in kept


# --- tables


def host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def shapes(pages: DataFrame) -> DataFrame:
    """``(host, identity, structure, blocks)`` of every page: its tree, and node, text hash and sizes of each block that is not marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            identities, structures, packs = [], [], []
            for source in batch.column(1):
                tree, blocks = parse(source.as_py())
                blocks = [b for b in blocks if not b.dropped]
                place = {node: n for n, node in enumerate(tree.order())}
                rows = np.array([(place[b.node], b.key, b.outside, len(b.text)) for b in blocks], np.int64).reshape(-1, 4)
                identities.append(_key("\n".join(b.text for b in blocks)))
                structures.append(tree.packed())
                packs.append(rows.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(identities, pa.int64()), pa.array(structures, pa.binary()), pa.array(packs, pa.binary())], ["host", "identity", "structure", "blocks"])

    return map_batches(pages.select(host().alias("host"), "html"), run, "host string, identity long, structure binary, blocks binary")


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Trees of equal keys merged; one template is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([held.packed()], pa.binary())], ["host", "structure"])

        for batch in batches:
            for *key, data in zip(*(batch.column(n).to_pylist() for n in range(batch.num_columns)), strict=True):
                tree = Tree.unpacked(data)
                if key == now:
                    merge(held, tree)
                else:
                    if now is not None:
                        yield row()
                    now, held = key, tree
        if now is not None:
            yield row()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, F.length("structure").desc(), "structure")
    return map_batches(dealt.select(*keys, "structure"), run, "host string, structure binary")


def induce(shaped: DataFrame) -> DataFrame:
    """``(host, structure)``: the template of every host."""
    different = shaped.select("host", "structure").distinct()
    return _fold(_fold(different.withColumn("part", F.pmod(F.xxhash64("structure"), F.lit(GROUPS))), ["host", "part"]), ["host"])


def _by_host(rows: DataFrame, side: DataFrame, fn: Callable[[list, object], list[tuple]], schema: str) -> DataFrame:
    """Rows (host first) mapped with what their host has in ``side (host, data)``, which is broadcast up to a checked size and joined beyond it.

    ``fn`` gets a row's values and its host's data, decoded once by ``fn.decode`` and kept in a bounded table, and makes rows.
    """
    size = side.agg(F.sum(F.length("data") + F.length("host"))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    shared = rows.sparkSession.sparkContext.broadcast({r.host: bytes(r.data) for r in side.collect()} if small else None)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, object] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for n, name in enumerate(columns[0]):
                if name not in known:
                    data = shared.value.get(name) if small else columns[-1][n]
                    if len(known) >= 256:
                        known.clear()
                    known[name] = None if data is None else fn.decode(data)
                out += fn([c[n] for c in (columns if small else columns[:-1])], known[name])
            kinds = [_KINDS[part.split()[1]] for part in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in enumerate(kinds)], names)

    return map_batches(rows if small else rows.join(side, "host", "left"), run, schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}


class _Counted:
    """Rows of a different page: its nodes and slots (no text), and its texts by node."""

    @staticmethod
    def decode(data: bytes) -> tuple:
        tree = Tree.unpacked(data)
        return tree, slots(tree), {}

    def __call__(self, row: list, found: tuple) -> list[tuple]:
        name, structure, blocks = row
        template, slot, known = found
        home = aligned(known, template, Tree.unpacked(structure))
        present = {node for node in home if node >= 0}
        out = [(name, node, node, None, 1, 0, 0) for node in present] + [(name, s, -1, None, 1, 0, 0) for s in {slot[node] for node in present}]
        seen = set()
        for node, text, outside, every in np.frombuffer(blocks, np.int64).reshape(-1, 4).tolist():
            if (node := home[node]) >= 0:
                out.append((name, slot[node], node, text, int((slot[node], text) not in seen), outside, every))
                seen.add((slot[node], text))
        return out


def plans(shaped: DataFrame) -> DataFrame:
    """``(host, data)``: the plan of every host, as JSON."""
    templates = written(induce(shaped), "templates")
    different = shaped.groupBy("host", "identity").agg(F.min(F.struct("structure", "blocks")).alias("page")).select("host", "page.structure", "page.blocks")
    rows = _by_host(different, templates.withColumnRenamed("structure", "data"), _Counted(), "host string, slot int, node int, text long, pages long, outside long, every long")
    counted = written(rows.groupBy("host", "slot", "node", "text").agg(*(F.sum(c).alias(c) for c in ("pages", "outside", "every"))), "page-texts")
    texts = counted.where("text is not null")
    seen = texts.groupBy("host", "slot", "text").agg(F.sum("pages").alias("seen")).where(F.col("seen") >= SUPPORT)
    places = counted.where("text is null and node = -1").select("host", "slot", F.col("pages").alias("places"))
    constants = written(seen.join(places, ["host", "slot"]).where("2 * seen > places").select("host", "slot", "text"), "constants")
    varying = texts.join(constants, ["host", "slot", "text"], "left_anti").groupBy("host", "node").agg(F.sum("outside").alias("outside"), F.sum("every").alias("every"))
    nodes = counted.where("text is null and node >= 0").select("host", "node", "pages").join(varying, ["host", "node"], "left")
    stats = nodes.groupBy("host").agg(F.sort_array(F.collect_list(F.array("node", "pages", F.coalesce("outside", F.lit(0)), F.coalesce("every", F.lit(0))))).alias("stats"))
    fixed = constants.groupBy("host").agg(F.sort_array(F.collect_list(F.array("slot", "text"))).alias("constants"))
    whole = templates.join(stats, "host").join(fixed, "host", "left")
    return whole.select("host", F.encode(F.to_json(F.struct(F.base64("structure").alias("tree"), "stats", "constants")), "utf-8").alias("data"))


class _Extracted:
    @staticmethod
    def decode(data: bytes) -> Plan:
        found = json.loads(data)
        return Plan(Tree.unpacked(base64.b64decode(found["tree"])), {n: (p, o, e) for n, p, o, e in found["stats"]}, {(s, t) for s, t in found.get("constants") or ()})

    def __init__(self, marks: bool):
        self.marks = marks

    def __call__(self, row: list, plan: Plan | None) -> list[tuple]:
        _, page_id, url, source = row
        text = main_text(source, plan, self.marks)
        return [(page_id, url, text, len(text))]


def extract(pages: DataFrame, marks: bool = True) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page; without ``marks`` by the template alone."""
    plan = written(plans(written(shapes(pages), "shapes")), "plans")
    rows = pages.select(host().alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return _by_host(rows, plan, _Extracted(marks), "page_id long, url string, text string, n_chars long")
