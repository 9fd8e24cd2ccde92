"""HTML extraction by wrapper induction.

Pages become trees of labelled block elements; neighbours with one label count as one repeated
node. Pages of a host are aligned by simple tree matching into a template: nodes whose text is
the same on every page are constant, the others are slots. The wrapper's content node is the deepest one
that still holds most of the varying text and every varying heading and paragraph outside menus and the like. A page's text is that of
the blocks in its content node, without boilerplate elements and without constant containers there;
headings and paragraphs of an article stay even where a host's pages agree on them.

Templates are partial results of fixed shape: each task folds the pages it reads, host by host, and
the parts of a host are then folded in two rounds, so a host with a third of all pages is no hot
group. A host whose template outgrows NODES nodes is dealt by the shape of its pages into four times as many parts, each with a template of
its own, until none is too large: no node is left out, and no task holds more than one such template. Templates up to `limit` bytes in all are sent to the executors, beyond that they are joined by host.

Defined results: null and empty html give an empty text. A page without a host, or the only page of its host, is
extracted by element names alone, and so is a page whose content node is not found. Repeated pages
are extracted alike. Broken markup is read as far as it goes, in time linear in the page; unclosed comments, scripts and tags go to the end of the page.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Half of what a template may hold before its host is dealt into more parts.
NODES = 50_000
#: Template nodes that a task holds before it sends on what there is.
HELD_NODES = 400_000
LIMIT = 64 << 20
SHARE = 0.6

# Elements of HTML by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp", "svg", "math", "object", "canvas"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "head", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "search",
}
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption", "tr", "tbody", "caption"}
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
PEERS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
PEERS |= {t: ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("tbody", "thead", "tfoot")}
BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "search", "head", "fieldset", "label"}
BOILER_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "footer",
    "comment", "comments", "respond", "replies", "reply", "disqus", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login",
    "pagination", "pager", "widget", "toolbar", "skip", "copyright", "header", "topbar", "form", "search", "navigation", "contentinfo", "complementary", "hidden",
}
HEADERS = {"header"}
#: Of these words, those that tell of boilerplate also as a part of a compound name within an article; others are common in names of content, such as side-by-side.
STRONG_WORDS = {
    "advert", "advertisement", "adverts", "advertising", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "comment", "comments", "respond", "replies", "disqus",
    "newsletter", "subscribe", "signup", "sidebar", "breadcrumb", "breadcrumbs", "pagination", "navbar", "popup", "modal",
}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?]")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true)|(?:^|\s)style\s*=\s*(?:"[^"]*display\s*:\s*none|'[^']*display\s*:\s*none)""", re.I)
#: Values other than those that say something about hiding, which must not be searched for attribute names.
VALUE = re.compile(r"""(?<![\w-])(?!style|hidden|aria-hidden)([\w:-]+)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z0-9]+")
NAME = re.compile(r"[^\s]+")


@dataclass
class Page:
    """Nodes of a page (label, parent, boilerplate) and its blocks (node, text) in page order."""

    labels: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    boiler: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    @property
    def shape(self) -> str:
        return "|".join(f"{p}>{lab}" for p, lab in zip(self.parents, self.labels, strict=True))

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.labels]
        for k, p in enumerate(self.parents):
            if p >= 0:
                out[p].append(k)
        return out


def parse(html: str) -> Page:
    """Read a page in one pass, closing elements as HTML does."""
    page = Page()
    last: list[dict[str, int]] = [{}]  # of each node: its latest child, by label
    newest: list[int] = [-1]  # of each node: its latest child
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # open elements: tag, node, text is left out, within an article
    open_: Counter[str] = Counter()
    text: list[str] = []

    def flush() -> None:
        if text:
            words = unescape("".join(text)).split()
            text.clear()
            if words:
                page.blocks.append((stack[-1][1], " ".join(words)))

    def close(k: int) -> None:
        if any(t[0] in BLOCKS for t in stack[k:]):
            flush()
        open_.subtract(t[0] for t in stack[k:])
        del stack[k:]

    def push(tag: str, node: int, out: bool, inside: bool) -> None:
        stack.append((tag, node, out, inside))
        open_[tag] += 1

    def end_of(at: int) -> int:
        """Place of the > that ends a tag, not within quotes unless these are not closed; -1 if there is none. Looks at each byte once or twice."""
        start = at
        while mark := MARK.search(html, at):
            if mark[0] == ">":
                return mark.start()
            close_at = -1 if mark[0] in lost else html.find(mark[0], mark.end())
            if close_at < 0:
                lost.add(mark[0])  # nor is it found further on
                return html.find(">", start)
            at = close_at + 1
        return -1

    lost: set[str] = set()
    at = 0
    while True:
        m = TAG.search(html, at)
        if not stack[-1][2]:
            text.append(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
            continue
        end = end_of(at) if m[2] else html.find(">", at)
        if end < 0:  # a tag that does not end is left out, as browsers do
            break
        rest, at = html[at:end], end + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag or (tag not in BLOCKS and stack[i][0] in BLOCKS)), 0) if open_[tag] else 0
            if k and stack[k][0] == tag:  # what is no block does not close one
                close(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) if not rest.endswith("/") else None
            at = end.end() if end else (at if rest.endswith("/") else len(html))
            continue
        if tag in ("br", "hr", "wbr"):
            if tag == "hr":
                flush()
            elif tag == "br" and not stack[-1][2]:
                text.append(" ")
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and open_["p"]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
            if k:
                close(k)
        if tag in PEERS:
            peers, until = PEERS[tag]
            k = len(stack) - 1 if any(open_[t] for t in peers) else 0
            while k > 0 and stack[k][0] not in until:
                if stack[k][0] in peers:
                    close(k)
                k -= 1
        names = " ".join((a[1] or a[2] or a[3]).lower() for a in ATTRIBUTE.findall(rest)) if rest else ""
        inside = stack[-1][3]
        words = set(WORD.findall(names))
        if inside:  # whole names count, and of the parts of compound ones only the telling ones
            words = set(NAME.findall(names)) | (words & (STRONG_WORDS | HEADERS))
        boiler = tag in BOILER_TAGS or bool(words & BOILER_WORDS) or tag in HEADERS or bool(rest and HIDDEN.search(VALUE.sub(" ", rest)))
        if tag in ("html", "body", "article", "main") or (inside and (tag in HEADERS or words & HEADERS) and not words & (BOILER_WORDS - HEADERS)):
            boiler = False
        if tag not in BLOCKS:
            if rest.endswith("/"):
                continue
            push(tag, stack[-1][1], stack[-1][2] or boiler, inside)
            continue
        flush()
        parent = stack[-1][1]
        label = (f"{tag}.{names}" if names and tag not in TEXT_BLOCKS else tag) + "!" * boiler  # what is left out is not one with a neighbour that stays
        node = last[parent].get(label, -1)
        if node < 0 or node != newest[parent]:  # a new node, unless the neighbour before has the same label
            node = len(page.labels)
            page.labels.append(label)
            page.parents.append(parent)
            page.boiler.append(boiler or page.boiler[parent])
            last[parent][label] = newest[parent] = node
            last.append({})
            newest.append(-1)
        if not (tag == "p" and rest.endswith("/")):
            push(tag, node, stack[-1][2], inside or tag in ("article", "main"))
    flush()
    return page


def heaviest(left: list[int], right: list[int], left_labels: list[str], right_labels: list[str], size: dict[tuple[int, int], int]) -> tuple[int, dict[int, int]]:
    """The matching of children in order with most nodes below it: one more than their number, and the left child of each matched right one.

    Only pairs of equal labels are looked at; the best matching that ends before a place comes from a tree of maxima, so the time is that of
    the pairs, times a logarithm.
    """
    at: dict[str, list[int]] = {}
    for i, x in enumerate(left):
        at.setdefault(left_labels[x], []).append(i)
    n = len(left)
    tree: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # of places up to k: the most nodes, and the step that reached them
    steps: list[tuple[int, int, int]] = []  # left place, right node, step before
    for y in right:
        for i in reversed(at.get(right_labels[y], ())):  # so that no right child is matched twice in a row
            weight = size.get((left[i], y), 0)
            if not weight:
                continue
            most, before, k = 0, -1, i
            while k > 0:
                if tree[k][0] > most:
                    most, before = tree[k]
                k -= k & -k
            steps.append((i, y, before))
            k = i + 1
            while k <= n:
                if tree[k][0] < most + weight:
                    tree[k] = (most + weight, len(steps) - 1)
                k += k & -k
    most, step, k = 0, -1, n
    while k > 0:
        if tree[k][0] > most:
            most, step = tree[k]
        k -= k & -k
    own: dict[int, int] = {}
    while step >= 0:
        i, y, step = steps[step]
        own[y] = left[i]
    return most + 1, own


class Template:
    """A host's template: nodes with label, parent, pages seen, a text hash while all pages agree, and text lengths."""

    def __init__(self) -> None:
        self.labels, self.parents, self.boiler = [""], [-1], [False]
        self.seen, self.same, self.chars, self.pages, self.widest = [0], [0], [0], 0, 0
        self.kids: list[list[int]] = [[]]
        self.maps: dict[str, list[int]] = {}

    def add_node(self, label: str, parent: int, boiler: bool) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.boiler.append(boiler)
        for values in (self.seen, self.same, self.chars):
            values.append(0)
        self.kids.append([])
        self.kids[parent].append(len(self.labels) - 1)
        return len(self.labels) - 1

    def align(self, labels: list[str], kids: list[list[int]], boiler: list[bool], grow: bool) -> list[int]:
        """Simple tree matching: the template's node for each node of a tree (-1: none, unless it may grow)."""
        # pairs of nodes with equal labels whose parents are such a pair, parents first
        pairs, found = [(0, 0)], {(0, 0)}
        for a, b in pairs:
            by_label: dict[str, list[int]] = {}
            for x in self.kids[a]:
                by_label.setdefault(self.labels[x], []).append(x)
            for y in kids[b]:
                for x in by_label.get(labels[y], ()):
                    if (x, y) not in found:
                        found.add((x, y))
                        pairs.append((x, y))
        size: dict[tuple[int, int], int] = {}
        chosen: dict[tuple[int, int], dict[int, int]] = {}
        for a, b in reversed(pairs):
            size[a, b], chosen[a, b] = heaviest(self.kids[a], kids[b], self.labels, labels, size)
        out = [-1] * len(labels)
        out[0] = 0
        for b in range(len(labels)):  # parents come before their children
            a = out[b]
            if a < 0:
                continue
            own = chosen.get((a, b), {})
            for y in kids[b]:
                if y in own:
                    out[y] = own[y]
                elif grow:
                    out[y] = self.add_node(labels[y], a, boiler[y])
        return out

    def where(self, page: Page, grow: bool) -> list[int]:
        shape = page.shape
        if shape not in self.maps:
            if len(self.maps) > 2000:
                self.maps.clear()
            self.maps[shape] = self.align(page.labels, page.children(), page.boiler, grow)
        return self.maps[shape]

    def _count(self, node: int, seen: int, same: int, chars: int) -> None:
        if not self.seen[node]:
            self.same[node] = same
        elif self.same[node] != same:
            self.same[node] = -1  # varies
        self.seen[node] += seen
        self.chars[node] += chars

    def add_page(self, page: Page) -> None:
        place = self.where(page, True)
        texts: dict[int, list[str]] = {}
        for node, text in page.blocks:
            texts.setdefault(node, []).append(text)
        for node in range(len(page.labels)):
            text = "\n".join(texts.get(node, ()))
            self._count(place[node], 1, zlib.crc32(text.encode()), len(text))
        self.pages += 1
        self.widest = max(self.widest, len(page.labels))

    def add_template(self, other: Template) -> None:
        place = self.align(other.labels, other.kids, other.boiler, True)
        for node, at in enumerate(place):
            self._count(at, other.seen[node], other.same[node], other.chars[node])
        self.pages += other.pages
        self.widest = max(self.widest, other.widest)
        self.maps.clear()

    def full(self, nodes: int = NODES) -> bool:
        """Whether there are too many nodes, and more than two pages can have."""
        return len(self.labels) > 2 * max(nodes, self.widest)

    def dump(self) -> str:
        return json.dumps([self.pages, self.widest, self.labels, self.parents, self.boiler, self.seen, self.same, self.chars], separators=(",", ":"))

    @staticmethod
    def load(text: str) -> Template:
        t = Template()
        t.pages, t.widest, t.labels, t.parents, t.boiler, t.seen, t.same, t.chars = json.loads(text)
        t.kids = [[] for _ in t.labels]
        for k, p in enumerate(t.parents):
            if p >= 0:
                t.kids[p].append(k)
        return t

    def content(self) -> int:
        """The deepest node with most of the varying text (of all text where nothing varies), and all of its headings and paragraphs; never within an article."""
        own = mass = [0] * len(self.labels)
        for varying in (True, False):
            own = [0 if self.boiler[k] or (varying and self.pages > 1 and self.same[k] >= 0) else self.chars[k] for k in range(len(self.labels))]
            mass = own[:]
            for k in range(len(mass) - 1, 0, -1):
                mass[self.parents[k]] += mass[k]
            if mass[0]:
                break
        prose = [int(m > 0 and label.split(".")[0] in PROSE) for m, label in zip(own, self.labels, strict=True)]
        for k in range(len(prose) - 1, 0, -1):
            prose[self.parents[k]] += prose[k]
        at = 0
        while self.labels[at].split(".")[0] not in ("article", "main"):
            best = max(self.kids[at], key=lambda k: mass[k], default=-1)
            if best < 0 or mass[best] < SHARE * mass[at] or not mass[best] or self.labels[best].split(".")[0] in TEXT_BLOCKS or prose[best] < prose[at]:
                break
            at = best
        return at

    def constant(self, node: int) -> bool:
        """Whether a node is part of the template: a container that holds the same text on each of several pages."""
        return self.pages >= 3 and self.seen[node] >= 3 and self.same[node] >= 0 and self.labels[node].split(".")[0] not in TEXT_BLOCKS


def by_names(page: Page) -> str:
    """Text of the article or main element if there is one, else of all that is not boilerplate."""
    roots = [k for k, label in enumerate(page.labels) if label.split(".")[0] == "article"] or [k for k, label in enumerate(page.labels) if label.split(".")[0] == "main"] or [0]
    return _collect(page, set(roots), lambda node: False)


def _collect(page: Page, roots: set[int], left_out) -> str:
    inside = [False] * len(page.labels)
    for k, p in enumerate(page.parents):
        inside[k] = (k in roots or (p >= 0 and inside[p])) and not page.boiler[k]
    return "\n\n".join(text for node, text in page.blocks if inside[node] and not left_out(node))


def extract(page: Page, template: Template | None) -> str:
    """Main text of a page under its host's template."""
    if template is None or template.pages < 2:
        return by_names(page)
    place = template.where(page, False)
    root = template.content()
    roots = {k for k, at in enumerate(place) if at == root}
    text = _collect(page, roots, lambda node: place[node] >= 0 and place[node] != root and template.constant(place[node])) if root and roots else ""
    return text or by_names(page)


def host_column(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def part_of(page: Page, parts: int) -> int:
    """The part of its host that a page belongs to."""
    return zlib.crc32(page.shape.encode()) % parts if parts > 1 else 0


def fold(templates: DataFrame, keys: list[str], nodes: int = NODES) -> DataFrame:
    """Fold the templates that share `keys` into one; null where it is full."""
    schema = templates.select(*keys, "template").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None

        def out() -> pa.RecordBatch:
            made = None if own is None else own.dump()
            return pa.RecordBatch.from_arrays([*[pa.array([v]) for v in now], pa.array([made], pa.string())], [*keys, "template"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "template")), strict=True):
                if row[:-1] != now:
                    if now is not None:
                        yield out()
                    now, own = row[:-1], Template()
                if own is None:
                    continue
                if row[-1] is not None:
                    own.add_template(Template.load(row[-1]))
                if row[-1] is None or own.full(nodes):
                    own = None
        if now is not None:
            yield out()

    return templates.select(*keys, "template").repartition(*keys).sortWithinPartitions(*keys, "template").mapInArrow(run, schema)


def _partial(rows: DataFrame, parts: int, salts: int) -> DataFrame:
    """(host, part, salt, template) of (host, html): what tasks make of the pages they read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[str, int], Template] = {}

        def out() -> pa.RecordBatch:
            made = [t.dump() for t in own.values()]
            salt = [zlib.crc32(m.encode()) % salts for m in made]
            columns = [pa.array([h for h, _ in own], pa.string()), pa.array([k for _, k in own], pa.int64()), pa.array(salt, pa.int64()), pa.array(made, pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["host", "part", "salt", "template"])

        held = 0
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if host and html:
                    page = parse(html)
                    template = own.setdefault((host, part_of(page, parts)), Template())
                    held -= len(template.labels)
                    template.add_page(page)
                    held += len(template.labels)
                    if held > HELD_NODES:
                        yield out()
                        own.clear()
                        held = 0
        yield out()

    return rows.mapInArrow(run, "host string, part long, salt long, template string")


def induce(pages: DataFrame, salts: int = 32, nodes: int = NODES) -> DataFrame:
    """(host, parts, part, template) from all pages, written; a host has as many parts as keep its templates from being full."""
    rows, made, parts = pages.select(host_column().alias("host"), "html"), None, 1
    while True:
        folded = fold(fold(_partial(rows, parts, salts), ["host", "part", "salt"], nodes), ["host", "part"], nodes)
        own = materialize(folded.withColumn("parts", F.lit(parts)), "templates")
        full = own.where("template IS NULL").select("host").distinct()
        if full.isEmpty():
            return own if made is None else made.unionByName(own)
        kept = own.join(full, "host", "left_anti")
        made = kept if made is None else made.unionByName(kept)
        rows, parts = rows.join(full, "host", "left_semi"), 4 * parts


def extract_pages(pages: DataFrame, limit: int = LIMIT, nodes: int = NODES) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    templates = induce(pages, nodes=nodes)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_column().alias("host"))
    size = templates.agg(F.coalesce(F.sum(F.length("template")), F.lit(0))).first()[0]
    names = ["page_id", "url", "text", "n_chars"]

    def rows_of(batch: pa.RecordBatch, template_of) -> pa.RecordBatch:
        read = [parse(html) if html else None for html in batch.column("html").to_pylist()]
        texts = [extract(page, template_of(k, page)) if page else "" for k, page in enumerate(read)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    schema = "page_id long, url string, text string, n_chars long"
    if size <= limit:
        got = templates.select("host", "parts", "part", "template").toArrow().to_pydict()
        by_host: dict[str, tuple[int, dict[int, str]]] = {}
        for host, parts, part, template in zip(*got.values(), strict=True):
            by_host.setdefault(host, (parts, {}))[1][part] = template
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded: dict[tuple[str, int], Template] = {}

            def of(host: str, page: Page) -> Template | None:
                if host not in shared.value:
                    return None
                parts, texts = shared.value[host]
                key = host, part_of(page, parts)
                if key not in loaded and key[1] in texts:
                    loaded[key] = Template.load(texts[key[1]])
                return loaded.get(key)

            for batch in batches:
                hosts = batch.column("host").to_pylist()
                yield rows_of(batch, lambda k, page, hosts=hosts: of(hosts[k], page))

        return rows.mapInArrow(run, schema)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [part_of(parse(html), n) if html and n else 0 for html, n in zip(batch.column("html").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "url", "html", "host")], pa.array(own, pa.int64())], ["page_id", "url", "html", "host", "part"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("template").to_pylist()
            loaded = {t: Template.load(t) for t in set(texts) if t}
            yield rows_of(batch, lambda k, page, texts=texts, loaded=loaded: loaded.get(texts[k]))

    several = templates.where("parts > 1").select("host", "parts").distinct()
    if several.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url", "html", "host")}
        rows = rows.join(several, "host", "left").mapInArrow(dealt, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", part long")
    return rows.join(templates.select("host", "part", "template"), ["host", "part"], "left").mapInArrow(joined, schema)
