"""Main text of web pages by the container path that the pages of a host agree on.

First pass: each page is parsed once into blocks of text with the chain of containers around them; every block
gives its text, less its links, to its container and half as much to each next one around that. The
containers of a page vote, in thousandths of the page's score, for their paths, in which classes and ids are
generalised (digits become ``#``). Spark adds the votes by (host, path), combined before the shuffle, and keeps
the best path of each host. Second pass: each page is extracted by its host's path, or where the page lacks
it, by its own best container; where the own one holds more text outside the host's path than that path holds,
both are told in the order of the page. Paths are compared by 64-bit hashes that run down the tree.

Menus, headers, footers, sidebars, forms, scripts and styles are left out by their tag, role and hiding attributes.
Words of a class or id are weak evidence: a name made of such words and layout words only marks adverts and reader
comments, which go unless nothing else is left, and menus, notices and the like, which go unless they hold more
than half of the page's text; a name that has such a word among others counts only for what is mostly links. Articles,
main parts and the body are never judged by their names.

Parsing, scoring and extraction are linear in the page, however deep it nests: what a block needs of its ancestors
is handed down or added up once for each container.

The winners are a written table of one row a host, joined by host: broadcast only if its size on disk is below
the planner's limit, else a join that adaptive execution can split for a host with many pages.

Defined results: null html has empty text; null URLs and those without a host vote together under the empty
host; pages without text have empty text; broken markup is read to its end; of paths with equal votes the one with the
smaller hash wins; repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import materialize
from .text import table
from .tokens import slices
from .urls import split_url

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "select", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that end a block of text where they start and end.
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Block tags that hold text rather than other blocks of an article.
LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "ul", "ol", "dl", "tr", "td", "th", "tbody", "thead", "table", "figcaption", "figure", "address", "caption", "summary", "hgroup"}
#: What a start tag of the key ends without an end tag, if it is open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
OFF_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "search", "button"}
OFF_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
#: Words that mark adverts and reader comments, and words that mark the rest around an article.
REMARK_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "commentlist", "disqus", "replies", "respond", "sponsor", "sponsored",
}
OFF_WORDS = {
    "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies",
    "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
    "recommended", "related", "search", "share", "sharing", "sidebar", "signup", "social", "subscribe", "subscription", "toolbar", "widget", "widgets",
}
#: Words that say where or how large something is, not what.
LAYOUT_WORDS = {
    "area", "bar", "block", "bottom", "box", "buttons", "col", "column", "container", "global", "icons", "inner", "item", "items", "js", "left", "links", "list", "main", "outer", "page", "panel",
    "post", "posts", "primary", "right", "section", "site", "slot", "small", "sub", "text", "thread", "top", "unit", "wrap", "wrapper",
}
#: Never judged by class or id.
TRUSTED = {"html", "body", "main", "article"}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: What the words of an element's names say: nothing; left out if it holds the smaller part; left out; left out if it is mostly links.
NOTHING, AROUND, REMARK, LINKS = range(4)


def _said(name: str, attrs: dict[str, str]) -> int:
    if name in TRUSTED:
        return NOTHING
    found = NOTHING
    for token in [*attrs.get("class", "").split(), attrs.get("id", "")]:
        words = {w.lower() for w in _WORDS.findall(token)}
        if not words.isdisjoint(REMARK_WORDS) or not words.isdisjoint(OFF_WORDS):
            whole = words <= REMARK_WORDS | OFF_WORDS | LAYOUT_WORDS
            new = (AROUND if words.isdisjoint(REMARK_WORDS) else REMARK) if whole else LINKS
            found = new if found in (NOTHING, LINKS) or new == REMARK else found
    return found


def _hidden(name: str, attrs: dict[str, str]) -> bool:
    return name not in ("html", "body") and bool("hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in OFF_ROLES or _HIDDEN.search(attrs.get("style", "")))


class Node:
    """An element: its place in page order, and what its descendants need of it."""

    __slots__ = ("box", "id", "label", "lift", "name", "off", "parent", "para", "path", "said")

    def __init__(self, ident: int, name: str, attrs: dict[str, str], parent: Node | None, depth: int):
        self.id, self.name, self.parent, self.said = ident, name, parent, NOTHING
        label = name
        if attrs:
            classes = sorted({_DIGITS.sub("#", c) for c in attrs.get("class", "").split()})
            label += "".join(f".{c}" for c in classes) or (f"#{_DIGITS.sub('#', attrs['id'])}" if attrs.get("id") else "")
            self.said = _said(name, attrs)
        self.label = label
        #: hash of the labels from the root on
        self.path = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), parent.path if parent else 0)
        self.off = bool(parent and parent.off) or name in OFF_TAGS or bool(attrs and _hidden(name, attrs))
        #: the innermost container, the outermost article or main, and where on the stack a paragraph is open
        self.box = parent.box if parent and name in LEAF else self
        self.lift = (parent.lift if parent else None) or (self if name in ("article", "main") else None)
        self.para = depth if name == "p" else 0 if name in BLOCK or not parent else parent.para


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" \t\r\n/") else {}


class Page:
    """A page's elements in page order, and its blocks (innermost element, text, characters within links) outside what is left out."""

    def __init__(self, page: str):
        self.nodes = [Node(0, "#page", {}, None, 0)]
        self.blocks: list[tuple[Node, str, int]] = []
        self._parse(page)
        self._judge()

    def _parse(self, page: str) -> None:
        stack, open_, held, linked, in_link = [self.nodes[0]], Counter(), [], 0, 0
        unclosed: set[str] = set()

        def flush() -> None:
            nonlocal held, linked
            if held:
                text = " ".join("".join(held).split())
                if text and not stack[-1].off:
                    self.blocks.append((stack[-1], text, min(linked, len(text))))
            held, linked = [], 0

        def cut(k: int) -> None:
            open_.subtract(x.name for x in stack[k:])
            del stack[k:]

        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            run = page[at : m.start() if m else n]
            if run:
                run = html.unescape(run)
                held.append(run)
                if in_link:
                    linked += len(run)
            if not m:
                break
            at = m.end()
            name = (m["name"] or m["name2"] or "").lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    held.append(m[0][9:].removesuffix("]]>"))
                continue
            end, attrs = bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
            if name in RAW and not end:
                closed = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                if closed:
                    at = closed.end()
                elif attrs.endswith("/"):
                    unclosed.add(name)
                else:
                    at = n
                continue
            if name == "a":
                in_link = 0 if end else 1
            if name == "br":
                held.append(" ")
            if name == "hr":
                flush()
            if name in VOID or (name not in BLOCK and name not in OFF_TAGS):
                parsed = _attributes(attrs) if attrs and not end and name not in VOID else {}
                # an inline element that may be left out counts as a container
                if not (parsed and (_hidden(name, parsed) or _said(name, parsed) in (AROUND, REMARK))) and not (end and open_[name] > 0):
                    continue
            if end:
                if open_[name] > 0:
                    flush()
                    k = len(stack) - 1
                    while stack[k].name != name:
                        k -= 1
                    cut(k)
                elif name in BLOCK:
                    flush()
                continue
            flush()
            in_link = 0
            if name in BLOCK:
                if stack[-1].para:
                    cut(stack[-1].para)
                ends = ENDS.get(name)
                while ends and stack[-1].name in ends:
                    cut(len(stack) - 1)
            if attrs.endswith("/") and name not in BLOCK:
                continue
            stack.append(Node(len(self.nodes), name, _attributes(attrs), stack[-1], len(stack)))
            self.nodes.append(stack[-1])
            open_[name] += 1
        flush()

    def _judge(self) -> None:
        """Leave out what the names mark, by the text that it holds."""
        if not any(x.said for x in self.nodes):
            return
        nodes, n = self.nodes, len(self.nodes)
        remark = [False] * n
        for x in nodes[1:]:
            remark[x.id] = remark[x.parent.id] or x.said == REMARK
        size, linked = [0] * n, [0] * n
        for node, text, link in self.blocks:
            if not remark[node.id]:
                size[node.id] += len(text)
                linked[node.id] += link
        for x in reversed(nodes[1:]):
            size[x.parent.id] += size[x.id]
            linked[x.parent.id] += linked[x.id]
        most, gone = (size[0] - linked[0]) / 2, remark
        for x in nodes[1:]:
            gone[x.id] = gone[x.id] or gone[x.parent.id]
            if x.said in (AROUND, LINKS) and size[x.id] - linked[x.id] <= most and (x.said == AROUND or 2 * linked[x.id] >= size[x.id]):
                gone[x.id] = True
        self.blocks = [b for b in self.blocks if not gone[b[0].id]] or self.blocks

    def scores(self) -> list[tuple[Node, float]]:
        """Containers with their scores above 0, best first."""
        own = [0.0] * len(self.nodes)
        for node, text, linked in self.blocks:
            own[node.box.id] += max(0, len(text) - 2 * linked)
        for x in reversed(self.nodes[1:]):
            if x.box is x:
                own[x.parent.box.id] += own[x.id] / 2
        found = ((x, own[x.id] * (1.25 if x.name in ("article", "main") else 1.0)) for x in self.nodes if own[x.id] > 0)
        return sorted(found, key=lambda x: (-x[1], x[0].id))

    def under(self, path: int) -> list[bool]:
        """Which blocks lie under the path."""
        inside = [False] * len(self.nodes)
        for x in self.nodes:
            inside[x.id] = x.path == path or (x.parent is not None and inside[x.parent.id])
        return [inside[node.id] for node, _, _ in self.blocks]

    def named(self, path: int | None) -> str | None:
        """The path in words, where the page has it."""
        x, out = next((x for x in self.nodes if x.path == path), None), []
        while x:
            out.append(x.label)
            x = x.parent
        return ">".join(reversed(out)) or None


def _best(node: Node) -> int:
    """The path of the outermost article or main around a container, or its own."""
    return (node.lift or node).path


def votes(page: str) -> list[tuple[int, int]]:
    """(path, thousandths of the page's score) of the page's containers, in so far as they have a thousandth."""
    best = Page(page).scores()
    total, out = sum(s for _, s in best), Counter()
    for node, score in best:
        out[_best(node)] += score
    return [(path, v) for path, score in out.items() if (v := round(1000 * score / total))]


def extract(page: str, path: int | None) -> str:
    """The text of a page."""
    return extracted(page, path)[0]


def extracted(page: str, path: int | None) -> tuple[str, str | None]:
    """(the text under the host's path, or under the page's own best container, or under both; the host's path in words)."""
    p = Page(page)
    best, found = p.scores(), p.blocks
    if not best:
        return "\n".join(t for _, t, _ in found), p.named(path)
    own = p.under(_best(best[0][0]))
    theirs = p.under(path) if path is not None else [False] * len(found)
    size = lambda use: sum(len(t) for (_, t, _), u in zip(found, use) if u)
    use = theirs if any(theirs) else own
    if use is theirs and size([o and not t for o, t in zip(own, theirs)]) > size(theirs):
        use = [o or t for o, t in zip(own, theirs)]
    return "\n".join(t for (_, t, _), u in zip(found, use) if u), p.named(path)


def host_paths(rows: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host; ties go to the smaller hash."""
    import pyarrow as pa

    def vote(batches):
        for batch in batches:
            for part in slices(batch):
                got = [(h, p - (1 << 63), v) for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()) for p, v in votes(page)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64())], ["host", "path", "votes"])

    cast = rows.select("host", "html").mapInArrow(vote, "host string, path long, votes long")
    summed = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return summed.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path"))["path"].alias("path"))


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, host_path (in words, where the page has it) for each row."""
    import pyarrow as pa

    rows = split_url(df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")), "url").drop("path")
    winners = materialize(host_paths(rows), "host-paths")

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                got = [extracted(page, None if path is None else path + (1 << 63)) for page, path in zip(part.column("html").to_pylist(), part.column("path").to_pylist())]
                texts, paths = pa.array([t for t, _ in got], pa.string()), pa.array([p for _, p in got], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), texts, pa.array([len(t) for t, _ in got], pa.int64()), paths], ["id", "url", "text", "n_chars", "host_path"])

    joined = rows.join(winners, "host", "left").select("id", "url", "html", "path")
    return joined.mapInArrow(run, "id long, url string, text string, n_chars long, host_path string").withColumnsRenamed({"id": id_col, "url": url_col})


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
