"""Main text of web pages by site style trees.

Every page is read into a tree of elements.  The trees of a host are merged by path (names and numbers among equal
siblings): for each element the distinct pages that have it, the presentation styles (sequences of child elements)
and the contents seen there.  An element's importance is the larger of the normalised entropies of its styles and of
its contents - 0 where all pages of the site look and read the same, 1 where all differ.  Low importance is weighed with
what an element is (tag, role, a word of its name), where it stands (inside or around an article, beside one, how much
of the page it holds) and how much of it is link text; an element whose weights add up to less than zero is removed
from the page with its branch.  Every element of every page takes part, those in articles too: equal articles on the
pages of a host stay because they are articles, a list of links that all articles of a host end with goes.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.scratch import Scratch

#: Low-importance elements up to which their table is broadcast (some 60 bytes each); beyond, it is joined.
BROADCAST_NODES = 200_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[a-z]+")

# fixed values: element kinds of HTML
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title", "textarea", "select", "button", "audio", "video"}
OPAQUE = {"script", "style", "textarea", "title", "iframe", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
NOISE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "search", "head", "fieldset", "input"} | RAW
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
NOISE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "teaser", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "widget", "toolbar", "pagination", "pager"}
#: Elements that an open paragraph ends at, and elements closed by another of their group.
ENDS_P = BLOCK - {"body", "html", "head", "caption", "tbody", "thead", "tfoot", "tr", "legend", "dd", "dt"}
SIBLINGS = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dd": ("dd dt", {"dl"}), "dt": ("dd dt", {"dl"}), "tr": ("tr", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr"}), "th": ("td th", {"tr"}), "option": ("option", {"select"})}
TITLES = {"header", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that enter the tree besides blocks.
JUDGED = BLOCK | {"td", "th"}

#: Weights of an element, which goes if their sum is below zero: kinds by tag, role or hiding, kinds by a word of
#: its name, articles, elements around an article, what lies inside an article, what lies outside of one on a page that
#: has one, an element of a noise name or a form with more than half of the page's text, and low importance, with the
#: share of link text in it on top.
KIND, NAME, ARTICLE, HOLDS, INSIDE, OUTSIDE, MOST, LOW, LINKS = -4.0, -3.0, 3.0, 8.0, 2.5, -2.5, 4.5, -2.0, -2.0


class Node:
    """An element: its kind's weight, place in the tree, text and link text in it."""

    __slots__ = ("tag", "number", "path", "kind", "parent", "children", "kinds", "content", "size", "linked", "holds", "inside", "soft")

    def __init__(self, tag: str, number: int, path: int, kind: float, parent: Node | None, inside: bool, soft: bool):
        self.tag, self.number, self.path, self.kind, self.parent, self.inside, self.soft = tag, number, path, kind, parent, inside, soft
        self.children, self.kinds, self.content, self.size, self.linked, self.holds = [], {}, [], 0, 0, False


def _attributes(raw: str) -> dict[str, str]:
    out = {}
    for m in _ATTR.finditer(raw):
        out.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    return out


def _kind(tag: str, attrs: dict[str, str], inside_article: bool) -> float:
    if tag in NOISE_TAGS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return KIND
    role = attrs.get("role", "").lower()
    if tag in ("article", "main") or role == "main":
        return ARTICLE
    if (tag == "header" and not inside_article) or role in NOISE_ROLES:
        return KIND
    if tag not in ("html", "body", "p") and not (inside_article and tag in TITLES) and attrs and NOISE_WORDS.intersection(_WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())):
        return NAME
    return 0.0


class Page:
    """A page's elements (number of the parent, path, style and content as hashes, weight, share of link text) and its
    text in pieces (text, number of the element, number of the block), in page order."""

    def __init__(self, source: str):
        self.root = Node("", 0, 0, 0.0, None, False, False)
        self.nodes: list[Node] = [self.root]
        self.styles: list[tuple[int, int]] = [(0, 0)]
        self.pieces: list[list[str]] = []
        self.owners: list[Node] = []
        self.blocks: list[int] = []
        self.stack: list[Node] = []
        self.block = self.article = self.linked = 0
        self._read(source)
        while self.stack:
            self._pop()
        for node in reversed(self.nodes[1:]):  # children come after their parents
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.holds |= node.holds or node.kind == ARTICLE

    @property
    def _own(self) -> Node:
        return self.stack[-1] if self.stack else self.root

    def _say(self, text: str) -> None:
        """Text of the block in progress."""
        own = self._own
        own.content.append(text)
        if self.pieces and self.owners[-1] is own and self.blocks[-1] == self.block:
            self.pieces[-1].append(text)
        else:
            self.pieces.append([text])
            self.owners.append(own)
            self.blocks.append(self.block)
        n = len(text.strip())
        own.size += n
        if self.linked:
            own.linked += n

    def _open(self, tag: str, raw: str) -> None:
        attrs = _attributes(raw) if raw.strip(" /") else {}
        if tag in ENDS_P:
            self._close_to("p", ENDS_P - {"p"})
        if tag in SIBLINGS:
            names, limit = SIBLINGS[tag]
            for name in names.split():
                self._close_to(name, limit)
        name = tag
        if attrs.get("class") or attrs.get("id"):
            name = re.sub(r"\d+", "0", tag + "".join(f".{c}" for c in sorted(attrs.get("class", "").split())) + (f"#{attrs['id']}" if attrs.get("id") else ""))
        parent = self._own
        parent.children.append(name)
        number = parent.kinds[name] = parent.kinds.get(name, 0) + 1
        kind = _kind(tag, attrs, self.article > 0)
        node = Node(tag, len(self.nodes), _place(parent.path, name, number), kind, parent, self.article > 0, kind == NAME or tag == "form")
        self.nodes.append(node)
        self.styles.append((0, 0))
        self.stack.append(node)
        self.article += kind == ARTICLE
        self.linked += tag == "a"

    def _pop(self) -> None:
        node = self.stack.pop()
        self.article -= node.kind == ARTICLE
        self.linked -= node.tag == "a"
        content = _key("\n".join(node.content)) if node.content else 0
        if node.content:
            node.parent.content.append(str(content))
        self.styles[node.number] = (_style(" ".join(node.children)), content)

    def weights(self) -> tuple[list[float], list[float], list[bool]]:
        """Weight of each element before its importance and place count, what it loses if its importance is low, and
        whether it lies outside of the page's articles."""
        whole, has_article = self.root.size, self.root.holds
        base, low, out = [], [], []
        for n in self.nodes:
            w = n.kind
            if n.holds:
                w += HOLDS
            elif n.inside:
                w += INSIDE
            elif n.soft and 2 * n.size > whole and not has_article:
                w += MOST
            base.append(w)
            low.append(LOW + LINKS * n.linked / n.size if n.tag in JUDGED and n.size else 0.0)
            out.append(has_article and n is not self.root and not (n.holds or n.inside or n.kind == ARTICLE))
        return base, low, out

    def _close_to(self, tag: str, limit: set[str]) -> None:
        """Close the nearest open tag and all in it, unless an element of limit stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                if tag in BLOCK:
                    self.block += 1
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i].tag in limit:
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        for m in iter(lambda: _TOKEN.search(source, at), None):
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing = m[1] or m[4]
            if closing:
                if tag in BLOCK:
                    self.block += 1
                if tag in ("td", "th"):
                    self._say(" ")
                if any(x.tag == tag for x in self.stack):
                    limit = {"article", "main", "body"} if tag not in BLOCK else set()
                    for i in range(len(self.stack) - 1, -1, -1):
                        if self.stack[i].tag == tag:
                            while len(self.stack) > i:
                                self._pop()
                            break
                        if self.stack[i].tag in limit:
                            break
                continue
            if tag in ("br", "wbr"):
                self._say(" " if tag == "br" else "")
                continue
            if tag in BLOCK:
                self.block += 1
            elif tag in ("td", "th"):
                self._say(" ")
            if tag in VOID:
                if self.stack:
                    self.stack[-1].children.append(tag)
                continue
            if tag in OPAQUE:  # no markup inside: skipped up to its end tag, without a break in the block around
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                if self.stack:
                    self.stack[-1].children.append(tag)
                continue
            self._open(tag, m[3] or m[6] or "")
        if at < n:
            self._say(source[at:])
        self.block += 1


def texts(paths: list[int], base: list[float], loss: list[float], outside: list[bool], low: set[int], parents: list[int], pieces: list[str], owners: list[int], blocks: list[int]) -> str:
    """The text of a page: blocks in page order less the branches whose weight is below zero; elements whose paths are in low
    have low importance. Where that leaves nothing, text outside articles counts as much as any; where that leaves
    nothing either, only tags, roles and hiding decide."""

    def kept(weight) -> str:
        gone = [False] * len(paths)
        for i in range(1, len(paths)):
            gone[i] = gone[parents[i]] or weight(i) < 0
        out, at = [], 0
        while at < len(pieces):
            end, block = at, blocks[at]
            while end < len(pieces) and blocks[end] == block:
                end += 1
            text = " ".join(html.unescape("".join([pieces[i] for i in range(at, end) if not gone[owners[i]]])).split())
            if text:
                out.append(text)
            at = end
        return "\n\n".join(out)

    own = lambda i: base[i] + (loss[i] if paths[i] in low else 0.0)
    return kept(lambda i: own(i) + (OUTSIDE if outside[i] else 0.0)) or kept(own) or kept(lambda i: -1.0 if base[i] in (KIND, KIND + INSIDE) else 0.0)


def main_text(source: str, low: Iterable[int] = ()) -> str:
    """The main text of one page by itself."""
    p = parsed(source)
    return texts(p["paths"], p["base"], p["loss"], p["outside"], set(low), p["parents"], p["pieces"], p["owners"], p["blocks"])


@functools.lru_cache(1 << 16)
def _place(parent: int, name: str, number: int) -> int:
    return _key(f"{parent}>{name}:{number}")


@functools.lru_cache(1 << 14)
def _style(children: str) -> int:
    return _key(children)


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_LISTS = {"parents": pa.int32(), "paths": pa.int64(), "styles": pa.int64(), "contents": pa.int64(), "base": pa.float32(), "loss": pa.float32(), "outside": pa.bool_(), "pieces": pa.string(), "owners": pa.int32(), "blocks": pa.int32()}
_PARSED = "parents array<int>, paths array<bigint>, styles array<bigint>, contents array<bigint>, base array<float>, loss array<float>, outside array<boolean>, pieces array<string>, owners array<int>, blocks array<int>"


def parsed(source: str) -> dict[str, list]:
    page = Page(source)
    base, loss, outside = page.weights()
    return {
        "parents": [n.parent.number if n.parent else 0 for n in page.nodes], "paths": [n.path for n in page.nodes], "styles": [s for s, _ in page.styles], "contents": [c for _, c in page.styles],
        "base": base, "loss": loss, "outside": outside, "pieces": ["".join(p) for p in page.pieces], "owners": [n.number for n in page.owners], "blocks": page.blocks,
    }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns given, a hash of the page, its elements and its text."""
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            sources = [x or "" for x in part.column(part.num_columns - 1).to_pylist()]
            found = [parsed(s) for s in sources]
            columns = [*(part.column(c) for c in range(part.num_columns - 1)), pa.array([_key(s) for s in sources], pa.int64()), *(pa.array([f[n] for f in found], pa.list_(t)) for n, t in _LISTS.items())]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "page", *_LISTS])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            columns = [part.column(part.schema.get_field_index(n)).to_pylist() for n in ("paths", "base", "loss", "outside", "low", "parents", "pieces", "owners", "blocks")]
            out = [texts(p, b, loss, o, set(low or ()), *rest) for p, b, loss, o, low, *rest in zip(*columns)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, importance): the larger entropy of styles and of contents, to the base of the pages."""

    def entropy(by: str) -> DataFrame:
        each = nodes.groupBy("host", "path", by).agg(F.count(F.lit(1)).alias("c"))
        return each.groupBy("host", "path").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.ln("c")).alias("s")).select("host", "path", "pages", F.when(F.col("pages") > 1, F.try_divide(F.ln("pages") - F.col("s") / F.col("pages"), F.ln("pages"))).otherwise(1.0).alias(f"{by}_entropy"))

    both = entropy("style").join(entropy("content").drop("pages"), ["host", "path"])
    return both.select("host", "path", "pages", F.greatest("style_entropy", "content_entropy").alias("importance"))


def low_nodes(read: DataFrame, min_pages: int, threshold: float) -> DataFrame:
    """(host, path) of the elements of low importance in the merged tree of each host's distinct pages."""
    distinct = read.select("host", "page", "paths", "styles", "contents", "loss").dropDuplicates(["host", "page"])
    nodes = distinct.select("host", F.inline(F.arrays_zip(F.col("paths").alias("path"), F.col("styles").alias("style"), F.col("contents").alias("content"), "loss"))).where("loss < 0").drop("loss")
    return importance(nodes).where((F.col("pages") >= min_pages) & (F.col("importance") < threshold)).select("host", "path")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, threshold: float = 0.2, name: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of every page; "" if there is none or html is null.

    Character references are decoded, white space in a block becomes one space, blocks are joined in page order
    by two newlines.  Elements need min_pages distinct pages of their host for an importance; pages without a host
    share the empty one; equal pages of a host count once and get equal texts, repeated ids stay rows of their own.  A
    page of any length is read as a whole; what the other columns are called plays no part; an empty table gives no
    rows.  Importance at the threshold is not low.
    """
    scratch = Scratch(pages.sparkSession, name)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col).cast("string")).alias("host"), F.monotonically_increasing_id().alias("row"), F.col(html_col).cast("string").alias("html"))
    id_type = rows.schema["id"].dataType.simpleString()
    read = scratch.cut(rows.mapInArrow(_parse, f"id {id_type}, url string, host string, row bigint, page bigint, {_PARSED}"), "parsed", "zstd")
    low = scratch.cut(low_nodes(read, min_pages, threshold), "low")
    if low.count() <= BROADCAST_NODES:
        of_host = low.groupBy(F.col("host").alias("h")).agg(F.collect_set("path").alias("low"))
        out = read.join(F.broadcast(of_host), F.col("host") == F.col("h"), "left")
    else:  # by element, so that no host is gathered in one place
        each = read.select("row", "host", F.explode("paths").alias("path")).join(low, ["host", "path"]).groupBy(F.col("row").alias("r")).agg(F.collect_set("path").alias("low"))
        out = read.join(each, F.col("row") == F.col("r"), "left")
    out = out.select("id", "url", "parents", "paths", "base", "loss", "outside", "low", "pieces", "owners", "blocks").mapInArrow(_texts, f"id {id_type}, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
