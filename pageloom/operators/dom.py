"""Trees of HTML pages and the node table.

The tokenizer is the standard library's; the tree rules are those of a plain
stack: no end tag is implied, an end tag closes up to the nearest open tag of
its name and is ignored without one, void elements never stay open. A
character reference counts without its semicolon too, unless a caller wants
closed ones only. A page becomes rows
``(pre, last, parent, depth, sib, kind, tag, attrs, text)`` in which a subtree
is the interval ``[pre, last]``, so "is within" is a comparison of numbers and
needs no tree.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Void elements; elements whose own text is not page text; elements that start a line of their own.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"}
HIDDEN_TEXT = {"script", "style", "template"}
MAX_PAGE_BYTES = 10 * 1024 * 1024
TOO_LARGE = "Article HTML exceeds 10 MiB."
_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def clean(text: str | None) -> str:
    """White space collapsed to single spaces, none at the ends."""
    return _SPACE.sub(" ", text or "").strip()


class Node:
    """A tag, a text or a comment."""

    __slots__ = ("kind", "tag", "attrs", "value", "parent", "children", "closed")

    def __init__(self, kind: str, tag: str = "", attrs: dict[str, str] | None = None, value: str = ""):
        self.kind, self.tag, self.attrs, self.value = kind, tag, attrs if attrs is not None else {}, value
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.closed = True  # False: no end tag of its own, so it holds all up to the end of what it is in

    # -- reading

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    @property
    def classes(self) -> list[str]:
        return self.get("class").split()

    def walk(self) -> Iterator[Node]:
        """All nodes below, in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def tags(self, *names: str) -> list[Node]:
        """Tags below, all or of the given names."""
        return [n for n in self.walk() if n.kind == "tag" and (not names or n.tag in names)]

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.kind == "tag" and n.tag in names), None)

    def where(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if n.kind == "tag" and test(n)]

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def within(self, other: Node) -> bool:
        return self is other or any(a is other for a in self.ancestors())

    def raw_text(self) -> str:
        """All text below, as it stands."""
        own = self.tag in HIDDEN_TEXT
        return "".join(n.value for n in self.walk() if n.kind == "text" and (own or n.parent.tag not in HIDDEN_TEXT))

    def text(self) -> str:
        """The visible strings below, each stripped, joined by one space, white space collapsed."""
        own = self.tag in HIDDEN_TEXT
        parts = (n.value.strip() for n in self.walk() if n.kind == "text" and (own or n.parent.tag not in HIDDEN_TEXT))
        return clean(" ".join(p for p in parts if p))

    def siblings_after(self) -> list[Node]:
        if self.parent is None:
            return []
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        return self.parent.children[at + 1 :]

    @property
    def attached(self) -> bool:
        node = self
        while node.parent is not None:
            node = node.parent
        return node.kind == "root"

    # -- changing

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, *nodes: Node) -> None:
        parent = self.parent
        if parent is None:
            return
        at = next(i for i, c in enumerate(parent.children) if c is self)
        for n in nodes:
            n.drop()
            n.parent = parent
        parent.children[at : at + 1] = nodes
        self.parent = None

    def unwrap(self) -> None:
        inner, self.children = self.children, []
        for n in inner:
            n.parent = None
        self.replace(*inner)

    def copy(self) -> Node:
        twin = Node(self.kind, self.tag, dict(self.attrs), self.value)
        twin.closed = self.closed
        for c in self.children:
            twin.append(c.copy())
        return twin

    # -- writing

    def html(self) -> str:
        out: list[str] = []
        _write(self, out)
        return "".join(out)

    def inner(self) -> str:
        out: list[str] = []
        for c in self.children:
            _write(c, out)
        return "".join(out)


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attribute(value: str) -> str:
    value = escape(value)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


def _write(root: Node, out: list[str]) -> None:
    stack: list[Node | str] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.kind == "text":
            out.append(node.value if node.parent is not None and node.parent.tag in HIDDEN_TEXT else escape(node.value))
        elif node.kind == "comment":
            out.append(f"<!--{node.value}-->")
        elif node.kind == "tag":
            attrs = "".join(f" {k}={_attribute(v)}" for k, v in sorted(node.attrs.items()))
            if node.tag in VOID and not node.children:
                out.append(f"<{node.tag}{attrs}/>")
            else:
                out.append(f"<{node.tag}{attrs}>")
                stack.append(f"</{node.tag}>")
                stack.extend(reversed(node.children))
        else:
            stack.extend(reversed(node.children))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root", "[document]")
        self.open = [self.root]
        self.held: list[str] = []

    def flush(self) -> None:
        if self.held:
            self.open[-1].append(Node("text", value="".join(self.held)))
            self.held = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = self.open[-1].append(Node("tag", tag, {k: " ".join((v or "").split()) if k == "class" else v or "" for k, v in attrs}))
        if tag not in VOID:
            node.closed = False
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.open[at].closed = True
                del self.open[at:]
                break

    def handle_data(self, data):
        self.held.append(data)

    def handle_comment(self, data):
        self.flush()
        self.open[-1].append(Node("comment", value=data))

    def handle_decl(self, decl):
        self.flush()
        self.open[-1].append(Node("declaration", value=decl))

    handle_pi = unknown_decl = handle_decl


def parse(html: str, open_references: bool = True) -> Node:
    """The tree of a page. Its root has the kind ``root``.

    Without ``open_references``, a reference that lacks its semicolon (``&amp``
    at the end of a text that was cut) is the text that it looks like.
    """
    html, mark = html or "", "\ufdd0\ufdd1"  # code points that no text should have; longer than any such run that one has
    if not open_references:
        while mark in html:
            mark = "\ufdd0" + mark
        html = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + (m[1] or ""), html)
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.flush()
    if not open_references and mark in html:
        for n in builder.root.walk():
            n.tag, n.value = n.tag.replace(mark, "&"), n.value.replace(mark, "&")
            n.attrs = {k.replace(mark, "&"): v.replace(mark, "&") for k, v in n.attrs.items()}
    return builder.root


class Layout:
    """The nodes of a tree in document order, with the interval of each: ``nodes[at(n)]`` to ``nodes[last(n)]`` is ``n`` and all below it."""

    def __init__(self, root: Node):
        self.nodes = [root, *root.walk()]
        self._at = {id(n): i for i, n in enumerate(self.nodes)}
        self._last = [*range(len(self.nodes))]
        for i in range(len(self.nodes) - 1, 0, -1):
            up = self._at[id(self.nodes[i].parent)]
            self._last[up] = max(self._last[up], self._last[i])

    def at(self, n: Node) -> int:
        return self._at[id(n)]

    def last(self, n: Node) -> int:
        return self._last[self._at[id(n)]]


class Zones:
    """A union of intervals of a layout."""

    def __init__(self, intervals):
        self.begin, self.end = [], []
        for a, z in sorted(intervals):
            if self.end and a <= self.end[-1] + 1:
                self.end[-1] = max(self.end[-1], z)
            else:
                self.begin.append(a)
                self.end.append(z)

    def hold(self, place: int) -> bool:
        at = bisect.bisect_right(self.begin, place) - 1
        return at >= 0 and place <= self.end[at]


NODE_SCHEMA = "pre int, last int, parent int, depth int, sib int, kind string, tag string, attrs map<string,string>, text string, hidden boolean"
_NODE = pa.struct(
    [("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("sib", pa.int32()), ("kind", pa.string()), ("tag", pa.string())]
    + [("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("hidden", pa.bool_())]
)


def rows(root: Node) -> list[dict]:
    """Node rows of a tree, in document order; the root is not one of them (parent -1)."""
    out: list[dict] = []
    stack = [(c, -1, 0, i) for i, c in reversed([*enumerate(root.children)])]
    open_: list[dict] = []
    while stack:
        node, parent, depth, sib = stack.pop()
        while len(open_) > depth:
            open_.pop()["last"] = len(out) - 1
        row = {
            "pre": len(out), "last": len(out), "parent": parent, "depth": depth, "sib": sib, "kind": node.kind, "tag": node.tag or None,
            "attrs": [*node.attrs.items()] if node.kind == "tag" else None,
            "text": node.value if node.kind != "tag" else None, "hidden": node.kind == "text" and node.parent.tag in HIDDEN_TEXT,
        }
        out.append(row)
        open_.append(row)
        stack.extend((c, row["pre"], depth + 1, i) for i, c in reversed([*enumerate(node.children)]))
    while open_:
        open_.pop()["last"] = len(out) - 1
    return out


def spread(rows: DataFrame) -> DataFrame:
    """Input with fewer partitions than there are cores is dealt out to all; larger input stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.isStreaming:
        return rows
    parts = rows._jdf.queryExecution().toRdd().getNumPartitions()  # of the plan as it is, with no conversion of rows
    return rows.repartition(cores) if parts < cores else rows


def nodes(pages: DataFrame, page_id: str = "page_id", html: str = "html", max_bytes: int = MAX_PAGE_BYTES, open_references: bool = True) -> DataFrame:
    """The node table of all pages of at most ``max_bytes``; the size filter runs before any Python does.

    Pages over the size, and null ones, have no nodes; :func:`left_out` tells
    which. ``open_references``: as in :func:`parse`.
    """
    fits = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).filter(F.octet_length("html") <= max_bytes)

    def explode(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # one page at a time: its rows are what is in memory
                found = rows(parse(batch.column("html")[at].as_py(), open_references))
                ids = batch.column("page_id").take(pa.array([at] * len(found), pa.int32()))
                table = pa.array(found, _NODE)
                yield pa.RecordBatch.from_arrays([ids, *table.flatten()], ["page_id", *(f.name for f in _NODE)])

    return spread(fits).mapInArrow(explode, f"page_id {fits.schema['page_id'].dataType.simpleString()}, {NODE_SCHEMA}")


def too_large(html: str, max_bytes: int = MAX_PAGE_BYTES):
    """Whether a page is over the size limit (null is not)."""
    return F.coalesce(F.octet_length(html) > max_bytes, F.lit(False))


def left_out(pages: DataFrame, page_id: str = "page_id", html: str = "html", max_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """``page_id, reason`` of the pages that :func:`nodes` gives no rows for."""
    reason = F.when(too_large(html, max_bytes), F.lit(TOO_LARGE)).when(F.col(html).isNull(), F.lit("The page is missing."))
    return pages.select(F.col(page_id).alias("page_id"), reason.alias("reason")).filter("reason is not null")
