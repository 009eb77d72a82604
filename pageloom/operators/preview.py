"""Preview blocks of an article, what a reader selects of them, and the copy that is put together again."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.dom import Node, clean, parse
from pageloom.operators.rewrite import KEPT_TAGS, MATH_ATTRIBUTES, MATH_TAGS, absolute, is_renderer
from pageloom.plans.review import EXCLUDED

# Elements that are a preview block, that are dropped whole, and image types.
PREVIEW_TAGS = {"blockquote", "figure", "h1", "h2", "h3", "h4", "hr", "ol", "p", "pre", "table", "ul"}
DROPPED_TAGS = {"button", "embed", "form", "iframe", "input", "noscript", "object", "param", "script", "style", "svg", "textarea"}
IMAGE_SOURCE = re.compile(r"^data:image/(?:gif|jpe?g|png|svg\+xml|webp)(?:;[^,]*)?,", re.IGNORECASE)
_DISPLAY = re.compile(r"(?:^|[-_])display(?:$|[-_])", re.IGNORECASE)


def safe_image(source: str, base: str) -> str | None:
    """An inline image of a known type, or a web address."""
    source = source.strip()
    return source if IMAGE_SOURCE.match(source) else absolute(source, base) if source else None


def _display(n: Node, math: Node) -> bool:
    return n.get("display") == "true" or math.get("display") == "block" or any(_DISPLAY.search(c) for c in n.classes)


def preview_blocks(root: Node) -> list[list[Node]]:
    """Blocks in order: block elements, marked blocks and display formulas alone, runs of inline content together."""
    out: list[list[Node]] = []
    run: list[Node] = []

    def flush() -> None:
        if run:
            out.append([*run])
            run.clear()

    def visit(n: Node) -> None:
        if n.kind == "text":
            if n.value.strip():
                run.append(n)
        elif n.kind == "tag" and n.tag not in DROPPED_TAGS:
            math = n.first("math") if is_renderer(n) else None
            alone = EXCLUDED in n.attrs or n.tag in PREVIEW_TAGS or n.tag == "math" and n.get("display") == "block" or math is not None and _display(n, math)
            if alone:
                flush()
                out.append([n])
            elif n.tag in KEPT_TAGS or math is not None:
                run.append(n)
            else:
                for c in n.children:
                    visit(c)

    for c in root.children:
        visit(c)
    flush()
    return out


def safe_html(n: Node, base: str, images: bool = True, links: bool = True) -> str:
    """Markup of a node that may be shown: allowed elements, web links, safe images, MathML attributes; ``links=False`` unwraps links."""
    if n.kind == "text":
        return n.html() if n.parent is None or n.parent.kind != "root" else Node("text", value=n.value).html()
    if n.kind != "tag" or n.tag in DROPPED_TAGS:
        return ""
    inner = lambda: "".join(safe_html(c, base, images, links) for c in n.children)
    if n.tag == "img":
        source = safe_image(n.get("data-source") or n.get("src"), base) if images else None
        return Node("tag", "img", {"src": source, "alt": clean(n.get("alt"))}).html() if source else ""
    if n.tag != "math" and is_renderer(n) and (math := n.first("math")) is not None:
        return safe_html(math, base, images, links)
    if n.tag not in KEPT_TAGS or n.tag == "a" and not links:
        return inner()
    attrs = {}
    if n.tag == "a" and (href := absolute(n.get("href"), base) if n.get("href").strip() else None):
        attrs = {"href": href}
    elif n.tag in MATH_TAGS:
        attrs = {k: v for k, v in n.attrs.items() if k.lower() in MATH_ATTRIBUTES}
    shell = Node("tag", n.tag, attrs).html()
    return shell if shell.endswith("/>") else shell.replace(f"</{n.tag}>", f"{inner()}</{n.tag}>")


_BLOCKS = pa.schema([("seq", pa.int64()), ("included", pa.bool_()), ("html", pa.string()), ("text", pa.string()), ("images", pa.int64()), ("links", pa.int64())])


def previews(articles: DataFrame, images: bool = True, links: bool = True) -> DataFrame:
    """``page_id, seq, included, html, text, images, links``: one row per preview block of ``articles (page_id, source_url, html)``."""
    rows = articles.filter("html is not null").select("page_id", "source_url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                base = batch.column("source_url")[at].as_py() or ""
                page = parse(batch.column("html")[at].as_py())
                root = page.first("article") or page
                out = []
                for seq, nodes in enumerate(preview_blocks(root), 1):
                    markup = "".join(safe_html(n, base, images, links) for n in nodes)
                    shown = parse(markup)
                    excluded = any(n.get(EXCLUDED) == "true" for n in nodes)
                    out.append({"seq": seq, "included": not excluded, "html": markup, "text": shown.text(), "images": len(shown.tags("img")), "links": sum("href" in a.attrs for a in shown.tags("a"))})
                made = pa.RecordBatch.from_pylist(out, _BLOCKS)
                yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array([at] * len(out), pa.int32())), *made.columns], ["page_id", *_BLOCKS.names])

    return rows.mapInArrow(split, f"page_id {kind}, seq long, included boolean, html string, text string, images long, links long")


def selection(blocks: DataFrame) -> DataFrame:
    """Counts of what is selected, and excerpts of what is not, per article."""
    n = lambda c: F.count(F.when(c, 1))
    chosen = F.col("included")
    from pageloom.functions.text import excerpt

    left = F.transform(F.array_sort(F.collect_list(F.when(~chosen, F.struct("seq", F.when(F.col("text") == "", "Image or other article element").otherwise(excerpt("text")).alias("e"))))), lambda s: s["e"])
    return blocks.groupBy("page_id").agg(
        n(chosen).alias("selected"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(chosen, F.col("images"))), F.lit(0)).alias("images"), F.coalesce(F.sum(F.when(chosen, F.col("links"))), F.lit(0)).alias("links"), left.alias("excluded")
    )


def rebuilt(blocks: DataFrame) -> DataFrame:
    """``page_id, html``: the included blocks in source order as one article."""
    parts = F.array_sort(F.collect_list(F.when(F.col("included"), F.struct("seq", "html"))))
    body = F.array_join(F.transform(parts, lambda s: s["html"]), "")
    return blocks.groupBy("page_id").agg(F.concat(F.lit("<article>"), body, F.lit("</article>")).alias("html"))


def inert(html) -> F.Column:
    """Markup without scripts, styles, SVG and attributes that load something, by patterns only (no parse)."""
    out = F.regexp_replace(html, r"(?is)<(script|style|svg)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?i)<(?:script|style|svg|meta|base)\b[^>]*/?\s*>", "")
    value = r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"
    out = F.regexp_replace(out, rf"(?i)(<img\b[^>]*?)\ssrc({value})", "$1 data-source$2")
    for name in ("style", "src", "srcset", "data-src", "data-srcset", "poster", "srcdoc", "background", "data", "action", "formaction"):
        out = F.regexp_replace(out, rf"(?i)(<[a-z][^>]*?)\s{name}{value}", "$1")
    return F.regexp_replace(out, rf"(?i)(<link\b[^>]*?)\shref{value}", "$1")
