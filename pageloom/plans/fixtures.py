"""Cases for branches that the tables' pages never take, dealt over all documents, and the rows expected of them.

Each document takes the case of its number. Where a case has the mark, the
document's own word stands, in what is read and in what is expected.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "§"
#: The word of a document; the same in Spark and in DuckDB.
_WORD = "concat('x', left(regexp_extract(coalesce(text, ''), '[a-z]+', 0), 6), doc_id)"
Z = "z" * 100
FILL = f"<p>{Z}</p>"

_META = [
    (1, "<head><title>Page</title><meta property='og:title' content=' Og §  title '><meta name='author' content='Meta § Author'></head>", "Og § title", "Meta § Author", None),
    (2, '<script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":["NewsArticle"],"headline":"Linked §","author":[{"name":"Ada §"}],"datePublished":"2024-01-02T23:30:00-05:00"}]}</script>', "Linked §", "Ada §", "2024-01-02"),
    (3, '<script type="application/ld+json">[{"@type":"Article","headline":"No author §","author":null}]</script>', "No author §", "None", None),
    (4, '<script type="application/ld+json">{bad json</script><title> Plain §  title </title><time class="published-on" datetime="2023-05-06">May</time>', "Plain § title", "Unknown author", "2023-05-06"),
    (5, '<script type="application/ld+json">{"@type":"Article"}</script><meta property="article:published_time" content="20240203"><meta name="twitter:title" content="Tweet §">', "Tweet §", "Unknown author", "2024-02-03"),
    (6, "<meta property='og:title' content=''><meta name='og:title' content='Hidden'><title>Seen §</title>", "Seen §", "Unknown author", None),
]
_REWRITES = [
    (1, f"<article><h1>T</h1>{FILL}<p>same §</p><p>same §</p><div class='unrelated-box'>gone §</div><p>gone §</p>tail §</article>", f"<p>{Z}</p><p>same §</p>tail §", ""),
    (2, f"<article><h1>T</h1>{FILL}<aside>a</aside><span class='byline'>b</span><time>c</time><p>kept § <u>u</u> <a href='/x§' class='k'>l</a><a href='mailto:a'>m</a><a>n</a></p><!-- c --></article>", f'<p>{Z}</p><p>kept § u <a href="http://h.com/x§">l</a><a href="http://h.com/a">m</a><a href="http://h.com/a">n</a></p>', ""),
    (3, f"<article><h1>T</h1>{FILL}<p>\\(x^2\\) and § \\(\\begin{{matrix}}\\)</p></article>", f'<p>{Z}</p><p><math display="inline" xmlns="http://www.w3.org/1998/Math/MathML"><mrow><msup><mi>x</mi><mn>2</mn></msup></mrow></math> and § \\begin{{matrix}}</p>', "1 formula(s) retained as text"),
    (4, f"<article><h1>T</h1>{FILL}<p>§</p><span class='katex'><annotation encoding='application/x-tex'>\\sqrt{{y}}</annotation></span></article>", f'<p>{Z}</p><p>§</p><math display="inline" xmlns="http://www.w3.org/1998/Math/MathML"><mrow><msqrt><mrow><mi>y</mi></mrow></msqrt></mrow></math>', ""),
    (5, f"<article><h1>T</h1>{FILL}<p><a href='/me'>By Ada</a></p><p>By Ada said §</p><img data-src='i§.png' alt=' a  b '><img alt='none'></article><meta name='author' content='Ada'>", f'<p>{Z}</p><p>By Ada said §</p><img alt="a b" src="http://h.com/i§.png"/>', ""),
    (6, "<article><h1>T</h1><p>short §</p></article>", None, ""),
]
_LONG = "This paragraph is the real body of the feature and it has more than enough words to count as one hundred characters of kept text."
_REVIEWED = [
    (
        1,
        f"<body><nav><p>Site navigation §</p></nav><article><h1>Feature title §</h1><p class='subtitle'>Feature subtitle</p><p class='byline-author'>By Ada Lovelace ada@x.org</p><img alt='Author portrait' src='/a.png'><p>{_LONG}</p><pre>code()</pre>"
        "<h2>Keep reading</h2><p>Another story §</p></article></body>",
        [(0, "noise", True, "Site navigation §"), (1, "title", True, "Feature title §"), (2, "subtitle", False, "Feature subtitle"), (3, "author", True, "By Ada Lovelace ada@x.org"), (4, "noise", True, "Author portrait"), (5, "body", False, _LONG), (6, "body", False, "code()"), (7, "noise", True, "Keep reading"), (8, "noise", True, "Another story §")],
    ),
    (
        2,
        f"<body><div role='dialog' class='overlay'><h1>We use cookies §</h1></div><article><h1>Feature title §</h1><p>{_LONG}</p><p>About § cookies in kitchens</p><aside><p>aside §</p></aside><div class='promo-card'><p>promo §</p></div></article></body>",
        [(0, "noise", True, "We use cookies §"), (1, "title", True, "Feature title §"), (2, "body", False, _LONG), (3, "body", False, "About § cookies in kitchens"), (4, "noise", True, "aside §"), (5, "noise", True, "promo §")],
    ),
]
_CAPTURES = [
    (1, {"title": "T§", "author": "A", "sourceUrl": "http://h.com", "html": "<p>x", "publishedDate": "2024-02-29", "other": 1}, ("T§", "2024-02-29", None)),
    (2, {"title": " ", "author": "A", "sourceUrl": "u", "html": "h"}, (" ", None, "A capture requires non-empty string title, author, sourceUrl, and html fields.")),
    (3, {"title": 7, "author": "A", "sourceUrl": "u", "html": "h"}, ("7", None, "A capture requires non-empty string title, author, sourceUrl, and html fields.")),
    (4, {"title": "T§", "author": "A", "sourceUrl": "u", "html": "h", "publishedDate": "2023-02-29"}, ("T§", "2023-02-29", "Capture publishedDate is not a valid calendar date.")),
    (5, {"title": "T§", "author": "A", "sourceUrl": "u", "html": "h", "publishedDate": "29.2.2023"}, ("T§", "29.2.2023", "Capture publishedDate must use YYYY-MM-DD format.")),
    (6, {"title": "T§", "author": "A", "sourceUrl": "u", "html": "h", "publishedDate": None}, ("T§", None, None)),
]
_AUTHORS = [
    ("By Ada §", "Ada §"), ("Written by  Ada § ada@x.org @ada", "Ada §"), ("Ada § March 3, 2024 in Science", "Ada §"), ("Ada § 5 min read", "Ada §"), ("Ada § | The Paper", "Ada §"),
    ("Ada § Follow", "Ada §"), ("author: (Ada§)", "Ada§"), ("https://x.org/ada Ada §", "Ada §"), ("Baby §", "Baby §"), ("", ""),
]
_PNG = "iVBORw0KGgo="
_IMAGES = [
    (1, 1, f"data:image/png;base64,{_PNG}", "image/png", 8, False), (1, 2, "data:image/svg+xml,%3Csvg/%3E", "image/svg+xml", 6, False), (1, 3, "data:image/gif,abcd", "image/gif", 4, True), (1, 4, "http://x.org/a.png", "", None, True),
    (2, 1, "data:image/png;base64,####", "image/png", None, True), (2, 2, "data:image/gif,a+b", "image/gif", 3, True),
]
_REQUESTS = [
    (1, {"sourceUrl": "u§", "html": "h"}, "standard", None), (2, {"sourceUrl": "u§", "html": "h", "mode": "ai"}, "ai", None), (3, {"sourceUrl": "", "html": "h"}, "standard", "A request requires non-empty sourceUrl and html."),
    (4, {"sourceUrl": "u§", "html": "h", "mode": "fast"}, "fast", "The mode is standard or ai."), (5, {"sourceUrl": "u§", "html": "h", "title": "t" * 501}, "standard", "A title has 500 characters at most."),
]
_OPTIONS = [(1, f"<head><meta property='og:title' content='Old'></head><article><h1>Old</h1>{FILL}<p>see § <a href='/x'>this</a></p><img src='/i.png'></article>", f"<p>{Z}</p><p>see § this</p>")]

_FRAMES = {
    "metadata": ("page_id long, url string, html string", [(i, "http://h.com/a", f"<html>{head}<body><article>{FILL}</article></body></html>") for i, head, *_ in _META]),
    "rewrites": ("page_id long, url string, html string", [(i, "http://h.com/a", html) for i, html, *_ in _REWRITES]),
    "reviewed": ("page_id long, url string, html string", [(i, "http://h.com/a", html) for i, html, _ in _REVIEWED]),
    "requests": ("id long, json string", [(i, json.dumps(r, ensure_ascii=False)) for i, r, *_ in _REQUESTS]),
    "options": ("page_id long, url string, html string", [(i, "http://h.com/a", html) for i, html, _ in _OPTIONS]),
    "captures": ("id long, json string", [(i, json.dumps(c, ensure_ascii=False)) for i, c, _ in _CAPTURES] + [(7, "[1]")]),
    "authors": ("doc_id long, given string", [(i, a) for i, (a, _) in enumerate(_AUTHORS, 1)]),
    "images": ("page_id long, seq long, source string", [r[:3] for r in _IMAGES]),
}
_BAD = "A capture requires non-empty string title, author, sourceUrl, and html fields."
_BROKEN = "The labeller returned incomplete or invalid block labels."
_EXPECTED = {
    "metadata": ("page_id bigint, title varchar, author varchar, published_date varchar", [(i, *rest) for i, _, *rest in _META]),
    "rewrites": (
        "page_id bigint, html varchar, warnings varchar, error varchar",
        [(i, html and html.replace(Z, "Z"), w, None if html else "Could not find enough readable article content (it may be paywalled).") for i, _, html, w in _REWRITES],
    ),
    "reviewed": ("page_id bigint, block bigint, label varchar, excluded boolean, text varchar", [(i, *b) for i, _, bs in _REVIEWED for b in bs]),
    "selection": (
        "page_id bigint, selected bigint, total bigint, images bigint, links bigint, excluded varchar",
        [(1, 3, 7, 0, 0, "Site navigation § | Image or other article element | Keep reading | Another story §"), (2, 2, 5, 0, 0, "We use cookies § | aside § | promo §")],
    ),
    "requests": ("id bigint, mode varchar, error varchar", [(i, m, e) for i, _, m, e in _REQUESTS]),
    "options": ("page_id bigint, title varchar, author varchar, html varchar", [(i, "New", "Unknown author", html.replace(Z, "Z")) for i, _, html in _OPTIONS]),
    "fallback": ("page_id bigint, analysis_mode varchar, fallback_reason varchar, warning varchar", [(i, "standard", _BROKEN, f"AI analysis unavailable: {_BROKEN}") for i, *_ in _REVIEWED]),
    "captures": ('id bigint, title varchar, "publishedDate" varchar, error varchar', [(i, *e) for i, _, e in _CAPTURES] + [(7, None, None, _BAD)]),
    "authors": ("doc_id bigint, name varchar", [(i, a) for i, (_, a) in enumerate(_AUTHORS, 1)]),
    "images": ("page_id bigint, seq bigint, kind varchar, bytes integer, fits boolean", [(p, s, k, n, f) for p, s, _, k, n, f in _IMAGES]),
}


def frame(docs: DataFrame, name: str) -> DataFrame:
    """The cases of a name, dealt over ``documents``."""
    schema, rows = _FRAMES[name]
    cases = docs.sparkSession.createDataFrame(rows, schema)
    key, *rest = cases.dtypes
    own = docs.select("doc_id", F.expr(_WORD).alias("_word"), (F.pmod("doc_id", F.lit(len({r[0] for r in rows}))) + 1).alias("_case"))
    filled = [(F.replace(c, F.lit(MARK), "_word") if kind == "string" else F.col(c)).alias(c) for c, kind in rest]
    met = own.withColumnRenamed("doc_id", "_doc").join(F.broadcast(cases), F.col("_case") == F.col(key[0]))  # the cases are a handful
    return met.select(F.col("_doc").alias(key[0]), *filled)


def _literal(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def sql(name: str) -> str:
    """The expected rows as SQL over ``documents``."""
    (key, _), *rest = (c.rsplit(" ", 1) for c in _EXPECTED[name][0].split(", "))
    rows = _EXPECTED[name][1]
    values = ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)
    filled = ", ".join(f"replace(cast({c} as varchar), '{MARK}', word) as {c}" if kind == "varchar" else f"cast({c} as {kind}) as {c}" for c, kind in rest)
    own = f"select doc_id as doc, {_WORD} as word, doc_id % {len({r[0] for r in rows})} + 1 as k from documents"
    return f"select doc as {key}, {filled} from ({own}) d join (values {values}) v({', '.join([key, *(c for c, _ in rest)])}) on k = v.{key}"


def rule_labeller():
    """A deterministic labeller for tests: a few phrases decide."""

    def one(b: dict) -> str:
        said = f"{b['text']} {b['context']}".lower()
        if any(s in said for s in ("avatar", "you may also want", "site navigation", "related stories")):
            return "noise"
        if "feature title" in said:
            return "title"
        if "feature subtitle" in said:
            return "subtitle"
        return "author" if "by ada lovelace" in said or "byline" in b["context"] else "body"

    return lambda asked: json.dumps({"labels": {str(b["id"]): one(b) for b in asked["blocks"]}})


def broken_labeller():
    """Leaves out the first key."""
    whole = rule_labeller()

    def label(asked: dict) -> str:
        labels = json.loads(whole(asked))["labels"]
        labels.pop(next(iter(labels)))
        return json.dumps({"labels": labels})

    return label
