"""Which element of a page is its article."""

from __future__ import annotations

from collections import defaultdict

from pageloom.operators.dom import Node

MOST_ELEMENTS = 100_000
# Tests for content elements, in order of trust.
CONTENT = [
    ("article", lambda n: n.tag == "article"),
    ("[itemprop=articleBody]", lambda n: n.get("itemprop") == "articleBody"),
    ("[role=main]", lambda n: n.get("role") == "main"),
    ("main", lambda n: n.tag == "main"),
    (".article-body", lambda n: "article-body" in n.classes),
    (".article-content", lambda n: "article-content" in n.classes),
    (".post-content", lambda n: "post-content" in n.classes),
    (".entry-content", lambda n: "entry-content" in n.classes),
]


class NoArticle(ValueError):
    """The page has no readable article."""


def noise_weight(n: Node) -> bool:
    return n.tag in ("nav", "footer", "aside") or any(w in n.get("class") for w in ("recommend", "newsletter", "subscribe"))


def content_score(n: Node) -> int:
    """Length of the text, more for paragraphs and headings, less for navigation."""
    return len(n.text()) + 80 * len(n.tags("p")) + 40 * len(n.tags("h1", "h2", "h3", "h4")) - 250 * len(n.where(noise_weight))


def candidates(page: Node) -> list[Node]:
    found = [n for _, test in CONTENT for n in page.where(test)]
    if not found:
        body = page.first("body")
        found = [body] if body is not None else []
    return list({id(n): n for n in found}.values())


def best_candidate(page: Node) -> Node:
    """The candidate with the highest score, the first of equals."""
    found = candidates(page)
    if not found:
        raise NoArticle("The page has no readable article body.")
    return max(found, key=content_score)


def _linked_share(n: Node) -> float:
    whole = len(n.text())
    return sum(len(a.text()) for a in n.tags("a")) / whole if whole else 0.0


def retained_prose(page: Node) -> list[Node]:
    """Paragraphs of the element that paragraph scoring prefers.

    Each paragraph of 25 characters or more gives its parent a point, one more
    for each comma and up to three for its length, and its grandparent half of
    that; a share of linked text takes as much away. This is a simple form of
    the published readability heuristics and not meant to equal any library.
    """
    score: dict[int, float] = defaultdict(float)
    by_id: dict[int, Node] = {}
    prose = [n for n in page.tags("p", "pre", "blockquote") if len(n.text()) >= 25]
    for n in prose:
        text = n.text()
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        for depth, above in enumerate(n.ancestors()):
            if depth == 2 or above.kind == "root":
                break
            by_id[id(above)] = above
            score[id(above)] += points / (depth + 1)
    if not score:
        return []
    top = by_id[max(score, key=lambda i: score[i] * (1 - _linked_share(by_id[i])))]
    return [n for n in prose if n.within(top) and not any(a.tag == "a" for a in n.ancestors())]


def prose_root(page: Node) -> Node | None:
    """The nearest common parent of the retained prose, widened to the article around it; None if there is no such."""
    if len(page.tags()) > MOST_ELEMENTS:
        return None
    kept = retained_prose(page)
    if not kept:
        return None
    node = kept[0].parent
    while node is not None and not all(n.within(node) for n in kept):
        node = node.parent
    if node is None or node.kind == "root" or node.tag in ("html", "body") or len(node.text()) < 100:
        return None
    return node if node.tag == "article" else next((a for a in node.ancestors() if a.tag == "article"), node)


def article_root(page: Node) -> Node:
    return prose_root(page) or best_candidate(page)
