"""Trees, rewrites, blocks, reviewed extraction and packages on small pages."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageloom.functions.latex import Unsupported, mathml
from pageloom.operators import blocks, dom, metadata, rewrite, roots
from pageloom.plans import fixtures, review, standard
from pageloom.sources import epub
from pageloom.streaming import jobs

TEXT = "This paragraph is the real body of the feature and it has more than enough words to count as one hundred characters of kept text."


def test_unclosed_tags_nest():
    assert dom.parse("<p>a<p>b</div>c").html() == "<p>a<p>bc</p></p>"


def test_end_tag_closes_to_the_nearest():
    assert dom.parse("<div><p>a<b>c</div>d").html() == "<div><p>a<b>c</b></p></div>d"


def test_serializing_escapes_and_sorts():
    assert dom.parse("<img src='a' alt='q\"r'>1 &lt; 2").html() == "<img alt='q\"r' src=\"a\"/>1 &lt; 2"


def test_references_without_a_semicolon():
    html = "<h1 a='?b=1&copy=2'>A &amp</h1><script>a && b &amp</script><p>&amp;amp; &quot;q&quot &#38; &#38 &ampx; &nix; \ufdd0\ufdd1&</p>"
    assert dom.parse(html).html() == '<h1 a="?b=1©=2">A &amp;</h1><script>a && b &amp</script><p>&amp;amp; "q" &amp; &amp; &amp;x; &amp;nix; \ufdd0\ufdd1&amp;</p>'
    as_it_stands = '<h1 a="?b=1&amp;copy=2">A &amp;amp</h1><script>a && b &amp</script><p>&amp;amp; "q&amp;quot &amp; &amp;#38 &amp;ampx; &amp;nix; \ufdd0\ufdd1&amp;</p>'
    assert dom.parse(html, open_references=False).html() == as_it_stands


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<br>", "x", "<!--c-->", "<li>", "</ul>"]), max_size=40))
def test_intervals(parts):
    rows = dom.rows(dom.parse("".join(parts)))
    assert [r["pre"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r["pre"] <= r["last"] < len(rows)
        if r["parent"] >= 0:
            up = rows[r["parent"]]
            assert up["pre"] < r["pre"] <= r["last"] <= up["last"] and up["depth"] == r["depth"] - 1
    again = dom.rows(dom.parse(dom.parse("".join(parts)).html()))
    tags = lambda rs: [(r["tag"], r["depth"]) for r in rs if r["kind"] == "tag"]
    assert tags(again) == tags(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<p>a</p>", "<p>b</p>", "<h2>a</h2>", "<li>a<p>a</p></li>", "t"]), max_size=12))
def test_repeats_are_dropped_once(parts):
    root = dom.parse(f"<article>{''.join(parts)}</article>")
    rewrite.drop_repeats(root, "")
    assert rewrite.drop_repeats(root, "") == 0


def test_open_blocks_are_repeats_or_not():
    cut = "<article><p>Les.</p><p>a</p><p>a</p><p><b>Les.<br></article>"
    found = [dom.parse(cut), dom.parse(cut)]
    assert [rewrite.drop_repeats(found[0], ""), rewrite.drop_repeats(found[1], "", open_blocks=False)] == [2, 1]
    assert [f.text() for f in found] == ["Les. a", "Les. a Les."]
    assert [n.closed for n in dom.parse(cut).copy().tags("p", "b", "br")] == [True, True, True, False, False, True]
    first = dom.parse("<article><p><b> <br><p>Les.</p></article>")
    assert rewrite.drop_repeats(first.copy(), "") == 1 and rewrite.drop_repeats(first, "", open_blocks=False) == 0


def test_prose_root_widens_to_the_article():
    page = dom.parse(f"<body><div class='card'><p>{TEXT}</p></div><article><figure>f</figure><section><p>{TEXT}</p><p>{TEXT}, {TEXT}</p></section></article></body>")
    assert roots.article_root(page).tag == "article"


def test_best_candidate_prefers_the_first_of_equals():
    page = dom.parse(f"<main><p>{TEXT}</p></main><div role='main'><p>{TEXT}</p></div>")
    assert roots.best_candidate(page).tag == "div"  # role=main is trusted more than main


def test_dates():
    assert [metadata.iso_date(v) for v in ("2024-01-02T23:30:00-05:00", "2024-W01-1", "20240203", "Jan 3", None)] == ["2024-01-02", "2024-01-01", "2024-02-03", "", ""]


def test_formulas():
    assert "<mfrac>" in mathml(r"x^2 + \frac{1}{2}")
    for bad in (r"\begin{matrix}", "", "x^", "{x"):
        with pytest.raises(Unsupported):
            mathml(bad)


def test_reader_options():
    html = f"<head><meta property='og:title' content='Old'></head><article><h1>Old</h1><p>{TEXT} <a href='/x'>link</a></p><img src='/i.png'></article>"
    found = standard.extract(html, "http://h.com/", standard.Options(images=False, links=False, title="New", author=" "))
    assert (found.title, found.author) == ("New", "Unknown author")
    assert "<img" not in found.root.inner() and "<a" not in found.root.inner() and "Old" not in found.root.inner()
    with pytest.raises(roots.NoArticle):
        standard.extract(html, "http://h.com/", standard.Options(title="a\nb"))


def test_capture_keeps_repeats_and_footers():
    html = f"<article><p>{TEXT}</p><p>{TEXT}</p><footer>kept</footer></article><title>T</title>"
    assert standard.extract(html, "http://h.com/", standard.Options(capture=True)).root.inner().count("real body") == 2


def test_self_check_page():
    html = (
        r"<head><meta property='og:title' content='Hello'><meta name='author' content='Ada'></head><article><h1>Hello</h1><p>" + TEXT + r"</p><p>Formula: \(x^2 + \frac{1}{2}\).</p><p>Fallback: \(\begin{matrix}\).</p>"
        r"<span class='katex'><annotation encoding='application/x-tex'>y=\sqrt{x}</annotation></span><figure><img src='data:image/png;base64,invalid'></figure><h2>Second</h2><pre><code>print('hello')</code></pre><nav>No</nav></article>"
    )
    row = standard.article_row(html, "http://h.com/", standard.Options())
    data, failed = epub.package(row)
    assert row["warnings"] == ["1 formula(s) retained as text"] and failed == 1
    assert "<mfrac>" in row["html"] and r"\begin{matrix}" in row["html"] and "No" not in row["html"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "section-1" in z.read("OEBPS/nav.xhtml").decode()
    assert epub.read_package(data)["title"] == "Hello"
    assert epub.read_package(b"no zip")["error"] and epub.read_package(None)["error"]


def test_windows_overlap_and_cover():
    sizes = [1000] * 60
    got = list(review.windows(sizes))
    assert got[0] == (0, 18) and got[1][0] == 16 and got[-1][1] == 60
    assert list(review.windows([50000, 1])) == [(0, 1), (1, 2)]
    assert list(review.windows([])) == []


def test_pieces():
    assert review.pieces("a" * 6001) == ["a" * 6000, "a"]
    assert review.pieces("a" * 3500 + " " + "b" * 5000) == ["a" * 3500, "b" * 5000]


def reviewed(body, labeller=fixtures.rule_labeller):
    return review.reviewed_row(f"<body>{body}</body>", "http://h.com/", labeller())


def test_references_after_a_conclusion_stay_and_loose_text_after_cards_goes():
    row = reviewed(
        f"<article><h1>Feature title</h1><p>{TEXT}</p><h2>References</h2><p>[1] A source of the article.</p><div class='editors-picks'><a href='/1'><h3>One</h3></a><a href='/2'><h3>Two</h3></a></div>loose<div>after</div></article>"
    )
    by = {b["text"]: b["label"] for b in row["blocks"]}
    assert by["References"] == "body" and by["One"] == by["loose after"] == "noise"


def test_vendor_like_class_is_no_consent_dialog():
    row = reviewed(f"<article><h1>Feature title</h1><div class='[--sticky-top:cky]'><p>{TEXT}</p></div></article>")
    assert [b["label"] for b in row["blocks"]] == ["title", "body"]


def test_byline_is_the_name_only():
    row = reviewed(f"<article><h1>Feature title</h1><p class='byline'>By Ada Lovelace March 3, 2024 5 min read</p><p>{TEXT}</p></article>")
    assert row["author"] == "Ada Lovelace"


def test_media_fallbacks():
    row = reviewed(f"<article><h1>Feature title</h1><p>{TEXT}</p><video poster='/p.jpg'></video><canvas></canvas></article>")
    assert 'src="http://h.com/p.jpg"' in row["html"] and "[Interactive canvas omitted" in row["html"] and len(row["warnings"]) == 2


def test_structured_blocks_survive_a_false_noise_label():
    noisy = lambda: lambda asked: json.dumps({"labels": {str(b["id"]): "noise" if b["tag"] in ("figure", "pre") else "title" if b["tag"] == "h1" else "body" for b in asked["blocks"]}})
    row = reviewed(f"<article><h1>Feature title</h1><p>{TEXT}</p><figure><img src='/a.png' alt='chart'></figure><pre>x=1</pre></article>", noisy)
    assert [b["label"] for b in row["blocks"]] == ["title", "body", "body", "body"]


def test_many_paragraphs_are_all_kept():
    row = reviewed("<article><h1>Feature title</h1>" + "".join(f"<p>{n} {TEXT * 5}</p>" for n in range(60)) + "</article>")
    assert sum(b["label"] == "body" for b in row["blocks"]) == 60 and row["analysis_mode"] == "ai"


def test_excluded_blocks_stay_in_source_order():
    row = reviewed(f"<nav><p>Site navigation</p></nav><article><h1>Feature title</h1><p>{TEXT}</p></article>")
    assert row["html"].index("Site navigation") < row["html"].index("real body") and row["html"].count('data-block-excluded="true"') == 1


def test_a_failing_labeller_falls_back():
    def broken():
        def label(asked):
            raise OSError("secret text")

        return label

    row = reviewed(f"<article><h1>Feature title</h1><p>{TEXT}</p></article>", broken)
    assert row["analysis_mode"] == "standard" and "secret" not in json.dumps(row) and row["warnings"][0].startswith("AI analysis unavailable")


def test_instructions_name_the_cues():
    for cue in ("Read more", "Keep reading", "You might also like", "Up next", "Recommended for you"):
        assert cue in review.INSTRUCTIONS


def test_job_states():
    job = None
    for e in ({"event": "submit", "payload": "html", "at": 1}, {"event": "start", "at": 2}, {"event": "progress", "current": 1, "total": 2, "message": "m", "at": 3}, {"event": "cancel", "at": 4}, {"event": "finish", "message": "r", "at": 5}):
        job = jobs.advance(job, e)
    assert job["status"] == "cancelled" and job["payload"] is None and job["result"] is None and job["current"] == 1


def test_contexts():
    page = dom.parse("<body><main id='m'><section class='a b'><div><p title='t'>x</p></div></section></main></body>")
    assert blocks.context_of(page.first("p")) == "main id=m > section class=a b > div > p title=t"


def test_progress_and_cancel():
    html = "<body><article><h1>Feature title</h1>" + "".join(f"<p>{n} {TEXT * 5}</p>" for n in range(60)) + "</article></body>"
    seen = []
    row = review.reviewed_row(html, "http://h.com/", review.keep_all(), watch=review.Watch(lambda current, total: seen.append((current, total))))
    assert row["analysis_mode"] == "ai" and seen == [(n, seen[-1][1]) for n in range(seen[-1][1] + 1)] and seen[-1][1] > 2
    row = review.reviewed_row(html, "http://h.com/", review.keep_all(), watch=review.Watch(cancelled=lambda: len(seen) > 0))
    assert row["error"] == review.CANCELLED and "html" not in row


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9000), max_size=60))
def test_windows_are_the_longest(sizes):
    got = [*review.windows(sizes, 18000, 7, 2)]
    assert [a for a, _ in got] == [max(a + 1, z - 2) for a, z in [(-1, 2), *got][:-1]] if got else not sizes
    for a, z in got:
        assert z - a == 1 or sum(sizes[a:z]) <= 18000 and z - a <= 7
        assert z == len(sizes) or z - a == 7 or sum(sizes[a : z + 1]) > 18000
