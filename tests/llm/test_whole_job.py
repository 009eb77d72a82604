"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
import pyarrow as pa

from pageloom.llm import chaining, common, jaccard, knn_quality, url_filter


def _shingles(words, k=5):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


# ------------------------------------------------------------------ op10


def test_near_copies_meet_whatever_hosts_share_their_bands(docs_of):
    """1,000 longer texts quote each of six texts whole; two near copies of it share bands with them and must still meet each other."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], []
    for _ in range(6):
        text = fresh(64)
        x, y = text + fresh(5), fresh(5) + text
        assert len(_shingles(x) & _shingles(y)) >= 0.85 * len(_shingles(x) | _shingles(y))
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + n, " ".join(t)) for n, t in enumerate([x, y, *(text + fresh(60) for _ in range(1000))])]
    found = {r.doc_id: r.class_id for r in jaccard.near_duplicates(docs_of(rows), bands=32, rows=4).collect()}
    assert [found[b] for _, b in pairs] == [a for a, _ in pairs]
    assert len(set(found.values())) == len(rows) - len(pairs)


def test_rows_are_told_apart_by_more_than_their_id(docs_of):
    """Unrelated texts under one id, or without an id, are all kept; one of equal rows is."""
    fresh = lambda seed: " ".join(f"w{seed}x{n}" for n in range(40))
    rows = [(None, fresh(1)), (None, fresh(2)), (5, fresh(3)), (5, fresh(4)), (6, fresh(3)), (2**63 - 1, fresh(5)), (2**63 - 1, fresh(5)), (None, fresh(4)), (-(2**63), fresh(2))]
    kept = sorted((r.doc_id or 0, r.text) for r in jaccard.one_of_each(docs_of(rows)).collect())
    assert kept == sorted([(0, fresh(1)), (5, fresh(3)), (5, fresh(4)), (2**63 - 1, fresh(5)), (-(2**63), fresh(2))])
    found = jaccard.near_duplicates(docs_of(rows)).collect()
    assert len(found) == len(rows) and {r.class_id for r in found} == {None, 5, 2**63 - 1, -(2**63)}


# ------------------------------------------------------------------ op5


def test_fuzzy_passages_of_one_seed_are_aligned(docs_of):
    """60 words of which every tenth is replaced (identity 0.9): found wherever a seed is shared."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, shared = [], []
    seeds = lambda t: {tuple(t[i : i + chaining.K]) for i in _places(t)}
    for n in range(60):
        passage = fresh(60)
        changed = [w if i % 10 != 5 else fresh(1)[0] for i, w in enumerate(passage)]
        x, y = fresh(40) + passage + fresh(40), fresh(40) + changed + fresh(40)
        rows += [(2 * n, " ".join(x)), (2 * n + 1, " ".join(y))]
        if seeds(x) & seeds(y):
            shared.append(2 * n + 1)
    found = {row.doc_id: row.n_repeated for row in chaining.repeats_by_document(docs_of(rows)).collect()}
    assert len(shared) > 50
    assert [i for i in shared if not 50 <= found[i] <= 60] == []


def test_scattered_pieces_do_not_hide_a_passage(docs_of):
    """Every five words of a passage stand in an earlier short document; two later documents share all of it."""
    words = [f"p{n}" for n in range(200)]
    rows = [(n, " ".join(words[n : n + 5])) for n in range(196)] + [(1000 + n, f"{'a b c'.split()[n]} " + " ".join(words)) for n in range(2)]
    found = {row.doc_id: row.n_repeated for row in chaining.repeats_by_document(docs_of(rows)).collect()}
    assert found[1001] >= 195


def test_texts_of_one_id_are_documents_of_their_own(docs_of):
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = fresh(120)
    texts = [" ".join(x) for x in (fresh(30) + shared, fresh(400), shared + fresh(40), fresh(50) + shared, fresh(70), shared)]
    rows = list(zip([1, 5, 5, None, None, None], texts, strict=True))
    got = sorted((r.text, r.n_chars) for r in chaining.cut_repeats(docs_of(rows)).collect())
    want = [texts[0], texts[1], " ".join(texts[2].split()[120:]), " ".join(texts[3].split()[:50]) + " ", texts[4], ""]
    assert got == sorted((t, len(t)) for t in want)


def test_recall_of_fuzzy_passages(docs_of):
    """Of passages of 60 to 200 words, every 20th word or so changed, in a corpus with common phrases, at least 0.9 are found."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    phrases = [fresh(5) for _ in range(40)]
    rows, hidden = [], []
    for n in range(150):
        passage = [w for _ in range(rng.randint(3, 10)) for w in [*fresh(15), *rng.choice(phrases)]]
        changed = [w if rng.random() > 0.05 else fresh(1)[0] for w in passage]
        rows += [(2 * n, " ".join(fresh(30) + passage + fresh(30))), (2 * n + 1, " ".join(fresh(30) + changed + fresh(30)))]
        hidden.append((2 * n + 1, len(passage)))
    found = {row.doc_id: row.n_repeated for row in chaining.repeats_by_document(docs_of(rows)).collect()}
    assert np.mean([found[i] >= 0.8 * n for i, n in hidden]) >= 0.9
    assert not any(found[2 * n] for n in range(150))


def test_a_fuzzy_passage_is_found_beside_thin_matches():
    """60 words at identity 0.9, then two common phrases of five words, 8 words apart."""
    fuzzy = [i % 10 != 5 for i in range(60)]
    hit = np.array([*[False] * 7, *fuzzy, *([False] * 8 + [True] * 5) * 2, *[False] * 9])
    ((first, n),) = chaining.passages(hit, 50, 0.8)
    assert first <= 7 and first + n >= 67 and hit[first : first + n].mean() >= 0.8
    rng = random.Random(1)
    for _ in range(300):  # the longest stretch is found, and none that is too thin
        hit = np.array([rng.random() < p for p in rng.choices([0.3, 0.75, 0.95], k=6) for _ in range(12)])
        total = np.append(0, np.cumsum(hit))
        at, got = np.flatnonzero(hit), chaining.passages(hit, 10, 0.8, slack=100)
        want = max((b - a + 1 for a in at for b in at if b - a + 1 >= 10 and 5 * (total[b + 1] - total[a]) >= 4 * (b - a + 1)), default=0)
        assert max((n for _, n in got), default=0) == want
        assert all(5 * (total[a + n] - total[a]) >= 4 * n for a, n in got)


def _places(words):
    buf, off = common.text_bytes(pa.array([" ".join(words)]))
    got = common.Words(buf, off, common.byte_class("letters"))
    return chaining.minimizers(got.hash, got.bound, chaining.K, chaining.W)


# ------------------------------------------------------------------ op7


def test_distinct_words_of_the_whole_text():
    start = " ".join(f"{n:04d}" for n in range(512))
    varied, junk = " ".join(f"{n:04d}" for n in range(512, 2048)), " ".join(["0001", "0002"] * 768)
    buf, off = common.text_bytes(pa.array([f"{start} {varied}", f"{start} {junk}", start]))
    share = np.expm1(knn_quality.features(buf, off)[:, -2] / knn_quality.COUNT_WEIGHT[2]) / 100
    assert np.allclose(share, [1, (512 + 3 * 2) / 2048, 1], atol=1e-3)


# ------------------------------------------------------------------ op1


def test_branches_below_the_third_segment_are_told_apart(spark):
    rows = [(n, f"http://a.net/x/y/z/{'good' if n < 60 else 'bad'}/{n}") for n in range(120)]
    labels = spark.createDataFrame([(n, int(n < 60)) for n in range(120)], "url_key long, good int")
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=[]).collect()
    assert {(r.page_id < 60, r.verdict, r.template) for r in got} == {(True, "allow", "a.net/x/y/z/good/*"), (False, "block", "a.net/x/y/z/bad/*")}
