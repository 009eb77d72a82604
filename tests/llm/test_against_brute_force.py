"""Operators that SQL can't express, against plain versions of the same definitions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import chaining, chat, common, decontam, edit_tokens, imatch, jaccard, knn_quality, mixing, ppm, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.text(alphabet="aAbZ09 é字\n.-\t", max_size=60)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# ------------------------------------------------------------------ words


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=6), st.sampled_from([("letters", WORD), ("solid", SOLID)]), st.integers(4, 40))
def test_words(batch, kind, chunk):
    before, common.CHUNK = common.CHUNK, chunk
    try:
        buf, off = common.text_bytes(pa.array(batch, pa.string()))
        words = common.Words(buf, off, common.byte_class(kind[0]))
    finally:
        common.CHUNK = before
    want = [kind[1].findall(lower(t)) for t in batch]
    got = [[words.text(i).decode() for i in range(a, b)] for a, b in zip(words.bound[:-1], words.bound[1:], strict=True)]
    assert got == want
    by = {}
    for w, h in zip([w for ws in want for w in ws], words.hash.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


# ------------------------------------------------------------------ op1


def test_templates(spark):
    rows = [(n, f"http://a.net/good/{n}") for n in range(60)] + [(100 + n, f"http://a.net/bad/{100 + n}.html") for n in range(60)] + [(300 + n, f"http://a.net/{chr(97 + n % 26)}{n}/x") for n in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(n, int(n < 60)) for n, _ in rows if n < 200], "url_key long, good int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, labels).collect()}
    assert {got[n]["verdict"] for n in range(60)} == {"allow"} and {got[100 + n]["verdict"] for n in range(60)} == {"block"}
    assert got[5]["template"] == "a.net/good/*" and got[101]["template"] == "a.net/bad/*.html" and got[301]["template"] == "a.net/*/*"


# ------------------------------------------------------------------ op2


class Plain:
    """The same model with dictionaries."""

    def __init__(self, corpus, order, aside=()):
        self.order = order
        self.n, others, apart = self.counted(corpus), self.counted([t for n, t in enumerate(corpus) if n not in aside]), self.counted([corpus[n] for n in aside])
        self.discounts = []
        for d in range(order + 1):
            failed = expected = 0
            for context, own in apart[d].items():
                if have := others[d].get(context):
                    failed += sum(n for x, n in own.items() if x not in have)
                    expected += sum(own.values()) * len(have) / sum(have.values())
            self.discounts.append(min(0.95, max(0.01, failed / expected)) if expected else 0.5)

    def counted(self, corpus):
        out = [{} for _ in range(self.order + 1)]
        for t in corpus:
            s = self.symbols(t)
            for i in range(self.order, len(s)):
                for d in range(self.order + 1):
                    own = out[d].setdefault(s[i - d : i], Counter())
                    own[s[i]] += 1
        return out

    def symbols(self, text):
        return (0,) * self.order + tuple(b + 1 for b in lower(text or "").encode()) + (257,)

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for d in range(self.order, -1, -1):
            own = self.n[d].get(context[len(context) - d :], {})
            offered = {x: n for x, n in own.items() if x not in excluded}
            whole = sum(offered.values())
            if not whole:
                continue
            if symbol in offered:
                return p * (offered[symbol] - self.discounts[d]) / whole
            p *= self.discounts[d] * len(offered) / whole
            excluded |= set(offered)
        return p / max(1, 257 - len(excluded))

    def score(self, text):
        s = self.symbols(text)
        return sum(math.log10(self.probability(s[i - self.order : i], s[i])) for i in range(self.order, len(s)))


@settings(max_examples=100, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6), st.integers(1, 40), st.integers(3, 6))
def test_pieces_of_long_texts(batch, size, order):
    buf, off = common.text_bytes(pa.array(batch, pa.string()))
    want, begin = ppm.runs(buf, off, order)
    before, ppm.PIECE = ppm.PIECE, size
    try:
        got = [[] for _ in batch]
        for lo, hi, packed, at in ppm.pieces(buf, off, order):
            for d in range(lo, hi):
                got[d] += packed[at[d - lo] : at[d - lo + 1]].tolist()
    finally:
        ppm.PIECE = before
    assert got == [want[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]


@pytest.mark.parametrize("order", [3, 4, 5])
def test_probabilities(docs_of, order):
    rng = random.Random(3)
    corpus = ["".join(rng.choice("abra cad") for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["", None, "zz abra é", "Cab" * 3000]
    rows = list(enumerate(corpus))
    learn = [n for n in range(len(rows)) if n % 4]
    apart = {r[0] for r in docs_of(rows).withColumn("text", F.coalesce("text", F.lit(""))).filter(ppm.set_aside()).select("doc_id").collect()}
    plain = Plain([corpus[n] for n in learn], order, [at for at, n in enumerate(learn) if n in apart])
    got = ppm.score_texts(docs_of(rows), learn=F.col("doc_id") % 4 != 0, order=order, bucket_bytes=700).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["score"] == pytest.approx(plain.score(corpus[r["doc_id"]]), rel=1e-9)
    for context in ((0, 0, 0, 0, 0), (2, 99, 19, 2, 99), (200,) * 5):
        assert sum(plain.probability(context[-order:], x) for x in range(1, 258)) == pytest.approx(1, abs=1e-9)


def test_the_whole_model_of_a_table(spark):
    """Every score of the query on sf0.001 is that of the dictionary version, learnt from all training texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in ppm.score_texts(docs, learn=~ppm.held_out()).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    apart = {r[0] for r in docs.filter(ppm.set_aside()).select("doc_id").collect()}
    learn = [n for n in texts if got[n]["learn"]]
    plain = Plain([texts[n] for n in learn], ppm.ORDER, [at for at, n in enumerate(learn) if n in apart])
    for n, t in texts.items():
        if len(t or "") < 20_000:
            assert got[n]["score"] == pytest.approx(plain.score(t), rel=1e-9)


def test_scores(spark, docs_of):
    rng = random.Random(5)
    rows = [(n, " ".join(rng.choice(["the", "cat", "sat", "Mat.", "on", f"w{n}"]) for _ in range(rng.randint(0, 30)))) for n in range(80)]
    got = {r["doc_id"]: r for r in ppm.score_texts(docs_of(rows), learn=~ppm.held_out(), bucket_bytes=500).collect()}
    learn = [n for n, r in got.items() if r["learn"]]
    counts = Counter(w for n, t in rows if n in learn for w in [*SOLID.findall(lower(t)), "\0"])
    total, kinds = sum(counts.values()), len(counts)
    for n, t in rows:
        tokens = [*SOLID.findall(lower(t)), "\0"]
        assert got[n]["n_tokens"] == len(tokens) and got[n]["n_known"] == sum(counts[w] > 0 for w in tokens) and got[n]["train_tokens"] == total
        assert got[n]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens))
        assert math.isfinite(got[n]["score"]) and got[n]["score"] < 0


def test_the_model_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = ppm.score_texts(docs, learn=~ppm.held_out()).filter("not learn").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


# ------------------------------------------------------------------ op3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "<", "[", "s>", "INST]", chat.ESCAPE, "a", " "]), max_size=12).map("".join))
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(m in chat.escape(text) for m in chat.CONTROLS)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", "a[INST]"]), texts)
def test_turns_round_trip(role, text):
    t = chat.template(chat.TOKENIZER)
    ids, mask = t.turn(role, text + "</s>", role == "assistant")
    assert t.read(ids) == (role, text + "</s>")
    assert chat.unescape(t.text(ids[mask])) == (text + "</s>" if role == "assistant" else "")


# ------------------------------------------------------------------ op4


def test_rates_meet_targets(spark, docs_of):
    rng = random.Random(2)
    vocabulary = {"clean": "alpha beta gamma delta", "low": "buy!! now!! click!! win!!", "toxic": "grr argh bah pah"}
    rows = [(n, " ".join(rng.choice(vocabulary[d].split()) for _ in range(rng.randint(5, 60)))) for n, d in enumerate(rng.choice(["clean"] * 6 + ["low", "toxic"]) for _ in range(300))]
    labels = spark.createDataFrame([(n, next(d for d, v in vocabulary.items() if t.split()[0] in v)) for n, t in rows if n % 3], "doc_id long, domain string")
    targets = {"clean": 0.3, "low": 0.4, "toxic": 0.3}
    got = mixing.mix_documents(docs_of(rows), labels, targets).orderBy("doc_id").collect()
    total = sum(r["n_tokens"] for r in got)
    for d, share in targets.items():
        assert sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in got) / total == pytest.approx(share, abs=1e-4)
    assert min(r["rate"] for r in got) >= 0
    right = [max(vocabulary, key=lambda d: r[f"p_{d}"]) for r in got if r["doc_id"] % 3 == 0]
    want = [next(d for d, v in vocabulary.items() if t.split()[0] in v) for n, t in rows if n % 3 == 0]
    assert np.mean([a == b for a, b in zip(right, want, strict=True)]) > 0.95


def test_rates_and_posteriors_of_a_table(spark):
    """Posteriors on sf0.001 are those of a plain naive Bayes; the rates meet the targets as well as nonnegative least squares can."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    domains, p = sorted(mixing.TARGETS), [f"p_{d}" for d in sorted(mixing.TARGETS)]
    known = mixing.quality_domains(labels)
    got = {r["doc_id"]: r for r in mixing.mix_documents(docs, known).collect()}
    texts = dict(docs.select("doc_id", F.coalesce("text", F.lit(""))).collect())
    bucket = {(w, end): b for w, end, b in spark.createDataFrame(sorted({w for t in texts.values() for w in re.split(mixing.SPACE, t) if w}), "string").select(
        "value", F.lit(False), F.pmod(F.hash(F.rtrim(F.lower("value"), F.lit(".,;:!?"))), F.lit(mixing.BUCKETS))).collect()}
    bucket |= {(e, True): b for e, b in spark.createDataFrame(sorted({w[-3:] for w, _ in bucket}), "string").select("value", F.pmod(F.hash("value", F.lit(7)), F.lit(mixing.BUCKETS))).collect()}
    features = {n: [b for w in re.split(mixing.SPACE, t) if w for b in (bucket[w, False], bucket[w[-3:], True])] for n, t in texts.items()}
    size, count = np.zeros(len(domains)), np.zeros((len(domains), mixing.BUCKETS))
    for n, d in known.filter("domain is not null").collect():
        if n in features:
            size[domains.index(d)] += 1
            count[domains.index(d), sorted(set(features[n]))] += 1
    like = np.log((count + mixing.ALPHA) / (count.sum(axis=1, keepdims=True) + mixing.ALPHA * mixing.BUCKETS))
    prior = np.log((size + mixing.ALPHA) / (size.sum() + mixing.ALPHA * len(domains)))
    for n, f in features.items():
        odds = prior - prior[0] + mixing.SOFT / (mixing.SOFT + len(f) / 2) * (like - like[0])[:, f].sum(axis=1)
        want = np.exp(odds - odds.max()) / np.exp(odds - odds.max()).sum()
        assert np.allclose([got[n][c] for c in p], want, atol=1e-6), n
    # The squared error that a plain projected gradient, one number for each document, comes to after many steps.
    tokens = np.array([r["n_tokens"] for r in got.values()], dtype=float)
    member = np.array([[r[c] for c in p] for r in got.values()]) * tokens[:, None] / tokens.sum()
    target, rate = np.array([mixing.TARGETS[d] for d in domains]), np.ones(len(tokens))
    for _ in range(20_000):
        rate = np.maximum(0, rate - member @ (member.T @ rate - target) / np.linalg.norm(member, 2) ** 2)
    least = np.linalg.norm(member.T @ rate - target)
    assert np.linalg.norm(member.T @ np.array([r["rate"] for r in got.values()]) - target) <= least + 1e-6


def test_targets_out_of_reach_are_approached(spark):
    """Documents of two domains only, a target for a third: the closed solution of least squares on the two."""
    rng = random.Random(4)
    rows = [(n, rng.randint(1, 50), a, 1 - a, 0.0) for n, a in enumerate(rng.random() for _ in range(200))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    _, reached = mixing.fit_rates(members, ["p0", "p1", "p2"], [0.5, 0.3, 0.2])
    assert np.allclose(reached, [0.5, 0.3, 0.0], atol=1e-6)


# ------------------------------------------------------------------ op5


def best_chain(d, r, k, cost):
    order = sorted(range(len(d)), key=lambda i: (d[i], r[i]))
    best = {}
    for i in order:
        best[i] = k + max([0.0] + [best[j] - cost * (d[i] - d[j] + r[i] - r[j]) for j in best if d[j] < d[i] and r[j] < r[i]])
    return max(best.values(), default=0.0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=25))
def test_fenwick_chains(points):
    d, r = [p[0] for p in points], [p[1] for p in points]
    found = chaining.chains(d, r, 5, 0.25, 10**6)
    assert sorted(i for c in found for i in c) == list(range(len(points)))
    scores = []
    for c in found:
        assert all(d[a] < d[b] and r[a] < r[b] for a, b in zip(c, c[1:], strict=False))
        scores.append(5 * len(c) - 0.25 * sum(d[b] - d[a] + r[b] - r[a] for a, b in zip(c, c[1:], strict=False)))
    assert max(scores) == pytest.approx(best_chain(d, r, 5, 0.25))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 400), max_size=90), min_size=1, max_size=4))
def test_minimizers_cover_windows(docs):
    h = common.mix(np.array([x for d in docs for x in d], dtype=np.uint64))
    bound = np.append(0, np.cumsum([len(d) for d in docs]))
    chosen = set(chaining.minimizers(h, bound, 5, 8).tolist())
    runs = common.shingle_hashes(h, 5)
    for a, b in zip(bound[:-1], bound[1:], strict=True):
        for s in range(a, b - 5 - 8 + 2):
            window = range(s, s + 8)
            least = min(runs[i] for i in window)
            assert any(runs[i] == least and (i in chosen or i and runs[i - 1] == least) for i in window)


def passage(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.randint(0, 10**6)}" for _ in range(n)]


def test_passages(spark, docs_of):
    rng = random.Random(7)
    long, other, fuzzy, short = passage(rng, 80), passage(rng, 60), passage(rng, 90), passage(rng, 30)
    edited = [w if n % 15 != 7 else f"x{n}" for n, w in enumerate(fuzzy)]
    docs = {
        1: passage(rng, 50) + long + passage(rng, 40),
        2: passage(rng, 300),
        3: long[:35] + passage(rng, 5),
        4: passage(rng, 20) + long + passage(rng, 70) + other,
        5: other + passage(rng, 10) + fuzzy,
        6: passage(rng, 100) + edited + passage(rng, 30),
        7: passage(rng, 10) + short,
        8: short + passage(rng, 100),
        9: passage(rng, 60),
        10: passage(rng, 15) + long + long,
    }
    rows = [(n, " ".join(w)) for n, w in docs.items()]
    got = {r["doc_id"]: r for r in chaining.repeats_by_document(docs_of(rows)).collect()}
    spans = {n: [(s["first"], s["n"]) for s in r["spans"]] for n, r in got.items()}
    assert spans[4] == [(20, 80)] and spans[5] == [(0, 60)] and spans[10] == [(15, 160)]
    assert len(spans[6]) == 1 and abs(spans[6][0][0] - 100) <= 2 and abs(spans[6][0][1] - 90) <= 4
    assert all(not spans[n] for n in (1, 2, 7, 8, 9)) and not spans[3]
    cut = {r["doc_id"]: r for r in chaining.cut_repeats(docs_of(rows)).collect()}
    assert cut[4]["text"] == " ".join(docs[4][:20]) + " " + " ".join(docs[4][100:]) and cut[4]["n_chars"] == len(cut[4]["text"])
    assert all(cut[n]["text"] == t for n, t in rows if n in (1, 2, 3, 7, 8, 9))


def test_repeated_runs_of_the_tables(spark):
    """Every run of 60 words that an earlier document has is inside a reported passage."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["spans"] for r in chaining.repeats_by_document(docs).collect()}
    words = {r["doc_id"]: WORD.findall(lower(r["text"])) for r in docs.collect()}
    seen = set()
    for n in sorted(words):
        runs = [hash(tuple(words[n][i : i + 60])) for i in range(len(words[n]) - 59)]
        inside = np.zeros(len(words[n]) + 60, dtype=bool)
        for s in got[n]:
            inside[s["first"] : s["first"] + s["n"]] = True
        assert all(inside[i : i + 60].all() for i, h in enumerate(runs) if h in seen), n
        seen |= set(runs)


# ------------------------------------------------------------------ op6


def test_equal_texts_and_near_texts(spark, docs_of):
    rng = random.Random(1)
    vocabulary = [f"t{n}" for n in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(60)]
    got = {r["doc_id"]: r for r in imatch.fingerprints(docs_of([*enumerate(base), (100, base[0]), (101, base[0])]), low=0.02, high=0.6).collect()}
    assert got[100]["fingerprint"] == got[101]["fingerprint"] == got[0]["fingerprint"]
    assert got[101]["near_next"] == 1.0
    assert np.mean([got[n]["near_edited"] for n in range(60)]) > np.mean([got[n]["near_next"] for n in range(1, 60)]) + 0.1


@pytest.mark.parametrize("kind", ["far", "one apart", "hot", "null", "mixed"])
def test_neighbours(spark, docs_of, monkeypatch, kind):
    """Ranges of a few rows each, whatever the ids; the next document is that of the descending order."""
    rng = random.Random(6)
    ids = {
        "far": [2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(100))],
        "one apart": [2**60, *range(100)],
        "hot": [7] * 60 + list(range(40)),
        "null": [None] * 60 + list(range(40)),
        "mixed": [None, None, 3, 3, 3, 3, -1, 2**62],
    }[kind]
    rows = [(i, f"text {n} " + "x" * rng.randint(5, 40)) for n, i in enumerate(ids)]
    monkeypatch.setattr(imatch, "RANGE_BYTES", 300)
    docs = docs_of(rows).select("doc_id", "text")
    ranged = imatch._ranged(docs)
    if len(rows) > 50:
        assert ranged.groupBy("range").count().agg(F.max("count")).first()[0] <= 30
    hashed = sorted(ranged.select("doc_id", "hash", "text", "range").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.hash, r.text), reverse=True)
    assert [r.range for r in hashed] == sorted((r.range for r in hashed), reverse=True)
    want = sorted((a.text, b.text) for a, b in zip(hashed, hashed[1:] + hashed[:1], strict=True))
    assert sorted((r.text, r.next_text) for r in imatch._neighbours(docs).filter("not ghost").collect()) == want


# ------------------------------------------------------------------ op7


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = knn_quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert got.predicted[got.quality == 1].mean() > 0.99 and got.predicted[got.quality == 0].mean() < 0.1


def test_votes_of_all_neighbours(spark):
    """The scores of the query on sf0.001 are those of a plain vote over all labelled vectors, sorted in full."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = knn_quality.fit(docs, knn_quality.training_labels(labels))
    got = {r["doc_id"]: r["score"] for r in knn_quality.quality(docs, labels).collect()}
    for n, text in docs.select("doc_id", "text").collect():
        (own,) = model.unit(knn_quality.features(*common.text_bytes(pa.array([text]))))
        near = [round(float(own @ v), 5) for v in model.vectors]
        best = sorted(range(len(near)), key=lambda i: (-near[i], i))[: model.k]
        vote = [max(near[i], 0) ** model.power for i in best]
        want = (sum(v * model.labels[i] for v, i in zip(vote, best, strict=True)) + 0.01 * model.prior) / (sum(vote) + 0.01)
        assert got[n] == pytest.approx(want, abs=2e-3)


def test_equal_neighbours_and_repeated_rows(docs_of):
    """Of equally near neighbours the same ones vote, wherever a row stands in a block."""
    rows = [(n, "good " * 20 if n % 3 else "bad! " * 20) for n in range(90)] + [(90 + n, f"other {n} words") for n in range(700)] + [(1000 + n, "so so " * 9) for n in range(5)]
    labels = docs_of([]).sparkSession.createDataFrame([(n, int(n % 2)) for n in range(90)], "doc_id long, quality int")
    model = knn_quality.fit(docs_of(rows), labels)
    for order in (rows, rows[::-1]):
        got = {}
        for r in knn_quality.score(docs_of(order), model).collect():
            got.setdefault(dict(rows)[r["doc_id"]], set()).add(r["score"])
        assert all(len(x) == 1 for x in got.values())


def test_scores_ignore_other_columns(spark, docs_of):
    rows = [(n, ("Good words stand here. " if n % 2 else "BAD!! WORDS!! ") * (3 + n % 5)) for n in range(60)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, quality int")
    model = knn_quality.fit(docs_of(rows), labels)
    a = {r["doc_id"]: r["score"] for r in knn_quality.score(docs_of(rows), model).collect()}
    b = {r["doc_id"]: r["score"] for r in knn_quality.score(docs_of([(n + 1000, t) for n, t in rows]), model).collect()}
    assert all(a[n] == b[n + 1000] for n, _ in rows)
    assert all((a[n] > 0.5) == bool(n % 2) for n, _ in rows)


# ------------------------------------------------------------------ op8


def test_blocks_of_the_benchmark(spark, docs_of):
    rng = random.Random(4)
    items = [(n, " ".join(passage(rng, rng.choice([3, 10, 25])))) for n in range(12)]
    rows = [(n, " ".join(passage(rng, 20)) + " " + (items[n % 12][1] if n % 2 else "") + " " + " ".join(passage(rng, 5))) for n in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"])
    whole = sorted(map(key, decontam.contamination(docs_of(rows), benchmark).collect()))
    assert whole == sorted(map(key, decontam.contamination(docs_of(rows), benchmark, block_bytes=300).collect()))
    assert [r[2] > 0 for r in whole] == [bool(n % 2) for n in range(40)]
    assert {r["doc_id"] for r in decontam.clean_documents(docs_of(rows), benchmark, block_bytes=300).collect()} == {n for n in range(40) if n % 2 == 0}


@pytest.mark.parametrize("block_bytes", [40, 300, 16 << 20])
def test_hits_are_those_of_a_plain_search(spark, docs_of, block_bytes):
    """Few different words, equal ids, null ids, repeated and overlapping items: as a search word by word, whatever the blocks."""
    rng = random.Random(14)
    some = lambda n: " ".join(rng.choice(["a", "a", "a", "b", "B", "c", f"d{n}"]) for _ in range(n))
    items = [(n, some(rng.choice([1, 2, 9, 10, 11, 30]))) for n in range(14)] + [(100, "a " * 400), (101, "a " * 400), (None, "c c"), (7, ""), (8, None)]
    rows = [(rng.choice([None, 5, 6, n]), some(rng.choice([0, 3, 11, 60])) + rng.choice(["", " " + items[n % 14][1]])) for n in range(60)] + [(5, "a " * 2000), (5, None), (7, "q r s")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def plain(text):
        words, hit, found = WORD.findall(lower(text or "")), set(), set()
        for i, t in items:
            own = WORD.findall(lower(t or ""))
            for a in range(max(1, len(own) - 9) if own else 0):
                w = own[a : a + 10]
                for p in range(len(words) - len(w) + 1):
                    if words[p : p + len(w)] == w:
                        hit |= set(range(p, p + len(w)))
                        found.add(str(i))
        return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()

    key = lambda i, values: (i is not None, i or 0, *values)
    # An item without an id has no name in SQL either; here it is called None.
    got = decontam.contamination(docs_of(rows), benchmark, block_bytes=block_bytes).collect()
    assert sorted(key(r["doc_id"], (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"])) for r in got) == sorted(key(i, plain(t)) for i, t in rows)
    kept = decontam.clean_documents(docs_of(rows), benchmark, block_bytes=block_bytes).collect()
    assert sorted((r["text"] or "") for r in kept) == sorted((t or "") for _, t in rows if not plain(t)[1])


# ------------------------------------------------------------------ op9


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab é\n's1&<", max_size=120), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 40), st.text(alphabet="ab é\n's1", max_size=30)), max_size=4), st.sampled_from([2, 8, 32]))
def test_counts_after_edits(text, edits, leaf):
    count = edit_tokens.counter()
    whole = lambda t: count([t])[0] if t else 0
    tree = edit_tokens.CountedText(text, count, leaf)
    assert tree.tree.tokens == whole(text)
    for start, n, new in edits:
        start = min(start, len(text))
        text = text[:start] + new + text[min(start + n, len(text)) :]
        tree.edit(start, start + n, new)
        assert tree.text == text and tree.tree.tokens == whole(text) and tree.tree.length == len(text)


def test_added_segments_move_few_others():
    """4,000 insertions at one place of a long text: each moves some leaves, not all."""
    tree = edit_tokens.CountedText("word " * 20_000, lambda parts: [len(p) for p in parts], 16)
    segments = tree.tree.used(0, tree.tree.width)
    want = "word " * 20_000
    for n in range(4000):
        tree.edit(50_000, 50_000, f" added {n} words here")
        want = want[:50_000] + f" added {n} words here" + want[50_000:]
    assert tree.text == want and tree.tree.length == len(want) == tree.tree.tokens
    assert tree.tree.used(0, tree.tree.width) > segments + 3000 and tree.moved < 4000 * 200


def test_edit_table(spark, docs_of):
    docs = docs_of([(1, "one two three"), (2, "four")])
    edits = spark.createDataFrame([(1, 2, 0, 1, "X"), (1, 1, 4, 7, "2"), (9, 1, 0, 1, "z")], "doc_id long, seq int, start int, end int, new string")
    got = {r["doc_id"]: r for r in edit_tokens.count_with_edits(edit_tokens.with_edits(docs, edits)).collect()}
    assert got[1]["edited_sha256"] == hashlib.sha256(b"Xne 2 three").hexdigest() and got[2]["n_edits"] == 0


def test_long_texts_are_mostly_left_alone(docs_of):
    text = "some words stand here and there, " * 2000
    got = edit_tokens.count_with_edits(docs_of([(1, text)]).withColumn("edits", F.array(F.struct(F.lit(30000).cast("long").alias("start"), F.lit(30010).cast("long").alias("end"), F.lit("new").alias("new"))))).first()
    assert got["reencoded_chars"] < 1000


# ------------------------------------------------------------------ op10


def similar(x, y, k=5):
    def shingles(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    a, b = shingles(x), shingles(y)
    return x == y if not a and not b else len(a & b) * 5 >= 4 * len(a | b)


@pytest.mark.parametrize("block", [3, 256])
def test_links_and_classes(docs_of, block):
    rng = random.Random(11)
    rows = []
    for family in range(6):
        base = passage(rng, 60 + 40 * family)
        for copy in range(9):
            w = list(base)
            for _ in range(copy // 2):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append(" ".join(w))
    rows += ["", None, "!", "?", "!", "one two", "One, two", rows[0].upper(), rows[0]]
    rows = [(n, t) for n, t in enumerate(rows)]
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(docs_of(rows), block=block).collect()}
    plain = [t or "" for _, t in rows]
    link = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and similar(plain[i], plain[j])}
    parent = list(range(len(rows)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for i, j in sorted(link):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    for n, _ in rows:
        assert got[n]["n_links"] == sum(1 for i, j in link if i == n), n
        assert got[n]["class_id"] == root(n)
    kept = {r["doc_id"] for r in jaccard.one_of_each(docs_of(rows), block=block).collect()}
    assert kept == {root(n) for n, _ in rows}


def test_pruning_keeps_what_may_be_similar():
    m = jaccard.least_matches(192, 0.8, 1e-6)
    assert 100 < m < 140  # five standard deviations below the threshold's mean


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), unique=True, max_size=30), min_size=2, max_size=8))
def test_intersections(sets):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sets]
    a, b = np.triu_indices(len(arrays), 1)
    many = np.concatenate([a] * 40), np.concatenate([b] * 40)
    want = [len(set(sets[i]) & set(sets[j])) for i, j in zip(a, b, strict=True)]
    assert jaccard.common_counts(arrays, a, b).tolist() == want and jaccard.common_counts(arrays, *many).tolist() == want * 40


def test_components(spark):
    rng = random.Random(9)
    edges = [(n, n + 1) for n in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(90)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    import itertools

    for a, b in edges:
        if a != b:
            assert got[a] == got[b]
    groups = itertools.groupby(sorted(got, key=lambda n: got[n]), key=lambda n: got[n])
    assert all(root == min(members) for root, members in ((k, list(g)) for k, g in groups))


def test_words_that_a_polynomial_confuses():
    """Thue-Morse words of two letters have one value under any polynomial modulo a power of two."""
    word, other = "a", "b"
    for _ in range(12):
        word, other = word + other, other + word
    h = common.Words(*common.text_bytes(pa.array([f"{word} {other}"])), common.byte_class("letters")).hash
    assert h[0] != h[1]
