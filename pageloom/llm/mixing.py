"""Mixing to target weights with soft membership, with DataFrame functions only.

*Posteriors.* A naive Bayes model over hashed words and word endings is learnt
from a labelled table (at most ``sample`` rows, those with the smallest hash of
the id). Its weights are ``BUCKETS`` numbers per domain, whatever the data. A
text's log odds are damped with its length, so membership stays soft.

*Rates.* A document with ``n`` tokens and posteriors ``p`` contributes
``rate * n * p`` to each domain. Nonnegative rates are sought for which the
expected totals meet the targets: projected gradient on the squared error,
``rate = max(0, rate - p . M (totals - targets))``, a document weighing as much
as its tokens. ``M`` is the inverse of the domains' Gram matrix, for which a
step of one never raises the error; once some rates are zero, the Gram matrix of
the others is tried first. A document's rate is a function of its posteriors
and of the steps so far, a few numbers each, so every step is one grouped sum
over the table of posteriors and no state is kept per document.

Edge cases: null or empty texts have no tokens and the prior as posterior; they
get a rate and weigh nothing. Ids may repeat or be null in ``docs``; a label of
a null id is ignored. With no labels posteriors are equal shares. A target that
nonnegative rates can't reach is approached. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import settle, text_column

BUCKETS, SAMPLE, ALPHA, SOFT = 4096, 20_000, 0.5, 4.0
STEPS, CLOSE = 30, 1e-7
TARGETS = {"clean": 0.80, "low": 0.12, "toxic": 0.08}
SPACE = r"[ \t\n\x0B\f\r]+"


def _buckets(words):
    """Two hashed features of each word: itself without marks at its end, and its last three characters."""
    whole = F.transform(words, lambda w: F.pmod(F.hash(F.rtrim(F.lower(w), F.lit(".,;:!?"))), F.lit(BUCKETS)))
    ends = F.transform(words, lambda w: F.pmod(F.hash(F.right(w, F.lit(3)), F.lit(7)), F.lit(BUCKETS)))
    return F.concat(whole, ends)


def _words(text):
    return F.array_remove(F.split(text, SPACE), "")


def _weights(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Log priors, and log likelihoods of each bucket by domain."""
    chosen = labelled.filter("doc_id is not null").filter(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    # explode_outer: an inferred filter on the array would be moved below the join and run for every text.
    texts = docs.join(F.broadcast(chosen), "doc_id").select("domain", F.array_distinct(_buckets(_words(F.col("text")))).alias("b"))  # `sample` short rows
    counts = np.zeros((len(domains), BUCKETS))
    for domain, bucket, n in texts.select("domain", F.explode_outer("b").alias("b")).filter("b is not null").groupBy("domain", "b").count().collect():  # domains * BUCKETS rows at most
        counts[domains.index(domain), bucket] = n
    sizes = np.zeros(len(domains))
    for domain, n in texts.groupBy("domain").count().collect():
        sizes[domains.index(domain)] = n
    prior = np.log((sizes + ALPHA) / (sizes.sum() + ALPHA * len(domains)))
    like = np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * BUCKETS))
    return prior, like - like.mean(axis=0)


def _numbers(values) -> F.Column:
    """A constant array of doubles."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..`` for every document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text"))
    prior, like = _weights(docs, labelled, domains, sample)
    read = docs.select("doc_id", _words(F.col("text")).alias("words")).select("doc_id", F.size("words").cast("long").alias("n_tokens"), _buckets(F.col("words")).alias("b"))
    damp = F.lit(SOFT) / (F.lit(SOFT) + F.col("n_tokens"))
    added = lambda weights: F.aggregate("b", F.lit(0.0), lambda acc, i: acc + F.get(weights, i))
    # Log odds against the first domain.
    odds = [F.lit(float(prior[j] - prior[0])) + damp * added(_numbers(like[j] - like[0])) for j in range(1, len(domains))]
    scored = read.select("doc_id", "n_tokens", F.lit(0.0).alias("o0"), *(o.alias(f"o{j}") for j, o in enumerate(odds, 1)))
    names = [f"o{j}" for j in range(len(domains))]
    top = F.greatest(*names) if len(names) > 1 else F.col("o0")
    raised = scored.withColumn("top", top).select("doc_id", "n_tokens", *(F.exp(F.col(n) - F.col("top")).alias(n) for n in names))
    whole = sum(map(F.col, names[1:]), F.col("o0"))
    return raised.select("doc_id", "n_tokens", *((F.col(n) / whole).alias(f"p_{d}") for n, d in zip(names, domains, strict=True)))


def _rate(steps: list[np.ndarray], p: list[str]):
    """A document's rate after the given steps."""
    rate = F.lit(1.0)
    for g in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(c) * float(x) for c, x in zip(p[1:], g[1:], strict=True)), F.col(p[0]) * float(g[0])))
    return rate


def fit_rates(members: DataFrame, p: list[str], targets: list[float], most: int = STEPS, close: float = CLOSE) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps to rates whose expected shares of the tokens meet ``targets``; also the shares reached.

    ``members``: ``n_tokens`` and the posteriors ``p``. One grouped sum per step.
    """
    j, weight = len(p), F.col("n_tokens").cast("double")
    pairs = [(a, b) for a in range(j) for b in range(a, j)]

    def look(steps):
        rate = members.select("n_tokens", *p, _rate(steps, p).alias("rate"))
        free = F.when(F.col("rate") > 0, weight).otherwise(0.0)
        got = rate.agg(F.sum(weight), *(F.sum(weight * F.col("rate") * F.col(c)) for c in p), *(F.sum(w * F.col(p[a]) * F.col(p[b])) for w in (weight, free) for a, b in pairs)).first()
        total = got[0] or 0.0
        grams = []
        for at in (1 + j, 1 + j + len(pairs)):
            gram = np.zeros((j, j))
            for (a, b), x in zip(pairs, got[at:], strict=False):
                gram[a, b] = gram[b, a] = (x or 0.0) / max(total, 1e-300)
            grams.append(gram)
        return total, np.array([x or 0.0 for x in got[1 : 1 + j]]) / max(total, 1e-300), grams

    w = np.array(targets) / sum(targets)
    steps: list[np.ndarray] = []
    total, reached, (gram, free) = look(steps)
    far, safe = np.abs(reached - w).max(), False
    while total and far > close and len(steps) < most:
        step = np.linalg.pinv(gram if safe else free, hermitian=True) @ (reached - w)
        _, new, (_, new_free) = look([*steps, step])
        if np.abs(new - w).max() >= far:
            if safe:
                break
            safe = True  # only steps that can't raise the error from here on
            continue
        steps.append(step)
        reached, free, far = new, new_free, np.abs(new - w).max()
    return steps, reached


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_tokens, p_<domain>.., rate, expected_tokens``, one row per document.

    ``labelled``: ``(doc_id, domain)``. The targets are shares of all tokens.
    """
    targets = targets or TARGETS
    domains = sorted(targets)
    p = [f"p_{d}" for d in domains]
    members = settle(posteriors(docs, labelled, domains, doc_id, text, sample), "members")
    steps, _ = fit_rates(members, p, [targets[d] for d in domains])
    return members.withColumn("rate", _rate(steps, p)).withColumn("expected_tokens", F.col("rate") * F.col("n_tokens"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """Domains from a table of labels: ``toxic``, ``low`` (quality 0) or ``clean``."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))
