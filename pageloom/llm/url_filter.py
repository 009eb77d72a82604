"""URL filters by a path-template tree, with DataFrame functions only.

*Templates.* A url's path is cut into segments; digits become ``*`` at once.
Level by level, within the host and the template above, a segment that occurs
fewer than ``support`` times becomes ``*`` too; segments so deep that fewer than
``support`` paths reach them are one ``**`` (the first ``depth`` stay apart). Only the table of different shapes (host, segments) is grouped
and joined for this, and urls meet it once more at the end, by their shape.

*Merging.* From the leaves up, a branch whose share of good labels does not
differ from that of its parent (a z test on counts, or too few labels) is merged
with its like siblings; the others keep their own share.

*Verdict.* The share of good labels of a branch, smoothed by its parent's share
with the weight of ``prior`` labels, is its purity. Templates below
``threshold`` are rejected: the verdict is ``block``.

*Rules* decide first: a rule is a host and the begin of a path, holds for all
subdomains, and the longest that fits wins (of equally long ones, the first in
alphabetical order).

Edge cases: a null url or one without ``://`` has an empty host and path and is
judged like any other host; labels that are null are not counted; repeated rows
count each; extra columns are ignored; with no label at all everything that no
rule judges is allowed. A very long url is one with many segments, judged by those
that ``support`` paths reach; an empty table gives an empty result; a share that
is just at the threshold is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import forget, settle

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DEPTH, SUPPORT, LEAST_LABELS, Z2, PRIOR, THRESHOLD = 3, 20, 8, 3.84, 10.0, 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """What stands between the first ``://`` and ``/ ? #``, and the path up to ``? #``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES):
    """The longest fitting rule (null: none) and what it says."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in reversed(ordered):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, says = F.when(fits, rule).otherwise(name), F.when(fits, verdict).otherwise(says)
    return name, says


def _shape(path, depth):
    """``depth`` segments with digits as ``*``; missing ones are null, what is deeper is ``**``."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"[0-9]+", "*"), "/")
    return [F.when(F.size(parts) >= n + 1, F.try_element_at(parts, F.lit(n + 1))) for n in range(depth)] + [F.when(F.size(parts) > depth, "**")]


def _deepest(pages: DataFrame, url: str, depth: int, support: int) -> int:
    """Levels that ``support`` paths reach, ``depth`` at least; no deeper segment can have support."""
    cut = F.split(F.regexp_replace(host_and_path(url)[1], r"^/", ""), "/")
    sizes = sorted((tuple(x) for x in pages.groupBy(F.size(cut).alias("size")).count().collect()), reverse=True)  # a row per length of a path
    reached = 0
    for size, n in sizes:
        reached += n
        if reached >= support:
            return max(depth, size)
    return depth


def templates(shapes: DataFrame, depth: int = DEPTH, support: int = SUPPORT) -> DataFrame:
    """Templates for a table of shapes ``(host, s0.., n, labelled, good)``, which is settled: adds ``t0..``.

    Each level is settled, so the plan does not grow with the depth, and both
    sides of its join are plain tables, so that a host with very many shapes can be split.
    """
    out = shapes
    for level in range(depth):
        above = ["host", *(f"t{i}" for i in range(level))]
        key = [*above, f"s{level}"]
        often = settle(out.groupBy(*key).agg(F.sum("n").alias("_n")), "often")
        names = {c: f"_{c}" for c in key}
        renamed = often.select(*(F.col(c).alias(n) for c, n in names.items()), "_n")
        same = F.lit(True)
        for c, n in names.items():
            same = same & F.col(c).eqNullSafe(F.col(n))
        named = out.join(renamed, same).withColumn(f"t{level}", F.when(F.col("_n") >= support, F.col(f"s{level}")).otherwise(F.when(F.col(f"s{level}").isNotNull(), "*"))).drop(*names.values(), "_n")
        if level == depth - 1:
            named = named.withColumnRenamed(f"s{depth}", f"t{depth}")
        before, out = out, settle(named, "templates")
        forget(before, often)
    return out


def _purity(tree: DataFrame, depth: int, least: int, z2: float, prior: float) -> DataFrame:
    """Smoothed purity of each template, from the root down, with like branches merged."""
    levels = ["host", *(f"t{i}" for i in range(depth + 1))]
    counts = [F.sum("labelled").alias("l"), F.sum("good").alias("g")]
    total = tree.agg(F.sum("labelled").alias("l"), F.sum("good").alias("g")).select(((F.coalesce("g", F.lit(0)) + 1) / (F.coalesce("l", F.lit(0)) + 1)).alias("q"))
    root = total.first()["q"]
    above, done = None, []
    for n in range(1, len(levels) + 1):
        key, up = levels[:n], levels[: n - 1]
        at = tree.groupBy(*key).agg(*counts)
        if above is None:
            at = at.withColumn("q_up", F.lit(root))
        else:
            at = at.join(above, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in up]).drop(*(f"_{c}" for c in up))
        expected = F.col("l") * F.col("q_up")
        apart = (F.col("l") >= least) & (F.pow(F.col("g") - expected, 2) > z2 * F.greatest(expected * (1 - F.col("q_up")), F.lit(1e-9)))
        at = settle(at.withColumn("own", apart), "branches")
        done.append(at)
        merged = at.groupBy(*up, "own", "q_up") if up else at.groupBy("own", "q_up")
        pool = merged.agg(F.sum("l").alias("pl"), F.sum("g").alias("pg")).filter("not own")
        same = F.lit(True)
        for c in up:
            same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
        if up:
            at = at.join(pool.select(*(F.col(c).alias(f"_p_{c}") for c in up), "pl", "pg"), same, "left").drop(*(f"_p_{c}" for c in up))
        else:
            row = pool.first()  # of all hosts together, one row
            at = at.withColumns({c: F.lit(float(row[c] or 0) if row else 0.0) for c in ("pl", "pg")})
        labelled, good = F.when(F.col("own"), F.col("l")).otherwise(F.col("pl")), F.when(F.col("own"), F.col("g")).otherwise(F.col("pg"))
        at = at.withColumn("q", (good + prior * F.col("q_up")) / (labelled + prior))
        above = at.select(*(F.col(c).alias(f"_{c}") for c in key), F.col("q").alias("q_up"))
        leaf = at
    out = settle(leaf.select(*levels, F.col("l").alias("n_labelled"), F.col("q").alias("purity")), "purity")
    forget(*done)
    return out


def judge_urls(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, depth: int = DEPTH, support: int = SUPPORT, least_labels: int = LEAST_LABELS, z2: float = Z2, prior: float = PRIOR, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, template, purity``.

    ``labels``: ``(url_key, good)`` with at most one row for a key; ``good`` is
    1, 0 or null, the key is the number in a page's path.
    """
    depth = _deepest(pages, url, depth, support)
    host, path = host_and_path(url)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    s = [f"s{n}" for n in range(depth + 1)]
    base = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    base = base.select("*", rule.alias("rule"), says.alias("says"), *(c.alias(n) for c, n in zip(_shape(F.col("path"), depth), s, strict=True)))
    key = F.regexp_extract("path", r"([0-9]+)", 1)
    known = base.select("host", *s, F.when(key != "", key).cast("decimal(38,0)").cast("long").alias("url_key")).join(labels.select("url_key", "good"), "url_key", "left")
    shapes = known.groupBy("host", *s).agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    tree = templates(settle(shapes, "shapes"), depth, support)
    t = [f"t{n}" for n in range(depth + 1)]
    purity = _purity(tree, depth, least_labels, z2, prior)
    verdicts = tree.select("host", *s[:-1], *t).withColumn(s[-1], F.col(t[-1]))
    same = F.lit(True)
    for c in ["host", *t]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    verdicts = verdicts.join(purity.select(*(F.col(c).alias(f"_{c}") for c in ["host", *t]), "n_labelled", "purity"), same)
    named = verdicts.select(*(F.col(c).alias(f"_{c}") for c in ["host", *s]), F.concat(F.col("host"), F.lit("/"), F.concat_ws("/", *t)).alias("template"), "n_labelled", "purity")
    named = settle(named, "verdicts")
    forget(tree, purity)
    on = F.lit(True)
    for c in ["host", *s]:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = base.join(named, on, "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("purity") < threshold, "block").otherwise("allow")).alias("verdict"), "template", "n_labelled", F.round("purity", 6).alias("purity")
    )
