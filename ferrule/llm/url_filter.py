"""URL filters: fixed rules first, then gradient-boosted trees (operator 9).

Features are lexical: lengths, depth, digit ratio, entropy, parameter counts, and how
often the labelled URLs with the same suffix of the host, or the same first part of the
path, are blocked. Labels are the verdicts of the rules, where one fits; no other URL
is labelled, and another table of labels can be given. The trees are fitted on a bounded
hash sample of the labelled URLs and judge what no rule fits.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import sampled

#: Fixed rules of the contract: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The trees are fitted on about SAMPLE labelled URLs; one in HELD_OUT hosts is kept apart to measure their error.
SAMPLE, HELD_OUT = 20_000, 5
ROUNDS, DEPTH, BINS, RATE, LEAST, L2 = 40, 3, 32, 0.3, 20, 1.0
#: Weight of the overall rate in the rates of suffixes, and parts in which each URL's rates come from the other parts.
SMOOTH, PARTS = 20.0, 5
BASIC = ("length", "host_length", "path_length", "depth", "digits", "entropy", "params", "labels", "hyphens", "host_digits", "host_entropy", "fragment", "extension")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column) -> Column:
    """The longest rule whose host is the URL's or a parent of it and whose path starts the URL's; null if none."""
    chosen = F.lit(None).cast("string")
    for rule, _ in sorted(RULES, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, rule).otherwise(chosen)
    return chosen


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str) -> tuple[list[float], tuple[str, str, str]]:
    """Basic features; the host's suffixes of one and two labels and the path's first part."""
    url = url or ""
    labels = [x for x in host.split(".") if x]
    head, _, fragment = url.partition("#")
    query = head.partition("?")[2]
    n = max(1, len(url))
    basic = [
        len(url), len(host), len(path), sum(1 for x in path.split("/") if x), sum(c.isdigit() for c in url) / n, _entropy(url), sum(1 for x in query.split("&") if x),
        len(labels), host.count("-"), sum(c.isdigit() for c in host), _entropy(host), float(bool(fragment)), float("." in path.rpartition("/")[2]),
    ]
    return basic, (".".join(labels[-1:]), ".".join(labels[-2:]), "/" + path[1:].partition("/")[0])


@dataclass
class Boosted:
    """Binary gradient boosting with histogram splits and logistic loss."""

    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, float, float]]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.prior = math.log(p / (1 - p))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)
        score = np.full(len(y), self.prior)
        for _ in range(ROUNDS):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            tree: list[tuple[int, float, float]] = [(-1, 0.0, 0.0)] * ((2 << DEPTH) - 1)
            at = np.zeros(len(y), dtype=int)
            for node in range(len(tree)):
                own = np.flatnonzero(at == node)
                if not len(own):
                    continue
                g, h = grad[own].sum(), hess[own].sum()
                tree[node] = (-1, 0.0, RATE * g / (h + L2))
                if node >= (1 << DEPTH) - 1 or len(own) < 2 * LEAST:
                    continue
                best = (1e-6, -1, 0)
                for j, e in enumerate(self.edges):
                    if not len(e):
                        continue
                    b = bins[own, j]
                    gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (grad[own], hess[own], np.ones(len(own))))
                    gain = gs**2 / (hs + L2) + (g - gs) ** 2 / (h - hs + L2) - g**2 / (h + L2)
                    gain[(ns < LEAST) | (len(own) - ns < LEAST)] = 0
                    k = int(np.argmax(gain))
                    best = max(best, (float(gain[k]), j, k), key=lambda t: t[0])
                if best[1] >= 0:
                    j, k = best[1], best[2]
                    tree[node] = (j, float(self.edges[j][k]), tree[node][2])
                    at[own] = 2 * node + 1 + (bins[own, j] > k)
            self.trees.append(tree)
            score = score + self._tree(tree, x)
        return self

    @staticmethod
    def _tree(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array([t[i] for t in tree]) for i in range(3))
        at = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            f = feature[at].astype(int)
            at = np.where(f >= 0, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]), at)
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.prior + sum((self._tree(t, x) for t in self.trees), np.zeros(len(x))))))


def _rates(pairs: list[tuple[str, ...]], y: np.ndarray) -> dict[tuple[int, str], float]:
    """The smoothed share of blocked URLs of each suffix that is common enough to tell anything; this bounds the table by the sample."""
    seen: dict[tuple[int, str], list[float]] = {}
    for pair, label in zip(pairs, y, strict=True):
        for key in enumerate(pair):
            t = seen.setdefault(key, [0.0, 0.0])
            t[0] += label
            t[1] += 1
    base = float(y.mean()) if len(y) else 0.0
    return {k: (b + SMOOTH * base) / (n + SMOOTH) for k, (b, n) in seen.items() if n >= LEAST}


def _features(basic: list[list[float]], pairs: list[tuple[str, ...]], rates: dict[tuple[int, str], float], base: float) -> np.ndarray:
    rate = [[rates.get(key, base) for key in enumerate(pair)] for pair in pairs]
    return np.concatenate([np.array(basic, dtype=float).reshape(-1, len(BASIC)), np.array(rate, dtype=float).reshape(-1, 3)], axis=1)


@dataclass
class Model:
    trees: Boosted | None
    rates: dict[tuple[int, str], float]
    base: float

    def predict(self, urls: list[tuple[str | None, str, str]]) -> np.ndarray:
        """The probability of each (url, host, path) to be blocked."""
        if not self.trees or not urls:
            return np.full(len(urls), self.base)
        parts = [lexical(*r) for r in urls]
        return self.trees.predict(_features([p[0] for p in parts], [p[1] for p in parts], self.rates, self.base))


def fit(labelled: list[tuple[str | None, str, str, int]]) -> Model:
    """From (url, host, path, 1 if blocked); labels of one kind only teach nothing, and nothing is blocked."""
    y = np.array([r[3] for r in labelled], dtype=float)
    base = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return Model(None, {}, 0.0)
    parts = [lexical(*r[:3]) for r in labelled]
    basic, pairs = [p[0] for p in parts], [p[1] for p in parts]
    # a URL's own label has no part in its rates: they would give it away
    part = np.arange(len(y)) % PARTS
    x = np.zeros((len(y), len(BASIC) + 3))
    for k in range(PARTS):
        own = np.flatnonzero(part == k)
        other = np.flatnonzero(part != k)
        rates = _rates([pairs[i] for i in other], y[other])
        x[own] = _features([basic[i] for i in own], [pairs[i] for i in own], rates, base)
    return Model(Boosted().fit(x, y), _rates(pairs, y), base)


def sample(labelled: DataFrame) -> list[tuple[str | None, str, str, int]]:
    """(url, host, path, 1 if blocked) of about SAMPLE distinct rows of url, host, path, blocked."""
    n = labelled.count()
    if not n:
        return []
    few = labelled.where(sampled(F.xxhash64("url"), SAMPLE / n)).distinct().orderBy(F.xxhash64("url"), "url").limit(2 * SAMPLE)
    return [(r["url"], r["host"], r["path"], int(r["blocked"])) for r in few.toArrow().to_pylist()]


def held_out_error(labelled: list[tuple[str | None, str, str, int]]) -> tuple[float, int]:
    """(share of wrong verdicts, URLs) on the hosts that are kept apart from a fit on the others."""
    apart = lambda host: xxhash.xxh64_intdigest(host) % HELD_OUT == 0
    test = [r for r in labelled if apart(r[1])]
    score = fit([r for r in labelled if not apart(r[1])]).predict([r[:3] for r in test])
    return (float(((score >= 0.5) != np.array([r[3] for r in test])).mean()) if test else 0.0), len(test)


def judged(pages: DataFrame) -> DataFrame:
    """All columns with `__url`, host, path, rule and the rule's verdict (null if none fits)."""
    verdict = F.lit(None).cast("string")
    for rule, what in RULES:
        verdict = F.when(F.col("rule") == rule, what).otherwise(verdict)
    split = pages.withColumn("host", F.coalesce(host_of(F.col("__url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("__url")), F.lit("")))
    return split.withColumn("rule", fitting_rule(F.col("host"), F.col("path"))).withColumn("by_rule", verdict)


def url_filter(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Operator 9: page_id, host, path, rule, verdict, score of every page's url.

    `labelled` (url, host, path, blocked) teaches the trees; without it, the URLs that
    a rule fits do. A null url, or one without `://`, has an empty host and path and is
    judged by its other features; repeated rows give repeated rows; an empty table gives
    no rows; other columns are ignored.
    """
    rows = judged(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("__url")))
    if labelled is None:
        labelled = rows.where(F.col("by_rule").isNotNull()).select(F.col("__url").alias("url"), "host", "path", (F.col("by_rule") == "block").alias("blocked"))
    model = fit(sample(labelled))

    def run(batches):
        for batch in batches:
            urls, hosts, paths, rules = (batch.column(c).to_pylist() for c in ("__url", "host", "path", "by_rule"))
            score = model.predict(list(zip(urls, hosts, paths, strict=True)))
            verdicts = [r or ("block" if s >= 0.5 else "allow") for r, s in zip(rules, score, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path", "rule")] + [pa.array(verdicts, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.select("page_id", "__url", "host", "path", "rule", "by_rule").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
