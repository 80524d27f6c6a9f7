"""Operator 8: URL filters, by rules first and by gradient-boosted trees on lexical features where no rule fits.

The rules label the URLs they fit; the trees are trained on a bounded sample of
those (``SAMPLE`` rows, the ones of smallest hash, so reruns agree) and judge
the others.  Features: lengths, depth, digit ratio, entropy of characters,
numbers of parameters, hyphens and labels, and statistics of the host's suffix
(its share of blocked URLs in the sample, computed out of fold for training, and
its share of the sample).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import by_batch

#: Labelled URLs that the trees are trained on, at most.
SAMPLE = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits a host and its subdomains where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))

FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_blocked", "suffix_share")


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_fit(rules: tuple[UrlRule, ...], host: Column, path: Column, what: str) -> Column:
    """Name or verdict of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, getattr(r, what)).otherwise(out)
    return out


def lexical(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    n = max(len(url), 1)
    counts = Counter(url)
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path),
        sum(1 for p in path.split("/") if p),
        host.count(".") + bool(host),
        sum(counts[d] for d in "0123456789") / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(1 for p in query.split("&") if p),
        url.count("-"),
    ]


def suffix(host: str) -> str:
    return host.rpartition(".")[2]


@dataclass
class Suffixes:
    """Blocked and all labelled URLs by suffix, in the sample."""

    blocked: Counter = field(default_factory=Counter)
    every: Counter = field(default_factory=Counter)

    def add(self, name: str, bad: bool) -> None:
        self.every[name] += 1
        self.blocked[name] += bad

    def of(self, name: str) -> list[float]:
        n, total = self.every[name], sum(self.every.values())
        prior = (sum(self.blocked.values()) + 1) / (total + 2)
        return [(self.blocked[name] + 10 * prior) / (n + 10), n / max(total, 1)]


@dataclass
class Trees:
    """Boosted regression trees on binned features; each tree is arrays of feature, bin, and leaf values of a full binary tree."""

    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for feat, cut, value in self.trees:
            out += value[descend(b, feat, cut, self.depth)]
        return out


def descend(b: np.ndarray, feat: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Each row's leaf; nodes of a level follow each other, a row goes right if its bin is over the cut."""
    node = np.zeros(len(b), np.int64)
    for level in range(depth):
        at = (1 << level) - 1 + node
        node = 2 * node + (b[np.arange(len(b)), feat[at]] > cut[at])
    return node


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss with histograms; deterministic."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    p0 = (y.sum() + 1) / (len(y) + 2)
    model = Trees(edges, math.log(p0 / (1 - p0)) if len(y) else -10.0, [], depth)
    if not len(y) or y.min() == y.max():
        return model
    b, margin = model.binned(x), np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feat, cut = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, bins, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 1 << level
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                at = node * (bins + 1) + b[:, j]
                g = np.bincount(at, grad, width * (bins + 1)).reshape(width, -1)
                h = np.bincount(at, hess, width * (bins + 1)).reshape(width, -1)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < 1) | (ht - hl < 1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for v in np.flatnonzero(top > best):
                    best[v], feat[width - 1 + v], cut[width - 1 + v] = top[v], j, k[v]
            at = width - 1 + node
            node = 2 * node + (b[np.arange(len(y)), feat[at]] > cut[at])
        g, h = np.bincount(node, grad, 1 << depth), np.bincount(node, hess, 1 << depth)
        value = -rate * g / (h + l2)
        model.trees.append((feat, cut, value))
        margin += value[node]
    return model


@dataclass
class UrlModel:
    suffixes: Suffixes
    trees: Trees

    def blocked(self, urls: list[str | None], hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probabilities."""
        if not urls:
            return np.zeros(0)
        x = np.array([lexical(u, h, p) + self.suffixes.of(suffix(h)) for u, h, p in zip(urls, hosts, paths, strict=True)], float)
        return 1 / (1 + np.exp(-self.trees.margin(x)))


def fit(rows: list[tuple[str | None, str, str, bool]], folds: int = 5) -> UrlModel:
    """rows: url, host, path, blocked."""
    whole, parts = Suffixes(), [Suffixes() for _ in range(folds)]
    for i, (_, host, _, bad) in enumerate(rows):
        whole.add(suffix(host), bad)
        for k, part in enumerate(parts):
            if i % folds != k:
                part.add(suffix(host), bad)
    x = np.array([lexical(u, h, p) + parts[i % folds].of(suffix(h)) for i, (u, h, p, _) in enumerate(rows)], float).reshape(len(rows), len(FEATURES))
    return UrlModel(whole, train(x, np.array([r[3] for r in rows], float)))


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """key, url, host, path, rule, verdict (allow or block) and p_block of every row.

    Null URLs and those without "://" have an empty host and path and are judged by the trees alone; without any labelled URL
    the trees allow.  p_block is null where a rule decides.
    """
    ship(pages.sparkSession)
    u = F.col("u")
    parts = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("u")).select("k", "u", host_of(u).alias("host"), path_of(u).alias("path"))
    host, path = F.col("host"), F.col("path")
    ruled = parts.select("*", first_fit(rules, host, path, "name").alias("rule"), first_fit(rules, host, path, "verdict").alias("ruled"))
    labelled = ruled.where("ruled is not null").select("u", "host", "path", (F.col("ruled") == "block").alias("bad"))
    # about twice the sample by hash, then exactly the sample: no partition sends more than its share
    share = min(1.0, 2 * sample / max(1, labelled.count()))
    near = labelled.where(F.shiftrightunsigned(F.xxhash64("u"), 32) < int(share * (1 << 32)))
    chosen = near.orderBy(F.xxhash64("u"), "u").limit(sample).collect()  # at most ``sample`` rows
    model = fit([tuple(r) for r in chosen])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        urls, hosts, paths, names, said = (batch.column(i).to_pylist() for i in range(1, 6))
        open_ = [i for i, v in enumerate(said) if v is None]
        p: list[float | None] = [None] * len(urls)
        for i, x in zip(open_, model.blocked([urls[i] for i in open_], [hosts[i] for i in open_], [paths[i] for i in open_]).tolist(), strict=True):
            p[i], said[i] = x, "block" if x >= threshold else "allow"
        columns = [batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array(said, pa.string()), pa.array(p, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["k", "u", "host", "path", "rule", "verdict", "p_block"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_batch(run)(it)

    kind = pages.schema[key].dataType.simpleString()
    out = ruled.mapInArrow(batches, f"k {kind}, u string, host string, path string, rule string, verdict string, p_block double")
    return out.select(F.col("k").alias(key), F.col("u").alias(url), "host", "path", "rule", "verdict", "p_block")
