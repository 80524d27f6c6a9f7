from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lotwise.llm import topk, urls


def brute(rows, k=5, every=50):
    """Every row is a candidate, repeated ones too; a query's own repeated rows are one."""
    good = sorted((i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v))
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for a in {v for i, v in good if i == q} for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block"), [(2048, 512), (37, 3)])
def test_top_k(spark, shard, block):
    r = random.Random(shard)
    rows = [(i, [r.choice([r.gauss(0, 1), 0.5]) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.25] * 6) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [9.0] * 6), (504, []), rows[0], rows[50], rows[7], rows[7], rows[7]]
    rows += [(420, [0.25] * 6)] * 9 + [(150, [0.1] * 6)]  # repeated, and a key of two vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, topk.top_k(df, shard=shard, block=block).collect())) == brute(as_float)


def test_top_k_small(spark):
    schema = "vec_id long, embedding array<float>, id string, shard string, dim string, block string, rank string"
    assert topk.top_k(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(0, [1.0], *"abcde"), (1, [2.0], *"abcde"), (2, [3.0, 1.0], *"abcde")], schema)
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]


def test_a_hot_vector_keeps_its_smallest_keys(spark):
    """Half of all rows are one vector, and the best of all: ties go to the smallest keys, repeats count."""
    rows = [(i, [4.0, 4.0]) for i in range(1000, 1400)] + [(1001, [4.0, 4.0])] * 3 + [(i, [0.01 * (i % 90), 0.5]) for i in range(400)]
    got = sorted(map(tuple, topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard=40, block=2).collect()))
    assert got == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows])


def test_cells_are_those_of_the_leaves():
    r = np.random.default_rng(5)
    points = np.floor(r.normal(size=(900, 4)) * 5)
    tree = topk.build(points, 60)
    cells = topk.cell_of(tree, points)
    assert (tree["left"][cells] < 0).all() and np.bincount(cells).max() < 200


def test_tree_prunes_and_stays_exact():
    r = np.random.default_rng(1)
    points = np.floor(r.normal(size=(3000, 3)) * 256)
    tree = topk.build(points)
    leaves = tree["left"] < 0
    assert sorted(tree["order"]) == list(range(3000)) and (tree["stop"] - tree["start"])[leaves].max() <= topk.LEAF
    q = np.floor(r.normal(size=(7, 3)) * 256)
    ids = np.arange(3000)
    found, scores = topk.search(tree, points, ids, q, np.full(7, -1), np.full(7, -np.inf), 5)
    for i in range(7):
        want = sorted((-s, j) for j, s in enumerate(points @ q[i]))[:5]
        assert [(-s, j) for s, j in zip(scores[i], found[i], strict=True)] == want


URLS = [
    (0, "http://a.example.net/en/x", "net", "a.example.net", "/en/x", "example.net/en/", "allow"),
    (1, "https://NET/", "x", "net", "/", "net/", "block"),
    (2, "https://net", "x", "net", "", None, None),
    (3, "http://ww.Example.COM/de/1?x=/fr/#t", "x", "ww.example.com", "/de/1", "example.com/de/", "block"),
    (4, "http://notexample.com/de/", "x", "notexample.com", "/de/", None, None),
    (5, "http://a.org/fr/", "x", "a.org", "/fr/", "org/fr/", "allow"),
    (6, "no scheme", "x", "", "", None, None),
    (7, None, "x", "", "", None, None),
    (8, "", "x", "", "", None, None),
    (9, "a://b://c.net/x", "x", "b:", "//c.net/x", None, None),
    (10, "http://ÄB.net?q", "x", "Äb.net", "", None, None),
    (11, "http://example.net/en/", "x", "example.net", "/en/", "example.net/en/", "allow"),
    (11, "http://example.net/en/", "x", "example.net", "/en/", "example.net/en/", "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(a, b, c, "h", "r") for a, b, c, *_ in URLS], "page_id long, url string, k string, host string, rule string")
    rows = urls.filter_urls(df).collect()
    assert len(rows) == len(URLS)
    got = {r.page_id: r for r in rows}
    for i, _, _, host, path, rule, verdict in URLS:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), i
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict) and (r.p_block is None) == (rule is not None)
    assert urls.filter_urls(df.limit(0)).collect() == []


def test_trees_learn():
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = urls.train(x[:3000], y[:3000])
    assert ((model.margin(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.95
    again = urls.train(x[:3000], y[:3000])
    assert (again.margin(x) == model.margin(x)).all()


def test_held_out_urls():
    """URLs whose label follows from their letters: the trees find it on others."""
    r = random.Random(3)
    rows = []
    for _ in range(1500):
        bad = r.random() < 0.5
        host = ("win-" + str(r.randint(100, 999)) + "-cash" if bad else r.choice(["news", "blog", "shop"])) + ".example." + r.choice(["com", "org"])
        rows.append((f"http://{host}/p/{r.randint(1, 9)}", host, f"/p/{r.randint(1, 9)}", bad))
    model = urls.fit(rows[:1000])
    p = model.blocked(*[[x[i] for x in rows[1000:]] for i in range(3)])
    assert ((p > 0.5) == np.array([x[3] for x in rows[1000:]])).mean() > 0.97
