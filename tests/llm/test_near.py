from __future__ import annotations

import random

import pytest

import corpus_pipeline
from lotwise.llm import near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def some_texts():
    r = random.Random(5)
    word = lambda: f"w{r.randint(1, 4000)}"
    out = [None, "", "  ", "one two", "One  TWO", "one two three four five", "one two three four"]
    shared = [word() for _ in range(150)]
    for i in range(40):
        base = [word() for _ in range(r.randint(20, 400))] + (shared if i % 4 == 0 else [])
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 30)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy[: len(copy) - r.randint(0, len(copy) // 8)]))
    return list(enumerate(out))


def groups(texts):
    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in sets}


def pairs(texts):
    sets = {i: shingles(t) for i, t in texts}
    return [(i, j) for i in sets for j in range(i) if similar(sets[i], sets[j])]


@pytest.mark.parametrize("hot", [near.HOT, 40])
def test_near_groups(spark, tmp_path, hot):
    texts = some_texts()
    want = groups(texts)
    assert 10 < len(set(want.values())) < len(want) - 10
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA).repartition(3).write.parquet(path)
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.read.parquet(path), hot=hot).collect()}
    assert set(got) == set(want) and all(want[i] == want[g] for i, g in got.items())  # no link that is not one
    linked = [got[i] == got[j] for i, j in pairs(texts)]
    assert sum(linked) >= 0.95 * len(linked)
    assert all(got[g] == g <= i for i, g in got.items())


def test_stage_takes_near_copies_at_the_similarity(spark, tmp_path):
    texts = some_texts()
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA).repartition(3).write.parquet(path)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(path), "unused").collect()}
    want = set(groups(texts).values())
    assert want <= got and len(got - want) <= 0.1 * (len(texts) - len(want))


def test_cluster_of_many_is_linked_without_its_pairs():
    """A group answers with a forest."""
    import numpy as np

    r = np.random.default_rng(2)
    u, v = np.triu_indices(300, 1)
    cost = r.integers(0, 20, len(u))
    taken = near.forest(u, v, cost, 300)
    assert 299 <= len(taken) <= 598
    label = np.arange(300)
    label = near.merge_labels(label, u[taken], v[taken])
    assert (label == 0).all()
    assert len(near.forest(u[:0], v[:0], cost[:0], 5)) == 0


def test_sketches_never_exceed_the_difference():
    import numpy as np

    r = np.random.default_rng(4)
    for n in (1, 5, 60, 300, 1000):
        for share in (0.0, 0.3, 0.9, 1.0):
            a = np.unique(r.integers(0, 2**64, n, np.uint64))
            b = np.unique(np.concatenate([a[: int(n * share)], r.integers(0, 2**64, max(1, n // 4), np.uint64)]))
            assert near.least_difference(near.sketch(a), near.sketch(b)) <= len(np.setxor1d(a, b))
        assert near.least_difference(near.sketch(a), near.sketch(a)) == 0
