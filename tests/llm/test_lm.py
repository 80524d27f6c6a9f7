"""The model of operator 4 against exact counts."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lotwise.llm import lm

PRIOR = 50.0


def exact_model(corpus):
    """Counts of tokens and bigrams of the training texts, and the probability of a token after another."""
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t, _ in corpus}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    uni, bi = Counter(), Counter()
    for i, ws in tokens.items():
        if not held[i]:
            uni.update(ws)
            bi.update(zip([b" ", *ws], ws))
    n, v = sum(uni.values()), len(uni)
    texts = sum(not h for h in held.values())

    def p(w, before):
        c = texts if before == b" " else uni[before]
        return (bi[before, w] + PRIOR * (uni[w] + 0.5) / (n + 0.5 * (v + 1))) / (c + PRIOR)

    return tokens, uni, p


def filled(n, q, size):
    bits = np.zeros(size, np.uint8)
    lm.enter(bits, n, q)
    return lm.Filter(np.packbits(bits, bitorder="little"), 1, size, int(q.max()))


def test_levels_are_never_under_and_seldom_over():
    r = np.random.default_rng(3)
    hashes = np.sort(r.integers(0, 2**64, 20000, np.uint64))
    q = lm.level(r.integers(1, 5000, 20000))
    f = filled(hashes, q, lm.part_bits(int(q.sum())))
    found = f.levels(hashes)
    assert (found >= q).all() and (found == q).mean() > 0.98
    assert (f.levels(r.integers(0, 2**64, 20000, np.uint64)) == 0).mean() > 0.97
    assert lm.level(np.array([1, 2, 3, 4, 6, 8, 2**62])).tolist() == [1, 2, 3, 4, 5, 6, 124]


def test_a_full_filter_ends_and_stays_finite():
    r = np.random.default_rng(4)
    hashes = r.integers(0, 2**64, 5000, np.uint64)
    q = lm.level(r.integers(1, 1000, 5000))
    found = filled(hashes, q, 640).levels(r.integers(0, 2**64, 2000, np.uint64))
    assert found.max() <= q.max()


def test_least_level():
    n = np.zeros(lm.LEVELS, np.int64)
    n[[1, 2, 5]] = 100, 10, 3
    for most, want in ((135, 1), (134, 2), (35, 2), (34, 3), (15, 3), (14, 6), (0, 6)):
        assert lm.least_level(n, lm.BITS * most) == want
    assert lm.least_level(np.zeros(lm.LEVELS, np.int64), 0) == 1


@pytest.mark.parametrize("top, max_bits", [(200_000, lm.MAX_BITS), (5, lm.MAX_BITS), (200_000, 20_000), (5, 20_000), (5, 0)])
def test_score_is_that_of_exact_counts_within_the_quantisation(docs, corpus, top, max_bits, monkeypatch):
    monkeypatch.setattr(lm, "TOP", top)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 14)  # several segments
    tokens, _, p = exact_model(corpus)
    rows = {r.doc_id: r for r in lm.score_texts(docs, prior=PRIOR, max_bits=max_bits).collect()}
    assert len(rows) == len(corpus)
    off = {}
    for i, ws in tokens.items():
        off[i] = abs(rows[i].score - sum(math.log10(p(w, before)) for before, w in zip([b" ", *ws], ws)))
        assert off[i] <= 0.03 * len(ws) + 6, i  # a bigram falsely found adds 3 at most
    assert sum(x <= 0.02 * len(tokens[i]) + 0.1 for i, x in off.items()) > 0.7 * len(off)


def test_probabilities_sum_to_one(spark, tmp_path):
    """Of all words after one, known or not, read from the scores of texts that differ in their last word alone."""
    r = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)]
    training = [" ".join(r.choice(words, 30, p=(x := 1.0 / np.arange(1, 41)) / x.sum())) for _ in range(200)]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [*zip(ids, training)]
    asked = [(v, w) for v in ("w0", "w7", "unheard") for w in (*words, "unknown")]
    rows += [(i, f"{v} {w}") for i, (v, w) in zip(held, asked)] + [(i, v) for i, v in zip(held[len(asked) :], ("w0", "w7", "unheard"))]
    path = str(tmp_path / "d")
    spark.createDataFrame([(int(i), str(t)) for i, t in rows], "doc_id long, text string").write.parquet(path)
    got = {x.doc_id: x.score for x in lm.score_texts(spark.read.parquet(path), prior=PRIOR).collect()}
    uni, bi = Counter(), Counter()
    for t in training:
        ws = [*t.split(), ""]
        uni.update(ws)
        bi.update(zip([" ", *ws], ws))
    n, v = sum(uni.values()), len(uni)
    prior = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    by_level = {}
    for c in bi.values():
        by_level.setdefault(int(lm.level(np.array([c]))[0]), []).append(c)

    def p(w, before, c):
        """With counts as the filter keeps them."""
        b = bi[before, w]
        return (min(c, np.mean(by_level[int(lm.level(np.array([b]))[0])]) if b else 0) + PRIOR * prior(w)) / (c + PRIOR)

    for k, before in enumerate(("w0", "w7", "unheard")):
        total = p("", before, uni[before])  # the end
        for i, (x, w) in zip(held, asked):
            if x == before:
                rest = math.log10(p(before, " ", len(training))) + math.log10(p("", w, uni[w]))
                total += 10 ** (got[i] - rest)
        assert total == pytest.approx(1, abs=0.08), before


def test_packed_numbers_come_back():
    r = np.random.default_rng(5)
    for x in ([], [0], [2**64 - 1], [0, 0, 7], [5, 5, 2**40], np.sort(r.integers(0, 2**64, 3000, np.uint64)), np.arange(300) % 3):
        x = np.array(x, np.uint64)
        assert lm.unpack(lm.pack(x)).tolist() == x.tolist()
        x.sort()
        assert lm.unpack_sorted(lm.pack_sorted(x), len(x)).tolist() == x.tolist()


def test_portions_do_not_change_scores(docs, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 14)
    whole = sorted(lm.score_texts(docs).collect())
    monkeypatch.setattr(lm, "PORTION", 1000)
    assert sorted(lm.score_texts(docs).collect()) == [(*x[:5], pytest.approx(x[5], rel=1e-12), pytest.approx(x[6], rel=1e-12)) for x in whole]


def test_disk_stays_under_the_texts(spark, docs, corpus):
    """What is checkpointed, when no part of the filter may be broadcast: it was several times the texts."""
    from pathlib import Path

    from lotwise.llm.common import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = {p for p in folder.rglob("*") if p.is_file()}
    lm.score_texts(docs, max_bits=0).collect()
    assert sum(p.stat().st_size for p in folder.rglob("*") if p.is_file() and p not in before) < sum(len((t or "").encode()) for _, t, _ in corpus)
