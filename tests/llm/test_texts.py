"""Operators on documents against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from lotwise.llm import bpe, components, lines, lm, mixing, quality, simhash, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


# 1 -----------------------------------------------------------------------------


def fingerprint(text, k):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def groups_of(fps, bits):
    """Smallest index reachable, by flooding."""
    out = {}
    for i in range(len(fps)):
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                x = todo.pop()
                for y in range(len(fps)):
                    if y not in seen and (fps[x] ^ fps[y]).bit_count() <= bits:
                        seen.add(y)
                        todo.append(y)
            out |= {x: min(seen) for x in seen}
    return out


@pytest.mark.parametrize("shingle", [4, 5])
def test_simhash(docs, corpus, shingle):
    fps = [fingerprint(t, shingle) for _, t, _ in corpus]
    want = groups_of(fps, 4)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.simhash_groups(docs, shingle=shingle, bits=4).collect()}
    assert got == {i: (fps[i], want[i]) for i in range(len(corpus))}


@pytest.mark.parametrize(("bits", "hot"), [(4, 2048), (4, 8), (7, 2048), (2, 3)])
def test_near_fingerprints_lose_no_link(spark, bits, hot):
    r = random.Random(bits)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(30)} | {r.getrandbits(64) for _ in range(200)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    label = {f: f for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for row in simhash.links(df, bits, hot).collect():
        u, v = row["u"] % 2**64, row["v"] % 2**64
        label[max(root(u), root(v))] = min(root(u), root(v))
    want = groups_of(fps, bits)
    assert {f: root(f) for f in fps} == {f: fps[want[i]] for i, f in enumerate(fps)}


def test_thresholds_cover_the_distance():
    blocks = [list(range(2 * i, 2 * i + 2)) for i in range(32)]
    for n in (10, 10**6, 10**10):
        for bits in (1, 4, 9):
            plan = simhash.make_plan(blocks, np.full((32, 4), max(1, n // 4)), n, bits)
            assert sum(t + 1 for t in plan.radii) >= bits + 1
            used = [b for p in plan.parts for b in p]
            assert len(used) == len(set(used)) and max(map(len, plan.parts)) <= 32


@pytest.mark.parametrize("local", [components.LOCAL, 7])
def test_components(spark, local):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for u, v in links:
        label[max(root(u), root(v))] = min(root(u), root(v))
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "u long, v long"), local).collect()}
    assert got == {x: root(x) for x in list(label) if root(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 2 -----------------------------------------------------------------------------


def features(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    again = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(again)


@pytest.mark.parametrize("few", [32, 0])
def test_quality_features(docs, corpus, few, monkeypatch):
    monkeypatch.setattr(quality, "FEW", few)
    rows = {r.doc_id: r for r in quality.judge(docs, carry=["doc_id"]).collect()}
    assert len(rows) == len(corpus)
    for i, text, _ in corpus:
        f = features(text)
        assert tuple(rows[i][c] for c in quality.FEATURES) == f, i
        assert rows[i].base_failed == (f[0] < 50 or 100 * f[4] > 50 * f[0])
        assert not (rows[i].kept and rows[i].base_failed)
    assert not rows[next(i for i, t, _ in corpus if t and "***" in t)].kept
    assert sum(r.kept for r in rows.values()) >= 40


def more_features(text):
    w = words(text or "")
    known = {*quality.FUNCTION_WORDS, *(x.capitalize() for x in quality.FUNCTION_WORDS)}
    return {"n_lines": sum(bool(WORD.search(x)) for x in (text or "").split("\n")), "n_function_words": sum(x in known for x in w), "n_sentence_ends": sum(x[-1] in ".!?" for x in w)}


def brute_posteriors(rows, rules, rounds=30, share=0.8):
    """Expectation-maximisation row by row; rows: features."""
    votes = []
    for f in rows:
        said = {k: eval(re.sub(r"(\S+) between (.+?) and (.+)", r"\2 <= \1 <= \3", cond).replace(" = ", " == "), {}, f) for r in rules for k, cond in ((f"{r.name}+", r.good), (f"{r.name}-", r.bad))}
        votes.append([1 if said[f"{r.name}+"] else -1 if said[f"{r.name}-"] else 0 for r in rules])
    good = [{v: quality.first_guess(r)[0][i] for i, v in enumerate((1, -1, 0))} for r in rules]
    bad = [{v: quality.first_guess(r)[1][i] for i, v in enumerate((1, -1, 0))} for r in rules]

    def posterior(v):
        a, b = share, 1 - share
        for i, x in enumerate(v):
            a, b = a * good[i][x], b * bad[i][x]
        return a / (a + b)

    for _ in range(rounds):
        p = [posterior(v) for v in votes]
        a, n = sum(p), len(p)
        share = (a + 0.5) / (n + 1)
        for i in range(len(rules)):
            for x in (1, -1, 0):
                hit = sum(q for q, v in zip(p, votes) if v[i] == x)
                good[i][x], bad[i][x] = (hit + 0.5) / (a + 1.5), (sum(v[i] == x for v in votes) - hit + 0.5) / (n - a + 1.5)
    return [posterior(v) for v in votes]


def test_verdict_is_that_of_em_row_by_row(spark, tmp_path):
    r = random.Random(9)
    noun = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9)))

    def text(kind):
        out = []
        for _ in range(r.randint(60, 200)):
            w = r.choice(quality.FUNCTION_WORDS) if r.random() < (0.35 if kind < 8 else 0.05) else noun()
            w += "***" if kind == 9 and r.random() < 0.8 else ""
            out.append(w + ("." if r.random() < 0.09 else "") + ("\n" if r.random() < 0.05 else ""))
        return " ".join(out) + (" buy now cheap" * 20 if kind == 1 else "")

    texts = [(i, text(i % 10)) for i in range(120)] + [(200, ""), (201, None), (202, "too short")]
    path = str(tmp_path / "d")
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(path)
    got = {x.doc_id: x for x in quality.judge(spark.read.parquet(path), carry=["doc_id"]).collect()}
    rows = {i: dict(zip(quality.FEATURES, (f := features(t))), **more_features(t)) | {"failed": f[0] < 50 or 100 * f[4] > 50 * f[0]} for i, t in texts}
    assert all(got[i][c] == rows[i][c] for i in rows for c in quality.MORE)
    fine = [i for i in rows if not rows[i]["failed"]]
    p = dict(zip(fine, brute_posteriors([rows[i] for i in fine], quality.RULES)))
    for i, x in got.items():
        assert x.base_failed == rows[i]["failed"] and x.kept == (not x.base_failed and p[i] >= 0.5)
        assert i not in p or x.p_good == pytest.approx(p[i], abs=2e-3)
    kept = [got[i].kept for i in fine]
    votes = {v.name: [got[i][f"vote_{v.name}"] for i in fine] for v in quality.RULES}
    assert 0 < sum(kept) < len(kept) and sum([x == 1 for x in v] == kept for v in votes.values()) <= 1
    assert [all(x >= 0 for x in v) for v in zip(*votes.values())] != kept  # not all must pass


def test_em_finds_accuracies(spark):
    """Votes drawn from a known model: estimates and posteriors come close to it."""
    r = random.Random(2)
    rules = tuple(quality.Rule(f"r{i}", "x", "y") for i in range(5))
    right = (0.95, 0.9, 0.8, 0.7, 0.85)
    rows = []
    for _ in range(6000):
        good = r.random() < 0.7
        rows.append([good, *[0 if r.random() < 0.2 else (1 if good == (r.random() < a) else -1) for a in right]])
    votes = spark.createDataFrame(rows, "good boolean, " + ", ".join(f"vote_r{i} tinyint" for i in range(5)))
    model = quality.fit(votes, rules, rounds=60)
    assert abs(model.share - 0.7) < 0.04
    for i, a in enumerate(right):
        good, _ = model.rates[f"r{i}"]
        assert abs(good[0] / (good[0] + good[1]) - a) < 0.05
    hit = votes.withColumn("p", quality.posterior(rules, model)).agg(F.avg(F.when((F.col("p") > 0.5) == F.col("good"), 1.0).otherwise(0.0))).first()[0]
    assert hit > 0.93


# 3 -----------------------------------------------------------------------------


def left_over(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if n[b[s : s + length]] > 1:
                gone[s : s + length] = True
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "hot"), [(200, 4096), (200, 2), (64, 4096)])
def test_suffixes(docs, corpus, length, hot):
    want = left_over([t for _, t, _ in corpus], length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs, length=length, hot=hot).collect()}
    assert got == {i: w for (i, _, _), w in zip(corpus, want, strict=True)}


def test_texts_are_dealt_out_once(spark, docs):
    """Fetching contexts and removing spans read one exchange of the texts."""
    out = suffixes.remove_repeats(docs)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_cover_and_strides(monkeypatch):
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    r = random.Random(5)
    text = bytes(r.choice(b"ab") for _ in range(3000))
    monkeypatch.setattr(suffixes, "STRIDE", 257)
    _, _, place = suffixes.anchors(text)
    first, offset, n = suffixes.unpack(place)
    assert (offset < 169).all()
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(text) - 199
    t = np.frombuffer(text + bytes(600), np.uint8)
    rank = suffixes.cover_ranks(t, 3000, 200)
    at = np.flatnonzero(rank[:3000] >= 0)
    order = at[np.argsort(rank[at], kind="stable")]
    pieces = [t[p : p + 200].tobytes() for p in order]
    assert pieces == sorted(pieces)


# 4 -----------------------------------------------------------------------------


@pytest.mark.parametrize("top", [200_000, 5])
def test_language_model(docs, corpus, top, monkeypatch):
    monkeypatch.setattr(lm, "TOP", top)
    rows = {r.doc_id: r for r in lm.score_texts(docs, prior=50).collect()}
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, t, _ in corpus}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0
    trained = [r for r in rows.values() if not r.held_out]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)


# 5, 7 --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PARTS = ["a", "e", "th", "ing", " ", "\n", "  ", "é", "ß", "1", "23", "$", "***", "<|endoftext|>", "日本", "\u00a0", "\u2003", "\x1c", "\u0085", "😀", "'s", "'S", "\t", "a" * 30, "ab" * 30, "!" * 20, "\x00"]


@pytest.mark.parametrize("leaf", [16, 64, 4096])
def test_encoding_is_the_librarys(tokenizer, leaf):
    r, coder = random.Random(leaf), bpe.Bpe("byte_bpe_50k.json", leaf)
    for i in range(300):
        text = "".join(r.choice(PARTS if i % 2 else PARTS[:4] + PARTS[7:9]) for _ in range(r.randint(0, 120)))
        ids = coder.encode(text)
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert coder.decode(ids) == tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text


def test_long_unsplit_piece(tokenizer):
    r = random.Random(9)
    text = "".join(r.choice("abcdefgh") for _ in range(40_000))
    assert bpe.Bpe("byte_bpe_50k.json").encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


LONG = {
    "prose": lambda r: " ".join("".join(r.choice("etaoinshr'") for _ in range(r.randint(1, 9))) for _ in range(200_000)),
    "mixed": lambda r: "<|endoftext|>".join("".join(r.choice([x for x in PARTS if "<" not in x]) for _ in range(100_000)) for _ in range(2)),
    "letters": lambda r: "".join(r.choice("aeiounst") for _ in range(200_000)),
    "han": lambda r: "".join(r.choice("日本語中文字國際") for _ in range(100_000)),
    "base64": lambda r: "".join(r.choice("abcdefghABCDEFGH0123456789+/") for _ in range(1_000_000)),
    "blanks": lambda r: "".join(r.choice([" ", "\n", "\u2003"]) for _ in range(50_000)),
    "apostrophes": lambda r: "".join(r.choice("''''slreTv d") for _ in range(200_000)),
    "marks": lambda r: "".join(r.choice("!?-.\u2014\u0301") for _ in range(50_000)),
}


@pytest.mark.parametrize("kind", LONG)
def test_long_texts_are_joined_exactly(tokenizer, kind):
    coder, text = bpe.Bpe("byte_bpe_50k.json"), LONG[kind](random.Random(kind))
    with ThreadPoolExecutor(2) as pool:
        ids = coder.encode(text, pool)
    assert coder.joins > 0
    assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_tables_texts_are_joined(tokenizer):
    """The tree carries texts of the test tables."""
    coder = bpe.Bpe("byte_bpe_50k.json")
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert coder.encode(t).tolist() == e.ids
    assert coder.joins > 100


def test_bpe_over_documents(docs, corpus, tokenizer):
    rows = {r.doc_id: r for r in bpe.bpe_encode(docs, decoded="decoded").collect()}
    for i, t, _ in corpus:
        assert rows[i].token_ids == tokenizer.encode(t or "", add_special_tokens=False).ids
        assert rows[i].decoded == (t or "") and rows[i].text == t
    back = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect()}
    assert back == {i: t or "" for i, t, _ in corpus}


@pytest.mark.parametrize("rule", bpe.RULES)
def test_token_counts(docs, corpus, tokenizer, rule):
    got = {}
    for r in bpe.token_counts(docs, rule=rule).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start_char, r.end_char, r.n_tokens, r.doc_tokens))
    for i, t, _ in corpus:
        text = t or ""
        e = tokenizer.encode(text, add_special_tokens=False)
        at = [0, *[j + 1 for j, c in enumerate(text) if c == "\n"]]
        at = at[:-1] if len(at) > 1 and at[-1] == len(text) else at
        spans = list(zip(at, [*at[1:], len(text)], strict=True))
        own = sorted(got[i])
        assert [(a, b) for _, a, b, _, _ in own] == spans
        assert sum(x[3] for x in own) == pytest.approx(len(e.ids)) and all(x[4] == len(e.ids) for x in own)
        if rule == "start" and text.isascii():
            assert [x[3] for x in own] == [sum(a <= s < b for s, _ in e.offsets) for a, b in spans]


def test_attribution_rules():
    starts, ends, bounds = np.array([0, 4, 9]), np.array([4, 9, 10]), np.array([0, 5, 6, 10])
    assert bpe.attribute(starts, ends, bounds, "start").tolist() == [2, 0, 1]
    assert bpe.attribute(starts, ends, bounds, "majority").tolist() == [1, 0, 2]
    assert bpe.attribute(starts, ends, bounds, "split").tolist() == [1.2, 0.2, 1.6]
    with pytest.raises(ValueError):
        bpe.token_counts(None, rule="other")


def test_token_counts_of_fields(docs, corpus, tokenizer):
    rows = bpe.token_counts(docs, fields=["source", "text"]).collect()
    whole = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
    assert whole == {i: len(tokenizer.encode(f"{s or ''}\n{t or ''}", add_special_tokens=False).ids) for i, t, s in corpus}


# 6 -----------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(r, line, n, letters):
    out = list(line)
    for _ in range(n):
        i = r.randint(0, len(out))
        kind = r.randint(0, 2)
        if kind == 0:
            out.insert(i, r.choice(letters))
        elif i < len(out):
            out[i : i + 1] = [] if kind == 1 else [r.choice(letters)]
    return "".join(out)


def test_banded_distance():
    r = random.Random(3)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 9)))
        b = edited(r, a, r.randint(0, 4), "abc")
        for k in range(4):
            assert lines.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_near_lines_share_a_key():
    r, keys = random.Random(6), lines.Keys()
    for _ in range(3000):
        a = "".join(r.choice("abé") for _ in range(r.randint(20, 60)))
        b = edited(r, a, r.randint(1, 2), "abé")
        if a == b or min(len(a), len(b)) < lines.MIN_CHARS or distance(a, b) > lines.threshold(min(len(a), len(b))):
            continue
        (ka, pa), (kb, pb) = keys.of(a), keys.of(b)
        assert {x for x, p in zip(ka, pa, strict=True) if not p} & set(kb) or {x for x, p in zip(kb, pb, strict=True) if not p} & set(ka)
        assert lines.sketch_distance(lines.sketches([a]), lines.sketches([b]))[0] <= 4


def dedup(texts):
    first, place = {}, {}
    for i, t in texts:
        for z, x in enumerate(t.split("\n")):
            if len(x) >= lines.MIN_CHARS:
                first.setdefault(x, (i, z))
    label = {x: x for x in first}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    every = sorted(first)
    for j, a in enumerate(every):
        for b in every[:j]:
            k = lines.threshold(min(len(a), len(b)))
            if abs(len(a) - len(b)) <= k and len(a) < 1000 and root(a) != root(b) and distance(a, b) <= k:
                label[root(a)] = root(b)
    for x in every:
        place[root(x)] = min(place.get(root(x), first[x]), first[x])
    return {i: "\n".join(x for z, x in enumerate(t.split("\n")) if len(x) < lines.MIN_CHARS or place[root(x)] == (i, z)) for i, t in texts}


@pytest.mark.parametrize("hot", [1024, 2])
def test_line_dedup(spark, hot, monkeypatch, tmp_path):
    monkeypatch.setattr(lines, "HOT", hot)
    r = random.Random(8)
    pool = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(15, 60))) for _ in range(25)]
    texts = [(i, "\n".join(edited(r, r.choice(pool), r.choice([0, 0, 1, 2, 3]), "abcdefgh ") for _ in range(6))) for i in range(25)]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").repartition(3).write.parquet(path)
    got = {x.doc_id: (x.text, x.n_lines - x.n_exact - x.n_near) for x in lines.dedup_lines(spark.read.parquet(path)).collect()}
    want = dedup(texts)
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == (len(t.split("\n")) if t else n) for t, n in got.values())


# 9 -----------------------------------------------------------------------------


def target_of(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        rest, w = total - sum(out.values()), sum(weight[n] for n in free)
        over = [n for n in free if rest * weight[n] / w > 2 * sizes[n]]
        if not over:
            return out | {n: rest * weight[n] / w for n in free}
        for n in over:
            out[n] = 2 * sizes[n]
            free.remove(n)


def test_mixing(docs, corpus):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, s in corpus:
        sizes[s] += len(words(t))
    want = target_of(sizes)
    source = {i: s for i, _, s in corpus}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (len(words(corpus[r.doc_id][1])), sizes[s])
        assert r.target == pytest.approx(want[s]) and r.copies in (0, 1, 2) and r.taken == r.copies * r["size"] and 0 <= r.rate <= 2
        taken[s] += r.taken
    for s in sizes:
        smallest = max(len(words(t)) for _, t, x in corpus if x == s)
        assert abs(taken[s] - want[s]) <= max(smallest, 0.01 * want[s])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()))


def test_rates_are_tilted_and_meet_targets(spark):
    r = random.Random(1)
    classes = [(1, r.randint(1, 900), r.randint(1, 5)) for _ in range(200)]
    size = sum(x * n for _, x, n in classes)
    docs_ = sum(n for *_, n in classes)
    for share in (0.1, 0.9, 1.6, 2.0):
        wanted = spark.createDataFrame([(1, size, share * size, size / docs_)], "sid long, source_size long, target double, mean double")
        lam = mixing.solve(spark.createDataFrame(classes, "sid long, size long, docs long"), wanted).first()["lam"]
        got = sum(n * x * 2 / (1 + math.exp(-min(700, lam * x / (size / docs_)))) for _, x, n in classes)
        assert got == pytest.approx(share * size, rel=1e-6)


# awkward tables ----------------------------------------------------------------


RUNS = {
    "simhash": (lambda d: simhash.simhash_groups(d), 1),
    "quality": (lambda d: quality.judge(d), 1),
    "suffixes": (lambda d: suffixes.remove_repeats(d), 1),
    "lm": (lambda d: lm.score_texts(d), 1),
    "token_counts": (lambda d: bpe.token_counts(d), 1),
    "lines": (lambda d: lines.dedup_lines(d, keep=d.columns), 1),
    "encode": (lambda d: bpe.bpe_encode(d, decoded="back"), 1),
    "mix": (lambda d: mixing.mix(d, keep=["doc_id"]), 1),
}


@pytest.mark.parametrize("name", RUNS)
def test_nulls_repeats_and_clashing_names(nasty, name):
    rows = RUNS[name][0](nasty).collect()
    assert len(rows) == 8  # a row each: no line break in these texts
    if name == "simhash":
        by = {(r.doc_id, r.fp): r.component_id for r in rows}
        assert by[6, 0] == by[7, 0] == by[None, 0] == 6 and len({r.fp for r in rows}) == 3
        assert all(r.component_id == 5 for r in rows if r.fp not in (0,) and r.doc_id != 8)
    if name == "suffixes":
        assert [r.n_removed for r in rows if r.n_bytes > 200] == [r.n_bytes for r in rows if r.n_bytes > 200]
    if name == "lines":
        assert sum(bool(r.text) and len(r.text) > 100 for r in rows) == 1 and all(r.row == "x" and r.entries == "x" for r in rows)
    if name == "encode":
        assert all(r.back == (r.text or "") and r.row == "x" for r in rows)
    if name == "quality":
        assert all(r.row == "x" for r in rows)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(nothing, name):
    assert RUNS[name][0](nothing).collect() == []
