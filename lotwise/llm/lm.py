"""Operator 4: language-model scoring from a log-frequency Bloom filter.

Asking: Python workers go over portions of texts of bounded size and send each
segment of the hash range one row a portion: the portion's distinct tokens and
bigrams of that segment, sorted, with how often its training texts have them.
The same rows count and ask, so a lookup needs no exchange of its own.  Hashes go
as differences, by planes of bytes, compressed; bigrams as the upper 48 bits of
theirs, some four bytes each.  The number of segments follows the bytes of text,
so a group's size does not.

Filter: a segment adds its portions up.  Counts are quantised on a logarithmic
scale (1, 2 and 3 exactly), and an n-gram of level q is entered into the segment's
part of the filter as (n-gram, 1), ..., (n-gram, q), all n-grams from a count of one
on.  A count is read by probing (n-gram, 1), (n-gram, 2), ... to the first miss or
the highest level entered; a level stands for the mean count of the n-grams that
have it.  The filter has ``BITS`` bits an entry at any size; a part is built and
probed where its segment is, and is never sent.  What goes back to a portion are
levels, and exact counts of tokens for the base score, in the order it asked.

Scores: portions, read again, meet their answers.  log10 of P(w | v) =
(c(v w) + m p(w)) / (c(v) + m), with c(v w) no more than c(v) and p the smoothed
unigram estimate; counts are those of the filter, exact ones for the ``TOP``
commonest tokens.  Over all w it sums to one within the quantisation.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, number_rows, text_bytes

BITS, PROBES = 12, 4
#: Bits that ``least_level`` is asked for by default; no part of the filter is broadcast any more.
MAX_BITS = 1 << 29
#: Tokens whose exact counts the model takes, at most; by count, in bins of an eighth of a doubling.
TOP = 200_000
#: Weight of the unigram estimate, in counts.
PRIOR = 300.0
#: Bytes of text a segment of the hash range stands for, and bytes of a portion; a text is never split.
SEGMENT_BYTES, PORTION = 16 << 20, 8 << 20
#: Levels a doubling.
STEPS = 2
#: Bits of a bigram's hash that are left out: far fewer bigrams meet by that than by the filter.
DROP = np.uint64(16)
END = xxhash.xxh64_intdigest(b"", 42)  # no word is empty
START = xxhash.xxh64_intdigest(b" ", 42)  # no word holds a space
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))  # odd multipliers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M3
    return x ^ (x >> np.uint64(29))


def add_tokens(tokens: array, text: bytes) -> None:
    """Append hashes of the words of lower-cased (A-Z) text, then the end."""
    hash64 = xxhash.xxh64_intdigest
    tokens.extend([hash64(w, 42) for w in text.lower().split()])
    tokens.append(END)


def bigrams_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; first: places where a text begins."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first] = START
    return mix(before * M1 + tokens * M2)


def level(counts: np.ndarray) -> np.ndarray:
    """1, 2 and 3 for themselves, and one more for each 1/STEPS of a doubling."""
    return np.floor(STEPS * np.log2(counts) + 1e-9).astype(np.int64) + (counts == 1)


def places(hashes: np.ndarray, q: int, i: int, size: int) -> np.ndarray:
    """Bit of probe i at level q, within a part of ``size`` bits."""
    h = mix(hashes + np.uint64(q * int(M1) & 0xFFFFFFFFFFFFFFFF))
    step = mix(h ^ M2) | np.uint64(1)
    return (h + np.uint64(i) * step) % np.uint64(size)


class Filter:
    """A bit array: ``segments`` parts of ``size`` bits; a hash's upper half of the range says its part.  top: the highest level entered."""

    def __init__(self, data: np.ndarray, segments: int, size: int, top: int):
        self.data, self.segments, self.size, self.top = data, segments, size, top

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Levels read by probing; sorted hashes are read part by part."""
        out = np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        base = segment_of(hashes, self.segments).astype(np.int64) * (self.size // 8)
        for q in range(1, self.top + 1):
            for i in range(PROBES):
                if not len(left):
                    return out
                at = places(hashes[left], q, i, self.size).astype(np.int64)
                left = left[(self.data[base[left] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[left] = q
        return out


def enter(bits: np.ndarray, hashes: np.ndarray, levels: np.ndarray) -> None:
    """Set the bits (one a byte) of all entries of n-grams."""
    for q in range(1, int(levels.max(initial=0)) + 1):
        hashes, levels = hashes[levels >= q], levels[levels >= q]
        for i in range(PROBES):
            bits[places(hashes, q, i, len(bits))] = 1


def part_bits(entries: int) -> int:
    return max(64, -(-BITS * entries // 64) * 64)


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)


def pack(x: np.ndarray) -> bytes:
    """Numbers (not negative), compressed: low bytes first, as planes, without planes of zeros."""
    x = x.astype(np.uint64)
    width = -(-int(x.max(initial=0)).bit_length() // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T[:width])
    return struct.pack("<IB", len(x), width) + (pa.compress(planes, "zstd", asbytes=True) if planes.size else b"")


def unpack(b: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", b)
    planes = np.zeros((8, n), np.uint8)
    if n and width:
        planes[:width] = np.frombuffer(pa.decompress(b[5:], n * width, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending numbers, by their differences."""
    return struct.pack("<Q", int(h[0]) if len(h) else 0) + pack(np.diff(h))


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = struct.unpack_from("<Q", b)[0]
        out[1:] = unpack(b[8:])
    return np.cumsum(out, dtype=np.uint64)


def portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Neighbouring rows (row, k, held_out) with their texts (t), of about ``size`` bytes; the same on each reading of the same rows."""
    slices, texts, got = [], [], 0

    def made() -> tuple[pa.Table, list[bytes]]:
        return pa.Table.from_batches(slices), texts

    for batch in batches:
        i, rest = 0, batch.select(["row", "k", "held_out"])
        for j, b in enumerate(text_bytes(batch.column("t")), 1):
            texts.append(b)
            got += len(b) + 1
            if got >= size:
                slices.append(rest.slice(i, j - i))
                yield made()
                slices, texts, got, i = [], [], 0, j
        if i < batch.num_rows:
            slices.append(rest.slice(i))
    if texts:
        yield made()


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of texts, and where each begins."""
    tokens, first = array("Q"), array("q")
    for b in texts:
        first.append(len(tokens))
        add_tokens(tokens, b)
    return np.frombuffer(tokens, np.uint64), np.frombuffer(first, np.int64)


def asked(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a portion asks for: its tokens, and its bigrams without the bits that are left out."""
    return tokens, bigrams_of(tokens, first) >> DROP << DROP


def ask_ngrams(rows: DataFrame, segments: int, size: int) -> DataFrame:
    """segment, portion (number of its first row), and of tokens (uni) and bigrams (bi): n distinct ones, hashes h and training counts c, packed; one row a segment and portion."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in portions(batches, size):
            tokens, first = tokens_of(texts)
            lengths = np.diff(np.append(first, len(tokens)))
            learned = np.repeat(~table.column("held_out").to_numpy(), lengths)
            found = []
            for x in asked(tokens, first):
                h = np.unique(x)
                known, times = np.unique(x[learned], return_counts=True)
                c = np.zeros(len(h), np.int64)
                c[np.searchsorted(h, known)] = times
                found.append((h, c, segment_of(h, segments)))
            present = np.unique(np.concatenate([s for _, _, s in found]))
            columns: list[pa.Array] = [pa.array(present.astype(np.int32)), pa.array(np.full(len(present), table.column("row")[0].as_py(), np.int64))]
            for (h, c, s), drop in zip(found, (np.uint64(0), DROP), strict=True):
                edges = list(zip(np.searchsorted(s, present, "left").tolist(), np.searchsorted(s, present, "right").tolist(), strict=True))
                columns.append(pa.array([y - x for x, y in edges], pa.int32()))
                columns.append(pa.array([pack_sorted(h[x:y] >> drop) for x, y in edges], pa.binary()))
                columns.append(pa.array([pack(c[x:y]) for x, y in edges], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "portion", "uni_n", "uni_h", "uni_c", "bi_n", "bi_h", "bi_c"])

    return rows.mapInArrow(ask, "segment int, portion long, uni_n int, uni_h binary, uni_c binary, bi_n int, bi_h binary, bi_c binary")


def answer_ngrams(asks: DataFrame) -> DataFrame:
    """segment, portion, and in the order asked: counts of tokens (uni_c), levels of tokens and bigrams (uni_q, bi_q), packed.

    One row of each segment has its tokens, types, bins of token counts, and by level the n-grams and the sums of their counts.
    """
    kinds = {"segment": pa.int32(), "portion": pa.int64(), "uni_c": pa.binary(), "uni_q": pa.binary(), "bi_q": pa.binary(), "tokens": pa.int64(), "types": pa.int64(), **{n: pa.list_(pa.int64()) for n in LISTS}}

    def answer(t: pa.Table) -> pa.Table:
        rows, out = len(t), {}
        hashes, counts, where, edges = {}, {}, {}, {}
        for x, drop in (("uni", np.uint64(0)), ("bi", DROP)):
            sizes = t.column(f"{x}_n").to_pylist()
            h = np.concatenate([unpack_sorted(b, n) for b, n in zip(t.column(f"{x}_h").to_pylist(), sizes, strict=True)]) << drop
            c = np.concatenate([unpack(b) for b in t.column(f"{x}_c").to_pylist()]).astype(np.int64)
            hashes[x], where[x] = np.unique(h, return_inverse=True)
            counts[x] = np.zeros(len(hashes[x]), np.int64)
            np.add.at(counts[x], where[x], c)
            edges[x] = np.append(0, np.cumsum(sizes)).tolist()
        learned = {x: counts[x] > 0 for x in counts}
        h = np.concatenate([hashes[x][learned[x]] for x in hashes])
        q = level(np.concatenate([counts[x][learned[x]] for x in hashes]))
        bits = np.zeros(part_bits(int(q.sum())), np.uint8)
        enter(bits, h, q)
        lookup = Filter(np.packbits(bits, bitorder="little"), 1, len(bits), int(q.max(initial=0)))
        del bits
        for x in hashes:
            c = counts[x][learned[x]]
            q = level(c)
            stats = {f"{x}_n": np.bincount(q, minlength=LEVELS), f"{x}_sum": np.bincount(q, weights=c, minlength=LEVELS).astype(np.int64)}
            if x == "uni":
                stats |= {"bins": np.bincount(_bin(c), minlength=BINS)}
                out |= {"tokens": [int(c.sum())] + [None] * (rows - 1), "types": [len(c)] + [None] * (rows - 1)}
                out["uni_c"] = [pack(counts[x][where[x][i:j]]) for i, j in zip(edges[x], edges[x][1:])]
            out |= {n: [v.tolist()] + [None] * (rows - 1) for n, v in stats.items()}
            levels = lookup.levels(hashes[x])
            out[f"{x}_q"] = [pack(levels[where[x][i:j]]) for i, j in zip(edges[x], edges[x][1:])]
        out |= {n: t.column(n) for n in ("segment", "portion")}
        return pa.table({n: out[n] for n in kinds}, schema=pa.schema(list(kinds.items())))

    return asks.groupBy("segment").applyInArrow(answer, "segment int, portion long, uni_c binary, uni_q binary, bi_q binary, tokens long, types long, " + ", ".join(f"{n} array<bigint>" for n in LISTS))


#: Levels of counts up to 2^63, and columns of lists by level or bin.
LEVELS = STEPS * 64
LISTS = ("bins", "uni_n", "uni_sum", "bi_n", "bi_sum")
#: Bins of counts, an eighth of a doubling each.
BINS = 512


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.floor(8 * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def least_level(n: np.ndarray, most: int) -> int:
    """The least level from which on all n-grams' entries fit into ``most`` bits; n: n-grams by level."""
    entries = np.cumsum((n * np.arange(len(n)))[::-1])[::-1]  # of this level and above
    return max(1, int(np.searchsorted(-entries * BITS, -most)))


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, prior: float = PRIOR, max_bits: int = MAX_BITS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every row.

    A row is held out, and not learned from, where crc32 of its key's text is ``held`` modulo ``folds``; null keys are learned
    from.  Null and empty texts are the end alone.  Tokens are told apart by 64-bit hashes.  Without training texts all
    counts are zero.  Repeated rows are learned from and scored each; texts of any length are read whole; an empty table
    gives an empty one.  Other columns, whatever their names, play no part.  docs are read more than once: they come from
    files or a checkpoint.  max_bits has no effect: it bounded a part of the filter that was broadcast.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == held, F.lit(False))
    rows = number_rows(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), out.alias("held_out"))).select("row", "k", "t", "held_out")
    found = rows.agg(F.sum(F.octet_length("t")).alias("size"), F.count_if(~F.col("held_out")).alias("n")).first()
    n_texts, size = found["n"], PORTION
    segments = max(1, -(-(found["size"] or 0) // SEGMENT_BYTES))
    answers = cut(answer_ngrams(ask_ngrams(rows, segments, size)))
    total = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    n, v = total["tokens"] or 0, total["types"] or 0
    lists = {}
    for name in LISTS:  # some hundred rows each
        lists[name] = np.zeros(BINS if name == "bins" else LEVELS, np.int64)
        for r in answers.select(F.posexplode(name).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
            lists[name][r["i"]] = r["n"]
    # what a level stands for
    uni_value, bi_value = (lists[f"{x}_sum"] / np.maximum(lists[f"{x}_n"], 1) for x in ("uni", "bi"))
    # the commonest tokens: all bins from the first down to which at most TOP tokens have their counts
    cutoff, above = BINS, 0
    while cutoff > 0 and above + lists["bins"][cutoff - 1] <= TOP:
        cutoff -= 1
        above += lists["bins"][cutoff]
    scale = n + 0.5 * (v + 1)
    log_scale = math.log10(scale)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in portions(batches, size):
            whole = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(x).combine_chunks()) for x in ("k", "held_out")]
            sizes = pa.array([[len(b) for b in texts]], pa.list_(pa.int64()))
            data = b"".join(texts)
            packed = pa.array([pa.compress(data, "zstd", asbytes=True) if data else b""], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([table.column("row")[0].as_py()], pa.int64()), *whole, sizes, packed], names=["portion", "ks", "held", "sizes", "data"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            raise RuntimeError("the documents were not the same when they were read again")
        ends = np.cumsum(left.column("sizes")[0].values.to_numpy()).tolist()
        data = left.column("data")[0].as_py()
        data = pa.decompress(data, ends[-1], "zstd", asbytes=True) if data else b""
        t, begin = tokens_of([data[i:j] for i, j in zip([0, *ends], ends)])
        del data
        right = right.sort_by("segment")
        exact, uni_q, bi_q = (np.concatenate([np.empty(0, np.int64), *[unpack(b).astype(np.int64) for b in right.column(x).to_pylist()]]) for x in ("uni_c", "uni_q", "bi_q"))
        tokens, bigrams = asked(t, begin)
        types, inv = np.unique(tokens, return_inverse=True)
        pairs, inv2 = np.unique(bigrams, return_inverse=True)
        if (len(types), len(types), len(pairs)) != (len(exact), len(uni_q), len(bi_q)):
            raise RuntimeError("the documents were not the same when they were read again")
        base = np.add.reduceat(np.log10(exact + 0.5)[inv], begin)
        n_known = np.add.reduceat((exact > 0).astype(np.int64)[inv], begin)
        # the model's counts
        uni = np.where((exact > 0) & (_bin(exact) >= cutoff), exact, uni_value[uni_q])
        both = bi_value[bi_q][inv2]
        context = np.empty(len(t))
        context[1:] = uni[inv[:-1]]
        context[begin] = n_texts
        logs = np.log10((np.minimum(both, context) + prior * (uni[inv] + 0.5) / scale) / (context + prior))
        lengths = np.diff(np.append(begin, len(t)))
        columns = [left.column("ks")[0].values, left.column("held")[0].values, pa.array(lengths), pa.array(n_known), pa.array(base - lengths * log_scale), pa.array(np.add.reduceat(logs, begin))]
        return pa.table(columns, names=["k", "held_out", "n_tokens", "n_known", "base_score", "score"])

    texts = rows.mapInArrow(send, f"portion long, ks array<{kind}>, held array<boolean>, sizes array<bigint>, data binary")
    back = answers.select("portion", "segment", "uni_c", "uni_q", "bi_q")
    scored = texts.groupBy("portion").cogroup(back.groupBy("portion")).applyInArrow(score, f"k {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("k").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
