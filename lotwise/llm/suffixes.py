"""Operator 3: exact removal of repeated substrings by blockwise suffix sorting with a difference cover.

A text's windows are its substrings of ``length`` (200) bytes; a byte goes if a
window that covers it also starts anywhere else.

1.  Each window belongs to its *anchor*: the place of its least-hashed 32-byte
    gram, the leftmost of equals.  Equal windows have equal grams at equal
    offsets, so all that can repeat meets in the suffix bucket of one gram.  Runs
    of neighbouring windows share an anchor, so a text of n bytes has about n/85
    anchors; an anchor's *context* are the bytes of its windows.
2.  Grams that occur once are done.  A context that occurs twice repeats as a
    whole and need not be sorted; of each distinct context in a bucket with
    several, one copy is fetched.
3.  Buckets are sorted one block at a time.  A bucket's contexts are laid out
    with their anchors at multiples of the period v, so suffixes that can be
    equal have one residue.  The positions of a difference cover modulo v are
    ranked first, by prefix doubling from v bytes on; then a block's suffixes are
    sorted by v bytes, and longer ties by the rank at the suffix's next cover
    point.  Neighbours in that order are compared over the window.  Memory is
    that of one block, whatever the lengths of repeats.
4.  Buckets of more than ``HOT`` distinct contexts (the edge of a passage that
    very many texts share) are split down to single windows, counted with
    map-side combining, so no task holds such a bucket.

Grams and contexts are told apart by 64-bit hashes each (a context by both).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import OUT_BYTES, cut, number_rows, text_bytes

LENGTH, GRAM = 200, 32
PERIOD = 32
#: Fixed value: a difference cover modulo 32 (each residue is a difference of two members).
COVER = (0, 1, 2, 3, 7, 11, 19)
#: Distinct contexts of a bucket that is sorted in one block.
HOT = 4096
#: Contexts of a group of buckets, about.
GROUP = 2048
#: Window starts looked at together.
STRIDE = 1 << 20
B1 = 0x9E3779B97F4A7C15
B1_INVERSE = pow(B1, -1, 1 << 64)
M1 = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_TABLE: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLE.get("up", ())) < n:
        _TABLE["up"], _TABLE["down"] = _powers(B1, n), _powers(B1_INVERSE, n)
    return _TABLE["up"], _TABLE["down"]


def gram_hashes(a: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each gram of a text."""
    up, down = _power_tables(max(len(a), 1 << 16))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(a) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= M1
    h ^= h >> np.uint64(29)
    h *= M1
    return h


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, in linear time."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def pack(first: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window, the anchor's offset in it and number of windows in one long (40, 12 and 12 bits)."""
    return first << 24 | offset << 12 | count


def unpack(place):
    return place >> 24, place >> 12 & 4095, place & 4095


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, context hashes and places (see ``pack``)."""
    mh, ch, place = [], [], []
    windows = len(text) - length + 1
    low = np.uint64((1 << 24) - 1)
    for c in range(0, max(windows, 0), STRIDE):
        part = text[c : c + STRIDE + length - 1]
        h = gram_hashes(np.frombuffer(part, np.uint8))
        least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        at = (least & low).astype(np.int64)
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        n = np.diff(np.append(start, len(at)))
        mh.append(h[at[start]])
        digest = xxhash.xxh3_64_intdigest
        ch.append(np.fromiter([digest(part[s:e]) for s, e in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)], np.uint64, len(start)))
        place.append(pack(start + c, at[start] - start, n))
    if not mh:
        empty = np.empty(0, np.uint64)
        return empty, empty, empty.view(np.int64)
    return np.concatenate(mh), np.concatenate(ch), np.concatenate(place)


def words_at(t: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """n big-endian words of 8 bytes from each place on."""
    base = np.lib.stride_tricks.sliding_window_view(t, 8)
    return [np.ascontiguousarray(base[at + 8 * i]).view(">u8").reshape(-1).astype(np.uint64) for i in range(n)]


def ranks_of(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows of keys, the first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(t: np.ndarray, usable: int, length: int) -> np.ndarray:
    """For each place under ``usable`` in the cover, its rank by at least ``length`` bytes (elsewhere -1), by prefix doubling."""
    member = np.zeros(PERIOD, bool)
    member[list(COVER)] = True
    at = np.flatnonzero(member[np.arange(usable) % PERIOD])
    place = np.full(usable + 2 * length + 2 * PERIOD, -1, np.int64)
    rank = ranks_of(words_at(t, at, PERIOD // 8))
    depth = PERIOD
    while depth < length:  # place + depth is in the cover too: depth is a multiple of the period
        place[at] = rank
        rank = ranks_of([rank, place[at + depth]])
        depth *= 2
    place[at] = rank
    return place


def repeated(contexts: list[bytes], offsets: list[int], counts: list[int], bucket: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows also start in another context or elsewhere in it.

    offsets: of the anchors; counts: of windows; bucket: number of each context's bucket, ascending.
    """
    # lay out each block with anchors at multiples of the period and room for what ranks look at
    room = 2 * length + 2 * PERIOD
    starts, size = [], 0
    for text, off in zip(contexts, offsets, strict=True):
        s = size + (-off - size) % PERIOD
        starts.append(s)
        size = s + len(text)
    t = np.zeros(size + room, np.uint8)
    for s, text in zip(starts, contexts, strict=True):
        t[s : s + len(text)] = np.frombuffer(text, np.uint8)
    n = np.array(counts)
    suffix = np.repeat(np.array(starts), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(bucket, n)
    rank = cover_ranks(t, size, length)
    ahead = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
    residue = suffix % PERIOD
    tie = rank[suffix + ahead[residue]]
    order = np.lexsort([tie, residue, *words_at(t, suffix, PERIOD // 8)[::-1], own])
    s = suffix[order]
    same = (own[order][1:] == own[order][:-1]) & (residue[order][1:] == residue[order][:-1])
    view = np.lib.stride_tricks.sliding_window_view(t, length)
    close = np.flatnonzero(same)
    for i in range(0, len(close), 1 << 15):
        j = close[i : i + (1 << 15)]
        same[j] = (view[s[j]] == view[s[j + 1]]).all(1)
    out = np.zeros(len(order), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return np.split(out, np.cumsum(n)[:-1])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def cover_bytes(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes lie in a span."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(ends, n), -1)
    return np.cumsum(depth[:-1]) > 0


def _by_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with rows' columns by row number; only the small side is hashed, and texts are not sorted."""
    return docs.join(rows.withColumnRenamed("row", "row2").hint("shuffle_hash"), F.col("row") == F.col("row2"), how).drop("row2")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """key, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: what is left) of every row.

    Null and empty texts have no bytes.  Rows alike are different documents, so all their windows repeat.  Texts under ``length``
    bytes stay.  ``length`` is from 64 to 4,096.  docs are read more than once: they come from files or a checkpoint.
    """
    if not 2 * GRAM <= length <= 4096:
        raise ValueError(f"length must be from {2 * GRAM} to 4096")
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    base = number_rows(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "mh", "ch", "place"]
        for batch in batches:
            numbers, data = batch.column(0), text_bytes(batch.column(1))
            i = 0
            while i < len(data):
                j, size, found = i, 0, []
                while j < len(data) and size < OUT_BYTES:
                    found.append(anchors(data[j], length))
                    size += len(data[j])
                    j += 1
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in found])]).astype(np.int32))
                columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[c].view(np.int64) for x in found]))) for c in range(3)]
                yield pa.RecordBatch.from_arrays([numbers.slice(i, j - i), *columns], names=names)
                i = j

    per_text = cut(base.select("row", "t").mapInArrow(find, "row long, mh array<bigint>, ch array<bigint>, place array<bigint>"))
    each = per_text.select("row", F.explode(F.arrays_zip("mh", "ch", "place")).alias("a")).select("row", "a.mh", "a.ch", "a.place")
    # cut, so that the join's sides are plain exchanges, whose hot partitions Spark can split
    grams = cut(each.groupBy("mh").agg(F.count("*").alias("n"), F.min("ch").alias("c1"), F.max("ch").alias("c2")).where("n > 1"))
    again = cut(each.join(grams.select(F.col("mh").alias("mh2"), (F.col("c1") != F.col("c2")).alias("mixed")), F.col("mh") == F.col("mh2")).drop("mh2"))
    mixed = again.where("mixed")
    # one copy of each distinct context of the buckets that have several
    contexts = cut(mixed.groupBy("mh", "ch").agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("one")).select("mh", "ch", "n", "one.*"))
    crowds = contexts.groupBy("mh").agg(F.count("*").alias("m")).where(F.col("m") > hot).select(F.col("mh").alias("mh2"), F.lit(True).alias("crowded"))
    asked = contexts.join(crowds, F.col("mh") == F.col("mh2"), "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))).drop("mh2")
    groups = max(1, contexts.count() // GROUP)
    wanted = asked.groupBy("row").agg(F.collect_list(F.struct("mh", "n", "place", "crowded")).alias("asked"))  # at most a text's own anchors
    fetched = _by_text(base, wanted, "inner")  # with the keys, so that the last join's exchange of the texts is the same and is made once

    def fetch(crowded: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, data, want in zip(batch.column("row").to_pylist(), text_bytes(batch.column("t")), batch.column("asked").to_pylist(), strict=True):
                    want = [w for w in want if w["crowded"] == crowded]
                    if not crowded:
                        for i in range(0, len(want), 1 << 14):
                            some = want[i : i + (1 << 14)]
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([w["mh"] for w in some], pa.int64()),
                                    pa.array([w["n"] for w in some], pa.int64()),
                                    pa.array([number] * len(some), pa.int64()),
                                    pa.array([w["place"] for w in some], pa.int64()),
                                    pa.array([data[a : a + m + length - 1] for a, _, m in (unpack(w["place"]) for w in some)], pa.binary()),
                                ],
                                names=["mh", "n", "row", "place", "context"],
                            )
                    for w in want if crowded else ():
                        start, _, m = unpack(w["place"])
                        hashes = np.fromiter([xxhash.xxh3_64_intdigest(data[s : s + length]) for s in range(start, start + m)], np.uint64, m)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, w["mh"])), pa.array(hashes.view(np.int64)), pa.array(np.full(m, w["n"])), pa.array(np.full(m, number)), pa.array(np.arange(start, start + m))],
                            names=["mh", "wh", "n", "row", "start"],
                        )

        return run

    def sort(t: pa.Table) -> pa.Table:
        mh = t.column("mh").to_numpy()
        order = np.argsort(mh, kind="stable")
        t, mh = t.take(pa.array(order)), mh[order]
        bucket = np.cumsum(np.append(False, mh[1:] != mh[:-1]))
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(mh))
        number, n = t.column("row").to_numpy(), t.column("n").to_numpy()
        first, offset, count = unpack(t.column("place").to_numpy())
        rows, lo, hi = [], [], []
        i = 0
        while i < len(mh):  # whole buckets, up to a block of contexts
            j = int(ends[max(np.searchsorted(ends, i + hot, side="right") - 1, np.searchsorted(ends, i, side="right"))])
            flags = repeated(t.column("context").slice(i, j - i).to_pylist(), offset[i:j].tolist(), count[i:j].tolist(), bucket[i:j], length)
            for x in range(i, j):
                if n[x] == 1:  # else all of it repeats anyway
                    a, b = runs(flags[x - i])
                    rows += [number[x]] * len(a)
                    lo += (first[x] + a).tolist()
                    hi += (first[x] + b - 1 + length).tolist()
            i = j
        return pa.table({"row": pa.array(rows, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})

    single = fetched.mapInArrow(fetch(False), "mh long, n long, row long, place long, context binary")
    sorted_ = single.withColumn("g", F.pmod(F.xxhash64("mh"), F.lit(groups))).groupBy("g").applyInArrow(sort, "row long, lo long, hi long")
    spans = [sorted_]
    if crowds.limit(1).count():
        windows = fetched.mapInArrow(fetch(True), "mh long, wh long, n long, row long, start long")
        twice = windows.groupBy("mh", "wh").agg(F.count("*").alias("times")).where("times > 1").select(F.col("mh").alias("mh2"), F.col("wh").alias("wh2"))
        shared = windows.where("n = 1").join(twice, (F.col("mh") == F.col("mh2")) & (F.col("wh") == F.col("wh2")))
        spans.append(shared.select("row", F.col("start").alias("lo"), (F.col("start") + length).alias("hi")))
    copies = contexts.where("n > 1").select(F.col("mh").alias("mh2"), F.col("ch").alias("ch2"))
    whole = [again.where("not mixed"), mixed.join(copies, (F.col("mh") == F.col("mh2")) & (F.col("ch") == F.col("ch2")))]
    for w in whole:
        first, count = F.shiftright("place", 24), F.col("place").bitwiseAND(4095)
        spans.append(w.select("row", first.alias("lo"), (first + count - 1 + length).alias("hi")))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    listed = every.groupBy("row").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))  # a text's own spans, in step

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, los, his = text_bytes(batch.column("t")), batch.column("lo"), batch.column("hi")
            i = 0
            while i < len(data):
                j, size, kept, removed, spans_ = i, 0, [], [], []
                while j < len(data) and size < OUT_BYTES:
                    lo = los[j].values
                    if lo is None or not len(lo):
                        kept.append(data[j])
                        removed.append(0)
                        spans_.append(0)
                    else:
                        gone = cover_bytes(lo.to_numpy(), his[j].values.to_numpy(), len(data[j]))
                        kept.append(np.frombuffer(data[j], np.uint8)[~gone].tobytes())
                        removed.append(int(gone.sum()))
                        spans_.append(len(runs(gone)[0]))
                    size += len(data[j])
                    j += 1
                sizes = [len(x) for x in data[i:j]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(kept, pa.binary())],
                    names=["k", "n_bytes", "n_removed", "n_spans", "kept"],
                )
                i = j

    out = _by_text(base, listed, "left").mapInArrow(remove, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("k", key)
