"""Operator 6: near-duplicate lines by a segment-partition edit join.

Lines are compared by edit distance; the threshold goes with the shorter line: 0
(exact copies) under ``NEAR_CHARS`` characters, 1 under ``LONG``, else 2.  Short
lines of white space only are left alone.

Distinct lines of ``NEAR_CHARS`` or more are joined as follows.  A line of length n and threshold t is
indexed under its t + 1 segments.  By the pigeonhole principle t edits leave a
segment whole, so a line of the same or up to t more characters has one of them
as a substring; multi-match-aware positions (those consistent with the edits on
either side) are all it must probe.  Keys hold the indexed length, the segment's
number and its text.

1.  Keys meet in groups together with a sketch of each line (counts of its
    characters in sixteen classes, three bits each); pairs whose sketches differ by more
    than the edits can explain are dropped.
2.  Texts of the lines left are fetched and meet once more under their keys;
    edit distances are verified with bit-parallel columns of the band, and a
    group answers with a spanning forest of its links.
3.  Components of linked lines are classes.  The first line of a class, in order
    of the documents' keys, stays; all others go.

Keys of very many entries or probes are split into blocks, each pair of blocks a group;
probes of such a key without entries end there.  How many probes a key has is
told from one line in ``SAMPLED``; it decides groups only, never results.

Copies are told by 128 bits of hashes, lines of the join by 64 and then by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import OUT_BYTES, cut, number_rows
from .components import components, merge_labels, pairs_by_key

MIN_CHARS, NEAR_CHARS, LONG, MOST = 1, 20, 40, 2
#: Index entries and probes of a key that is not split, and rows of a group, about.
HOT, HOT_PROBES, GROUP_ROWS = 1024, 4096, 65_536
#: Probes are counted of one line in so many.
SAMPLED = 64
#: Keys of a group of the first sieve, about.
SIFT_ROWS = 250_000
PAIRS = 1 << 18
#: The filter that picks the lines to fetch has so many words of 64 bits (8 MB), whatever the corpus; what passes it wrongly is dropped by the join.
FILTER_WORDS = 1 << 20


def threshold(n: int) -> int:
    """Edits allowed to a shorter line of n characters."""
    return 0 if n < NEAR_CHARS else 1 if n < LONG else MOST


def takes_part(line: str) -> bool:
    """Whether a line is compared at all: short ones of white space only are not."""
    return len(line) >= NEAR_CHARS or len(line) >= MIN_CHARS and not line.isspace()


def segments(n: int, t: int) -> list[tuple[int, int]]:
    """Starts and ends of t + 1 segments of a line of n characters, as even as can be, the longer ones last."""
    short, more = divmod(n, t + 1)
    sizes = [short + (i >= t + 1 - more) for i in range(t + 1)]
    ends = np.cumsum(sizes).tolist()
    return [(e - s, e) for s, e in zip(sizes, ends, strict=True)]


def probes(n: int, length: int, t: int) -> list[tuple[int, int, int]]:
    """(segment, start, end) of the substrings that a line of n characters must probe in the index of lines of ``length`` <= n."""
    out, shift = [], n - length
    for i, (a, b) in enumerate(segments(length, t)):
        # i edits at most before the segment, t - i after it
        low = max(0, a - i, a + shift - (t - i))
        high = min(n - (b - a), a + i, a + shift + (t - i))
        out += [(i, s, s + b - a) for s in range(low, high + 1)]
    return out


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode(), 42)


def plan_of(n: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, end, probe) of a line of n characters, index entries first; none below NEAR_CHARS.  A probe that would be an index entry again is left out."""
    if n < NEAR_CHARS:
        return []
    t = threshold(n)
    own = [(i, a, b) for i, (a, b) in enumerate(segments(n, t))]
    plan = [(n, *x, False) for x in own]
    for length in range(n, max(NEAR_CHARS, n - MOST) - 1, -1):
        t = threshold(length)
        if n - length <= t:
            plan += [(length, *x, True) for x in probes(n, length, t) if length < n or x not in own]
    return plan


class Keys:
    """Keys of lines; plans are kept by length."""

    def __init__(self) -> None:
        self.plans: dict[int, tuple[list[tuple[int, int, int]], list[bool], int]] = {}

    def of(self, line: str, index_only: bool = False) -> tuple[list[int], list[bool]]:
        """Hashes of a line's substrings with the indexed length and segment as seed, and which are probes."""
        n = len(line)
        if n not in self.plans:
            plan = plan_of(n)
            self.plans[n] = [(4 * a, 4 * b, length << 3 | i) for length, i, a, b, _ in plan], [p for *_, p in plan], threshold(n) + 1
        cuts, probe, own = self.plans[n]
        data = line.encode("utf-32-le")  # characters of four bytes: sliced without another encoding
        hash64 = xxhash.xxh64_intdigest
        return [hash64(data[a:b], seed) for a, b, seed in (cuts[:own] if index_only else cuts)], probe


def sketches(lines: list[str], chars: int = 1 << 20) -> np.ndarray:
    """Counts of each line's characters by the last four bits of their codes, three bits each; so many characters at once, about."""
    out, i = [np.empty(0, np.uint64)], 0
    while i < len(lines):
        j, size = i, 0
        while j < len(lines) and (j == i or size + len(lines[j]) <= chars):
            size += len(lines[j])
            j += 1
        codes = np.frombuffer("".join(lines[i:j]).encode("utf-32-le"), np.uint32)
        of = np.repeat(np.arange(j - i, dtype=np.int64) << 4, [len(x) for x in lines[i:j]])
        counts = np.bincount(of | (codes & np.uint32(15)), minlength=(j - i) << 4).reshape(-1, 16) & 7
        out.append((counts.astype(np.uint64) << (np.uint64(3) * np.arange(16, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))
        i = j
    return np.concatenate(out)


def sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for i in range(16):
        d = (a >> np.uint64(3 * i) & np.uint64(7)).astype(np.int64) - (b >> np.uint64(3 * i) & np.uint64(7)).astype(np.int64)
        out += np.minimum(d & 7, -d & 7)
    return out


def within(p: str, t: str, k: int) -> bool:
    """Whether the edit distance is at most k, by bit-parallel columns of the band of 2k + 1 diagonals."""
    if abs(len(p) - len(t)) > k:
        return False
    a, stop = 0, min(len(p), len(t))
    while a < stop and p[a : a + 64] == t[a : a + 64]:
        a += 64
    while a < stop and p[a] == t[a]:
        a += 1
    a = min(a, stop)
    p, t = p[a:], t[a:]
    b, stop = 0, min(len(p), len(t))
    while b < stop and p[len(p) - 1 - b] == t[len(t) - 1 - b]:
        b += 1
    p, t = p[: len(p) - b], t[: len(t) - b]
    m, n = len(p), len(t)
    if not m or not n:
        return max(m, n) <= k
    at: dict[str, int] = {}
    for i, c in enumerate(p):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << (2 * k + 1)) - 1
    plus, minus = full >> k << k, 0  # vertical steps of the column before, for rows j - k .. j + k
    score = min(k, m)  # at the band's lowest row (no lower than m), from column 0 on
    for j in range(1, n + 1):
        off = j - k - 1
        eq = at.get(t[j - 1], 0)
        eq = (eq >> off if off >= 0 else eq << -off) & full
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp, hn = (minus | ~(d0 | plus)) & full, d0 & plus
        if j + k <= m:
            score += not d0 >> (2 * k) & 1
        else:  # the lowest row is m, at this bit; from there on the score moves along it
            bit = m - j + k
            score += (hp >> bit & 1) - (hn >> bit & 1)
        plus, minus = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
    return score <= k


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    step = max(1, int(batch.num_rows * OUT_BYTES / max(batch.nbytes, OUT_BYTES)))
    for i in range(0, batch.num_rows, step):
        yield i, [x or "" for x in batch.column(column).slice(i, step).to_pylist()]


def link_lines(texts: DataFrame, entries: DataFrame, probed: DataFrame) -> DataFrame:
    """Links (u, v: hashes of lines) between near-duplicate distinct lines of column t, enough to keep their classes whole.

    entries: the index entries (key) of all lines, probed: the probes (key) of one line in SAMPLED; which keys are split is read from them.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Keys()
        seen: set[int] = set()
        for batch in batches:
            for _, part in _pieces(batch, "t"):
                fresh, names = [], []
                for text in part:
                    for line in text.split("\n"):
                        if len(line) < NEAR_CHARS:
                            continue
                        h = line_hash(line)
                        if h in seen:
                            continue
                        seen.add(h)
                        fresh.append(line)
                        names.append(h)
                if len(seen) > 1 << 20:
                    seen.clear()
                keys, probe, count = [], [], []
                for line in fresh:
                    own, flags = of.of(line)
                    keys += own
                    probe += flags
                    count.append(len(own))
                meta = np.repeat(sketches(fresh) << np.uint64(1), count) | np.array(probe, np.uint64)
                arrays = [np.array(keys, np.uint64), np.repeat(np.array(names, np.uint64), count), meta]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in arrays], names=["key", "h", "meta"])

    signed = texts.select("t").mapInArrow(sign, "key long, h long, meta long")
    sizes = entries.select("key", F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(probed.select("key", F.lit(0).alias("e"), F.lit(SAMPLED).alias("p"))).groupBy("key").agg(F.sum("e").alias("e"), F.sum("p").alias("p"))
    crowded = cut(sizes.where((F.col("e") > HOT) | (F.col("p") > HOT_PROBES)).select(F.col("key").alias("hot_key"), F.ceil(F.col("e") / HOT).cast("int").alias("eb"), F.greatest(F.lit(1), F.ceil(F.col("p") / HOT_PROBES)).cast("int").alias("pb")))
    groups = max(12, entries.count() * 4 // SIFT_ROWS)  # a line has about four keys for each index entry
    plain, hot = signed, None
    if crowded.limit(1).count():
        both = signed.join(crowded, F.col("key") == F.col("hot_key"), "left")
        plain = both.where("eb is null").select("key", "h", "meta")
        # blocks of entries meet each other (j >= 0), and blocks of probes (j < 0)
        probe = F.col("meta").bitwiseAND(1) == 1
        hot = both.where("eb > 0").withColumn("own", F.pmod(F.xxhash64("h"), F.when(probe, F.col("pb")).otherwise(F.col("eb"))).cast("int"))
        upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        to = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        of_entry = F.concat(F.transform(upto("eb"), lambda x: to(F.least(x, "own"), F.greatest(x, "own"))), F.transform(upto("pb"), lambda x: to(F.col("own"), -x - 1)))
        of_probe = F.transform(upto("eb"), lambda x: to(x, -F.col("own") - 1))
        hot = hot.withColumn("to", F.explode(F.when(probe, of_probe).otherwise(of_entry))).select("key", "h", "meta", "to.i", "to.j")

    def sift(t: pa.Table) -> pa.Table:
        key, h, meta = (t.column(c).to_numpy() for c in ("key", "h", "meta"))
        order = np.lexsort((h, meta & 1, key))
        key, h, meta = key[order], h[order], meta[order].view(np.uint64)
        alive = np.zeros(len(key), bool)
        probe, sk = meta & np.uint64(1) == 1, meta >> np.uint64(1)
        for a, b in pairs_by_key(key, probe, PAIRS):
            keep = h[a] != h[b]
            a, b = a[keep], b[keep]
            keep = sketch_distance(sk[a], sk[b]) <= 2 * MOST
            alive[a[keep]] = alive[b[keep]] = True
        order = np.lexsort((h, key))
        key, h, alive = key[order], h[order], alive[order]
        first = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])) if len(key) else alive
        # a line that stands under a key both ways, or came from several tasks, counts once
        runs = np.cumsum(first) - 1 if len(key) else np.empty(0, int)
        kept = np.bincount(runs[alive], minlength=int(first.sum())) > 0
        return pa.table({"key": pa.array(key[first][kept]), "h": pa.array(h[first][kept])})

    def sift_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)  # numbers only, about SIFT_ROWS of them
        if own:
            yield from sift(pa.Table.from_batches(own)).to_batches()

    # dealt out by key into so many parts, each a group: no sort
    left = plain.repartition(groups, "key").mapInArrow(sift_part, "key long, h long")
    left = left.select("key", "h", F.lit(0).alias("i"), F.lit(0).alias("j"))
    if hot is not None:

        def sift_block(keys: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            out = sift(t)
            return out.append_column("i", pa.array([keys[1].as_py()] * len(out), pa.int32())).append_column("j", pa.array([keys[2].as_py()] * len(out), pa.int32()))

        left = left.unionByName(hot.groupBy("key", "i", "j").applyInArrow(sift_block, "key long, h long, i int, j int"))
    left = cut(left)
    wanted = left.select("h").distinct()
    marks = wanted.groupBy(F.col("h").bitwiseAND(FILTER_WORDS - 1).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 as int))")).alias("m")).toArrow()  # at most FILTER_WORDS rows
    table = np.zeros(FILTER_WORDS, np.uint64)
    table[marks.column("w").to_numpy()] = marks.column("m").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, part in _pieces(batch, "t"):
                lines = [line for text in part for line in text.split("\n") if len(line) >= NEAR_CHARS]
                h = np.fromiter(map(line_hash, lines), np.uint64, len(lines))
                hit = np.flatnonzero(table[h & np.uint64(FILTER_WORDS - 1)] >> (h >> np.uint64(40) & np.uint64(63)) & np.uint64(1))
                fresh = []
                for i in hit.tolist():
                    if int(h[i]) not in seen:
                        seen.add(int(h[i]))
                        fresh.append(i)
                if len(seen) > 1 << 20:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(h[fresh].view(np.int64)), pa.array([lines[i] for i in fresh], pa.string())], names=["h2", "line"])

    lines = texts.select("t").mapInArrow(fetch, "h2 long, line string").groupBy("h2").agg(F.first("line").alias("line"))
    ready = left.join(lines, F.col("h") == F.col("h2")).select("key", "i", "j", "h", "line")
    parts = max(16, left.count() // GROUP_ROWS * 4)
    ready = ready.withColumn("g", F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod("key", F.lit(parts))).otherwise(F.xxhash64("key", "i", "j")))

    def verify(t: pa.Table) -> pa.Table:
        key = t.column("key").to_numpy() * 1_000_003 ^ (t.column("i").to_numpy().astype(np.int64) << 20) ^ t.column("j").to_numpy()
        order = np.argsort(key, kind="stable")
        key, h = key[order], t.column("h").to_numpy()[order]
        line = t.column("line").take(pa.array(order)).to_pylist()
        sk = sketches(line)
        nodes, at = np.unique(h, return_inverse=True)
        label = np.arange(len(nodes))
        for a, b in pairs_by_key(key, np.zeros(len(key), bool), PAIRS):
            keep = np.flatnonzero(sketch_distance(sk[a], sk[b]) <= 2 * MOST)
            for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                if label[at[x]] != label[at[y]] and within(line[x], line[y], threshold(min(len(line[x]), len(line[y])))):
                    label = merge_labels(label, at[[x]], at[[y]])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.table({"u": pa.array(nodes[moved]), "v": pa.array(nodes[label[moved]])})

    return ready.groupBy("g").applyInArrow(verify, "u long, v long")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the key; those named like the following are left out) of every row, with n_lines, n_exact and n_near (lines removed as copies and as near-copies) and the text left.

    Lines stand between newlines; blank ones under NEAR_CHARS characters stay.  The first line of a class stays: by key (null last),
    then by row, then within the text; repeated rows are copies of each other.  An empty table gives an empty one.  docs are read more than once: they come from files or a checkpoint.  A text loses its removed lines with the newlines that end them.  Null text: null, no lines.
    """
    ship(docs.sparkSession)
    kept = [n for n in ([key] if keep is None else keep) if n not in {text, "n_lines", "n_exact", "n_near"}]
    kind = docs.schema[key].dataType.simpleString()
    base = number_rows(docs.select(F.struct(*[F.col(f"`{n}`") for n in dict.fromkeys([key, *kept])]).alias("_row"), F.col(f"`{text}`").alias("t")))
    texts = base.select(F.col(f"_row.`{key}`").alias("k"), "row", "t")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen = Keys(), set()
        for batch in batches:
            for i, part in _pieces(batch, "t"):
                of, no, hashes, more, entries, count, probes, asked = [], [], [], [], [], [], [], []
                for x, text in enumerate(part):
                    for z, line in enumerate(text.split("\n")):
                        if takes_part(line):
                            h = line_hash(line)
                            of.append(i + x)
                            no.append(z)
                            hashes.append(h)
                            more.append(xxhash.xxh64_intdigest(line.encode(), 7))
                            own, rest = [], []
                            if h not in seen:
                                own = keys.of(line, index_only=True)[0]
                                if h % SAMPLED == 0:
                                    rest = [key for key, probe in zip(*keys.of(line), strict=True) if probe]
                            entries += own
                            count.append(len(own))
                            probes += rest
                            asked.append(len(rest))
                            seen.add(h)
                if len(seen) > 1 << 20:
                    seen.clear()
                at = pa.array(of, pa.int64())
                # null where there are none: these rows are written
                lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(c)).astype(np.int32)), pa.array(np.array(x, np.uint64).view(np.int64)), mask=pa.array(np.array(c, np.int64) == 0)) for x, c in ((entries, count), (probes, asked))]
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (hashes, more)]
                columns = [batch.column("k").take(at), batch.column("row").take(at), pa.array(no, pa.int32()), *longs, *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "row", "no", "h", "more", "entries", "probes"])

    lines = cut(texts.mapInArrow(find, f"k {kind}, row long, no int, h long, more long, entries array<bigint>, probes array<bigint>"))
    place = F.struct(F.col("k").isNull().alias("z"), "k", "row", "no")
    distinct = cut(lines.groupBy("h", "more").agg(F.min(place).alias("first")))
    roots = components(link_lines(texts, lines.select(F.explode("entries").alias("key")), lines.select(F.explode("probes").alias("key"))))
    # a line without links is a class of its own by all its bits
    alone = F.when(F.col("node").isNull() & ~F.col("is_root"), F.col("more"))
    rooted = distinct.join(roots, F.col("h") == F.col("node"), "left").join(roots.select(F.col("root").alias("r")).distinct(), F.col("h") == F.col("r"), "left").withColumn("is_root", F.col("r").isNotNull())
    rooted = rooted.select("h", "more", "first", F.struct(F.coalesce("root", "h").alias("root"), F.coalesce(alone, F.lit(0)).alias("alone")).alias("root"))
    classes = cut(rooted.groupBy("root").agg(F.min("first").alias("best")))
    # of each line: the first place of its own text, and of its class
    known = rooted.join(classes.withColumnRenamed("root", "root2"), F.col("root") == F.col("root2")).select(F.col("h").alias("h2"), F.col("more").alias("more2"), "first", "best")
    gone = lines.drop("entries", "probes").join(known, (F.col("h") == F.col("h2")) & (F.col("more") == F.col("more2"))).where(place != F.col("best")).select("row", "no", (place == F.col("first")).alias("near"))
    listed = gone.groupBy("row").agg(F.collect_list(F.struct("no", "near")).alias("gone")).withColumnRenamed("row", "row2")
    out = base.join(listed.hint("shuffle_hash"), F.col("row") == F.col("row2"), "left")
    # both arrays are columns of their own: inside a lambda they would be made anew for each element
    out = out.withColumn("parts", F.split("t", "\n")).withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.transform("gone", lambda x: x["no"])))
    parts = F.col("parts")
    left = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform("stay", lambda i: parts[i]), "\n"))
    near = F.size(F.filter("gone", lambda x: x["near"]))
    none = F.col("gone").isNull()
    return out.select(
        *[F.col(f"_row.`{n}`").alias(n) for n in kept],
        F.when(F.col("t").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("gone") - near).cast("long").alias("n_exact"),
        F.when(none, 0).otherwise(near).cast("long").alias("n_near"),
        left.alias(text),
    )
