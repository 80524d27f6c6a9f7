"""Operator 1: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are computed from whole texts in Arrow batches.  Distinct
fingerprints that differ in at most ``bits`` bits are then linked:

* All fingerprints' bit co-occurrences give thirty-two blocks of two correlated
  bits; the blocks' value histograms (thirty-two times 4 counts, also over all
  fingerprints) give the distribution of distances within any union of blocks.
* For each division of the blocks into m partitions, dynamic programming
  allocates thresholds t_1..t_m of sum bits - m + 1 (-1 leaves a partition out)
  so that probes and expected candidates cost least; the cheapest division is
  taken.  If every partition differed in more than t_i bits, the whole would
  differ in more than ``bits``, so no link is lost whatever the estimates.
* Each fingerprint is stored under its value in each partition used and probes
  the values within t_i of it, larger values only, so a pair meets once.
* Values of many fingerprints or probes are split into blocks of both, each pair of blocks a
  group of its own; probes of values without fingerprints end there.  Groups are
  verified with popcounts in numpy and answer with a spanning forest, never with
  all their pairs.

Components come from ``components``; nothing of size of the corpus reaches the
driver.  ``near`` verifies what meets here on sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import by_batch, cut, text_bytes
from .components import components, merge_labels, pairs_by_key

#: Correlated bits are grouped into so many blocks, each with so many values.
BLOCKS = 32
VALUES = 1 << 64 // BLOCKS
#: A partition's value of more fingerprints and probes than this is split into blocks of about half as many.
HOT = 32_768
#: Rows of one verified group, about.
GROUP_ROWS = 32_768
#: Candidate pairs verified at once, and pairs of a value from which on they are verified as a block.
PAIRS, BLOCK = 1 << 18, 1 << 12
#: Relative costs of a shuffled row (about 3 microseconds) and of a verified candidate (about 5 nanoseconds in blocks).
ROW_COST, PAIR_COST = 1.0, 0.0017
#: Partitions tried, at most.
MOST_PARTS = 12


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of XXH64 (seed 42) over the word shingles of lower-cased (A-Z) text, repeats included; without words 0."""
    words = text.lower().split()  # of bytes: A-Z, and 09-0D and 20 only
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if n <= 1:
        return hash64(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    total = np.zeros(64, np.int64)
    for i in range(0, n, 255 * 512):
        a, b = starts[i : min(n, i + 255 * 512)].tolist(), (ends[shingle - 1 :][i : i + 255 * 512] - 1).tolist()
        hashes = np.fromiter([hash64(joined[x:y], 42) for x, y in zip(a, b, strict=True)], "<u8", len(a))
        padded = np.zeros(-(-len(a) // 255) * 255, "<u8")
        padded[: len(a)] = hashes
        set_bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 255, 64)
        total += set_bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # 255 rows fit a byte
    return int(((total * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """key and fp (the 64 bits as a long) of every row; null text counts as empty, and texts without words get 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["k", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(by_batch(run), f"k {kind}, fp long").withColumnRenamed("k", key)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_blocks(together: np.ndarray, n: int) -> list[list[int]]:
    """The 64 bits in BLOCKS blocks, each grown greedily around the most correlated pair left.  together[i, j]: fingerprints with both bits."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, blocks = list(range(64)), []
    while left:
        sub = r[np.ix_(left, left)]
        i, j = np.unravel_index(int(sub.argmax()), sub.shape)
        block = sorted({left[i], left[j]}) if i != j else left[:2]
        left = [b for b in left if b not in block]
        while len(block) < 64 // BLOCKS:
            best = max(left, key=lambda b: (r[b, block].sum(), -b))
            block.append(best)
            left.remove(best)
        blocks.append(sorted(block))
    return blocks


def distances(histogram: np.ndarray) -> np.ndarray:
    """Shares of ordered pairs by Hamming distance, from counts of 2^w values (Walsh-Hadamard convolution)."""
    h = histogram.astype(float)
    w = len(h).bit_length() - 1

    def walsh(x: np.ndarray) -> np.ndarray:
        for k in range(w):
            y = x.reshape(-1, 2, 1 << k)
            x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(-1)
        return x

    pairs = walsh(walsh(h) ** 2) / len(h)
    weight = np.array([v.bit_count() for v in range(len(h))])
    out = np.bincount(weight, weights=np.maximum(pairs, 0), minlength=w + 1)
    return out / max(out.sum(), 1)


@dataclass(frozen=True)
class Plan:
    """parts: bits of each partition used; radii: how far each is probed."""

    parts: tuple[tuple[int, ...], ...]
    radii: tuple[int, ...]


def allocate(parts: list[list[int]], shares: list[np.ndarray], n: int, bits: int) -> tuple[float, tuple[int, ...]]:
    """Cheapest thresholds of sum bits - m + 1, each at least -1, by dynamic programming over the partitions."""
    need = bits - len(parts) + 1
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part, share in zip(parts, shares, strict=True):
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(bits, len(part)) + 1):
                more = 0.0
                if t >= 0:
                    rows = 1 + sum(comb(len(part), k) for k in range(1, t + 1)) / 2
                    copies = max(1.0, n * share[0] * rows / HOT)  # of rows of split values
                    more = ROW_COST * n * rows * copies + PAIR_COST * n * n * share[: t + 1].sum() / 2
                key = used + t
                if key not in step or cost + more < step[key][0]:
                    step[key] = (cost + more, (*chosen, t))
        best = step
    return best[need] if need in best else (float("inf"), ())


def make_plan(blocks: list[list[int]], histograms: np.ndarray, n: int, bits: int) -> Plan:
    per_block = [distances(h) for h in histograms]
    options = []
    for m in range(2, MOST_PARTS + 1):
        cuts = [round(i * BLOCKS / m) for i in range(m + 1)]
        parts = [sorted(b for block in blocks[x:y] for b in block) for x, y in zip(cuts, cuts[1:])]
        shares = []
        for x, y in zip(cuts, cuts[1:]):
            d = np.ones(1)
            for block in per_block[x:y]:
                d = np.convolve(d, block)
            shares.append(d)
        cost, radii = allocate(parts, shares, n, bits)
        options.append((cost, parts, radii))
    _, parts, radii = min(options, key=lambda o: o[0])
    used = [(tuple(p), t) for p, t in zip(parts, radii, strict=True) if t >= 0]
    return Plan(tuple(p for p, _ in used), tuple(t for _, t in used))


def project(fps: np.ndarray, part: tuple[int, ...] | list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed from bit 0 on."""
    fps = fps.astype(np.uint64)
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def signatures(fps: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, rows of fps, whether each is a probe (else an index entry)."""
    keys, rows, probes = [], [], []
    every = np.arange(len(fps))
    for i, (part, radius) in enumerate(zip(plan.parts, plan.radii, strict=True)):
        own = project(fps, part)
        # widths up to 56 leave the upper byte to the partition's number
        tag = np.uint64(i) << np.uint64(58)
        keys.append(own | tag)
        rows.append(every)
        probes.append(np.zeros(len(fps), bool))
        for k in range(1, radius + 1):
            for flips in combinations(range(len(part)), k):
                mask = np.uint64(sum(1 << f for f in flips))
                other = own ^ mask
                up = other > own
                keys.append(other[up] | tag)
                rows.append(every[up])
                probes.append(np.ones(int(up.sum()), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(probes)


def close_pairs(keys: np.ndarray, fps: np.ndarray, probe: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of one key, at ``bits`` or fewer differing bits: two index entries, or a probe and an entry, one on the left and the other on the right side.

    Rows are sorted by key, index entries before probes.
    """

    def good(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (left[a] & right[b]) | (left[b] & right[a])
        return a[keep], b[keep]

    if not len(keys):
        return
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
    starts = np.append(0, ends[:-1])
    entries = np.add.reduceat((~probe).astype(np.int64), starts)
    large = entries * (ends - starts) > BLOCK
    for s, e, m in zip(starts[large].tolist(), ends[large].tolist(), entries[large].tolist(), strict=True):
        step = max(1, PAIRS // m)
        for r in range(s, e, step):
            a, b = np.nonzero(np.bitwise_count(fps[r : min(e, r + step), None] ^ fps[None, s : s + m]) <= bits)
            a, b = a + r, b + s
            before = b < a  # each pair of entries once
            yield good(a[before], b[before])
    few = np.flatnonzero(np.repeat(~large, ends - starts))
    for a, b in pairs_by_key(keys[few], probe[few], PAIRS):
        a, b = few[a], few[b]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= bits
        yield good(a[near], b[near])


def verify(keys: np.ndarray, fps: np.ndarray, probe: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of fingerprints) of the links within one group, in rows as for close_pairs but in any order."""
    order = np.lexsort((probe, keys))
    keys, fps, probe, left, right = keys[order], fps[order], probe[order], left[order], right[order]
    nodes, at = np.unique(fps, return_inverse=True)
    label = np.arange(len(nodes))
    for a, b in close_pairs(keys, fps, probe, left, right, bits):
        label = merge_labels(label, at[a], at[b])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def plan_for(distinct: DataFrame, bits: int) -> tuple[Plan, int]:
    """The plan for the fingerprints (column fp), and their number."""
    n = distinct.count()

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            x = bits_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            for i in range(0, len(x), 1 << 20):
                total += (x[i : i + (1 << 20)].T @ x[i : i + (1 << 20)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096), pa.int32()), pa.array(total.reshape(-1))], names=["i", "n"])

    together = np.zeros(4096, np.int64)
    for row in distinct.select("fp").mapInArrow(count_pairs, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 4,096 rows
        together[row["i"]] = row["n"]
    blocks = correlated_blocks(together.reshape(64, 64), n)

    def count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCKS * VALUES, np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, block in enumerate(blocks):
                total[k * VALUES : (k + 1) * VALUES] += np.bincount(project(fps, block).astype(np.int64), minlength=VALUES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS * VALUES), pa.int32()), pa.array(total)], names=["i", "n"])

    histograms = np.zeros(BLOCKS * VALUES, np.int64)
    for row in distinct.select("fp").mapInArrow(count_values, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 128 rows
        histograms[row["i"]] = row["n"]
    return make_plan(blocks, histograms.reshape(BLOCKS, VALUES), n, bits), n


def meet(nodes: DataFrame, plan: Plan, n: int, check: Callable[[dict[str, np.ndarray]], pa.Table], schema: str, hot: int = HOT) -> DataFrame:
    """What check answers for each group of the n nodes (column fp, and others) that the plan brings together.

    check gets the nodes' columns and gkey (rows of one gkey are compared), probe, left and right, as close_pairs takes them.
    """
    names = nodes.columns
    longs = [x for x, kind in nodes.dtypes if kind == "bigint"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 8192):
                batch = whole.slice(i, 8192)
                keys, rows, probes = signatures(batch.column(names.index("fp")).to_numpy(zero_copy_only=False).view(np.uint64), plan)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(probes), *[c.take(at) for c in batch.columns]], names=["key", "probe", *names])

    signed = nodes.mapInArrow(sign, "key long, probe boolean, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields))
    sizes = signed.groupBy("key").agg(F.count_if(~F.col("probe")).alias("entries"), F.count_if("probe").alias("probes")).where(F.col("entries") + F.col("probes") > hot)
    half = max(1, hot // 2)
    # a node has each key once at most, so no key of that few nodes is hot
    crowded = None if n <= hot else cut(sizes.select(F.col("key").alias("hot_key"), F.ceil(F.col("entries") / half).cast("int").alias("eb"), F.ceil(F.col("probes") / half).cast("int").alias("pb")))
    per_row = sum(1 + sum(comb(len(p), k) for k in range(1, t + 1)) / 2 for p, t in zip(plan.parts, plan.radii, strict=True))
    groups = max(1, int(n * per_row / GROUP_ROWS))
    zero = F.lit(0)
    columns = ["key", "probe", *names]
    spread = signed.select(*columns, zero.alias("i"), zero.alias("j"), zero.alias("own"), zero.alias("kind"), F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g"))
    if crowded is not None and crowded.limit(1).count():
        # of a hot key, blocks of entries meet each other (kind 0) and blocks of probes (kind 1)
        known = signed.join(crowded, F.col("key") == F.col("hot_key"), "left")
        plain = known.where("eb is null").select(*columns, zero.alias("i"), zero.alias("j"), zero.alias("own"), zero.alias("kind"), F.pmod(F.xxhash64("key"), F.lit(groups)).alias("g"))
        to = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
        upto = lambda c: F.when(F.col(c) > 0, F.sequence(zero, F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
        split = known.where("eb > 0").withColumn("own", F.pmod(F.xxhash64(*longs), F.when(F.col("probe"), F.col("pb")).otherwise(F.col("eb"))).cast("int"))
        of_entry = F.concat(F.transform(upto("eb"), lambda x: to(F.least(x, "own"), F.greatest(x, "own"), 0)), F.transform(upto("pb"), lambda x: to(F.col("own"), x, 1)))
        of_probe = F.transform(upto("eb"), lambda x: to(x, F.col("own"), 1))
        split = split.withColumn("to", F.explode(F.when(F.col("probe"), of_probe).otherwise(of_entry))).select(*columns, "to.i", "to.j", "own", "to.kind")
        spread = plain.unionByName(split.withColumn("g", F.xxhash64("key", "i", "j", "kind")))

    def run(t: pa.Table) -> pa.Table:
        c = {x: t.column(x).to_numpy() for x in t.column_names}
        c["probe"] = c["probe"].astype(bool)
        c["fp"] = c["fp"].view(np.uint64)
        c["gkey"] = c["key"] * 1_000_003 ^ (c["i"].astype(np.int64) << 21) ^ (c["j"].astype(np.int64) << 1) ^ c["kind"]  # only to tell apart what else shares a group
        c["left"], c["right"] = np.where(c["kind"] == 1, ~c["probe"], c["own"] == c["i"]), np.where(c["kind"] == 1, c["probe"], c["own"] == c["j"])
        return check(c)

    return spread.groupBy("g").applyInArrow(run, schema)


def links(distinct: DataFrame, bits: int, hot: int = HOT) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that keep their components: enough pairs at ``bits`` or fewer differing bits, and none else."""
    ship(distinct.sparkSession)
    plan, n = plan_for(distinct, bits)

    def check(c: dict[str, np.ndarray]) -> pa.Table:
        u, v = verify(c["gkey"], c["fp"], c["probe"], c["left"], c["right"], bits)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return meet(distinct.select("fp"), plan, n, check, "u long, v long", hot)


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, bits: int = 4) -> DataFrame:
    """key, fp and component_id (the smallest key among all that links reach, itself included) of every row.

    Copies share a fingerprint and so a component; rows with a null key count, but never name a component unless all its
    keys are null.  Texts of any length are read whole, and repeated rows stay.  Other columns, whatever their names, play no
    part.  An empty table gives an empty one.
    """
    fps = cut(fingerprints(docs, key, text, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct, bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # cut, so that the join's sides are plain exchanges, whose hot partitions Spark can split
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    of_fp = rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("fp2"), "component_id")
    return fps.join(of_fp, F.col("fp") == F.col("fp2")).select(key, "fp", "component_id")
