"""Near-copies of documents: operator 1's fingerprints at a wider radius, and then the Jaccard similarity of the sets of word shingles themselves.

1.  Texts become sets of shingle hashes, and sets ``WORDS`` SimHash fingerprints of 64
    bits each; texts of one set are one node.
2.  Nodes of which the first fingerprints differ in few bits meet by the
    generalised pigeonhole principle; pairs whose sizes or whose fingerprints together
    rule the similarity out are left.  First each group answers with the minimum spanning
    forest of its candidates, by bits of all fingerprints, and the forest's pairs
    are verified.  This links the bulk of a cluster without its pairs.
3.  Nodes that still have candidates of another cluster meet again, each with a
    sketch of its set: the parities of its shingles by hash, 2 to 4 bits a shingle.
    Bits in which two sketches differ are no more than shingles in which the sets
    do, so only pairs that can have the similarity leave the groups.
4.  Sets of the pairs to be verified are fetched and their intersections counted.

Every link has the similarity.  At a similarity s fingerprints differ in each bit
with a chance of acos(2 s / (1 + s)) / pi, so some pairs near the least s
never meet; a document is lost to its cluster only with all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import OUT_BYTES, cut, text_bytes
from .components import components, merge_labels
from .simhash import HOT, Plan, close_pairs, meet, plan_for

#: Fixed value: the similarity that makes near-copies, as a fraction.
NUM, DEN = 4, 5
#: Fingerprints of a set, and differing bits of all together.
WORDS, ALL = 4, 50
#: Differing bits of the first fingerprints.
BITS = 13
FPS = ("fp", *(f"fp{i}" for i in range(2, WORDS + 1)))
#: Candidates of a group that are thinned to a forest at once.
FOREST = 1 << 20
#: The filter that picks the sets to fetch has so many words of 64 bits (8 MB), whatever the corpus; what passes it wrongly is dropped by the join.
FILTER_WORDS = 1 << 20
#: An odd multiplier.
MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of lower-cased (A-Z) text; fewer words than a shingle are one, no words the hash of nothing."""
    words = text.lower().split()  # of bytes: A-Z, and 09-0D and 20 only
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([hash64(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    a, b = np.append(0, ends[: n - 1]).tolist(), (ends[shingle - 1 :] - 1).tolist()
    return np.unique(np.fromiter([hash64(joined[x:y], 42) for x, y in zip(a, b, strict=True)], np.uint64, n))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 7)


def some_fingerprints(s: np.ndarray) -> np.ndarray:
    """Majority of the bits of the hashes, and of the hashes mixed once and more often."""
    words = [s]
    while len(words) < WORDS:
        x = (words[-1] ^ (words[-1] >> np.uint64(31))) * MIX
        words.append(x ^ (x >> np.uint64(29)))
    every = np.stack(words, axis=1)
    total = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(s), 255):  # so many fit a byte
        total += np.unpackbits(every[i : i + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(s), bitorder="little").view(np.uint64)


def reaches(common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets of so many shingles in sum have the similarity with so many in common."""
    return common * (NUM + DEN) >= NUM * sizes


def sketch(s: np.ndarray) -> bytes:
    """Parities of the shingles by the upper bits of their hashes, in the power of two of bits over twice their number."""
    bits = max(64, 1 << (2 * len(s)).bit_length())
    odd = np.bincount((s >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles in which sets of these sketches differ, at least."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # a slot of half as many is two neighbours
        bits = np.unpackbits(x, bitorder="little")
        x = np.packbits(bits[::2] ^ bits[1::2], bitorder="little")
    return int(np.bitwise_count(x ^ y).sum())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(batch.num_rows * OUT_BYTES / max(batch.nbytes, OUT_BYTES)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def forest(u: np.ndarray, v: np.ndarray, cost: np.ndarray, nodes: int) -> np.ndarray:
    """Places of the links of a minimum spanning forest: in each round every tree takes its cheapest link to another."""
    order = np.argsort(cost, kind="stable")
    label, taken = np.arange(nodes), []
    while len(order):
        a, b = label[u[order]], label[v[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            break
        _, first = np.unique(np.stack([a, b], axis=1).reshape(-1), return_index=True)
        best = order[np.unique(first // 2)]
        taken.append(best)
        label = merge_labels(label, u[best], v[best])
    return np.concatenate([np.empty(0, np.int64), *taken]).astype(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least differences of sketches, pair by pair."""
    out = np.zeros(len(a), np.int64)
    x, y = (np.fromiter(map(len, z), np.int64, len(z)) for z in (a, b))
    for size in np.unique(x[x == y]).tolist():
        own = np.flatnonzero((x == size) & (y == size))
        for i in range(0, len(own), 1 << 14):
            part = own[i : i + (1 << 14)]
            p, q = (np.frombuffer(b"".join(z[part].tolist()), np.uint8).reshape(-1, size) for z in (a, b))
            out[part] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    for i in np.flatnonzero(x != y).tolist():
        out[i] = least_difference(a[i], b[i])
    return out


def candidates(nodes: DataFrame, plan: Plan, n: int, bits: int, kind: str, hot: int = HOT) -> DataFrame:
    """Of the candidates that the plan finds among at most n nodes (sid, fp, fp2, ..., n, label) of different labels, by kind: pairs (u, v: sid) of each group's minimum
    spanning forest ("forest"), all nodes that have one ("nodes": sid), or all pairs whose sketches (k) allow the similarity ("pairs")."""

    def check(c: dict[str, np.ndarray]) -> pa.Table:
        order = np.lexsort((c["probe"], c["gkey"]))
        c = {k: x[order] for k, x in c.items()}
        more, size, label = [c[x].view(np.uint64) for x in FPS[1:]], c["n"], c["label"]
        ids, at = np.unique(c["sid"], return_inverse=True)
        parts, has = [np.empty((3, 0), np.int64)], np.zeros(len(ids), bool)
        for a, b in close_pairs(c["gkey"], c["fp"], c["probe"], c["left"], c["right"], bits):
            keep = (label[a] != label[b]) & (DEN * np.minimum(size[a], size[b]) >= NUM * np.maximum(size[a], size[b]))
            a, b = a[keep], b[keep]
            d = np.bitwise_count(c["fp"][a] ^ c["fp"][b]).astype(np.int64)
            for x in more:
                d += np.bitwise_count(x[a] ^ x[b])
            keep = d <= ALL
            a, b, d = a[keep], b[keep], d[keep]
            if kind == "nodes":
                has[at[a]] = has[at[b]] = True
                continue
            if kind == "pairs":
                keep = _apart(c["k"][a], c["k"][b]) * (NUM + DEN) <= (DEN - NUM) * (size[a] + size[b])
                a, b, d = a[keep], b[keep], d[keep]
            parts.append(np.stack([at[a], at[b], d]))
            if kind == "forest" and sum(p.shape[1] for p in parts) > FOREST:
                found = np.concatenate(parts, axis=1)
                parts = [found[:, forest(*found, len(ids))]]
        if kind == "nodes":
            return pa.table({"sid": ids[has]})
        found = np.concatenate(parts, axis=1)
        found = found[:, forest(*found, len(ids))] if kind == "forest" else found
        pairs = np.unique(np.stack([np.minimum(found[0], found[1]), np.maximum(found[0], found[1])], axis=1), axis=0)
        return pa.table({"u": ids[pairs[:, 0]], "v": ids[pairs[:, 1]]})

    columns = ["sid", *FPS, "n", "label"] + ["k"] * (kind == "pairs")
    return cut(meet(nodes.select(*columns), plan, n, check, "sid long" if kind == "nodes" else "u long, v long", hot).distinct())


def fetch_sets(wanted: DataFrame, named: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """sid, sketch k and set s of the wanted sid.  texts: row, t; named: row and sid of one text of each set."""
    sc = texts.sparkSession.sparkContext
    rows = named.join(wanted.withColumnRenamed("sid", "sid2"), F.col("sid") == F.col("sid2")).select("row")
    mixed = rows.select(F.xxhash64("row").alias("h"))
    marks = mixed.groupBy(F.col("h").bitwiseAND(FILTER_WORDS - 1).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 40) & 63 as int))")).alias("m")).toArrow()  # at most FILTER_WORDS rows
    table = np.zeros(FILTER_WORDS, np.uint64)
    table[marks.column("w").to_numpy()] = marks.column("m").to_numpy().view(np.uint64)
    shared = sc.broadcast(table)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            hit = table[h & np.uint64(FILTER_WORDS - 1)] >> (h >> np.uint64(40) & np.uint64(63)) & np.uint64(1) == 1
            for part in _pieces(iter([batch.filter(pa.array(hit))])):
                ids, sketches, sets = [], [], []
                for t in text_bytes(part.column(0)):
                    s = shingle_set(t, shingle)
                    sid = set_id(s)
                    if sid not in seen:
                        seen.add(sid)
                        ids.append(sid)
                        sketches.append(sketch(s))
                        sets.append(s.tobytes())
                if len(seen) > 1 << 20:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())], names=["sid", "k", "s"])

    sets = texts.select("t", F.xxhash64("row").alias("h")).mapInArrow(fetch, "sid long, k binary, s binary").dropDuplicates(["sid"])
    return cut(sets.join(wanted, "sid", "left_semi"))


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of sets that have the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (a, b))
                common = np.intersect1d(x, y, assume_unique=True).size
                good.append(bool(reaches(common, len(x) + len(y))))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    for end in ("u", "v"):
        pairs = pairs.join(sets.select(F.col("sid").alias(end), F.col("s").alias(f"s_{end}")), end)
    return cut(pairs.select("u", "v", "s_u", "s_v").mapInArrow(verify, "u long, v long"))


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, hot: int = HOT) -> DataFrame:
    """key and component_id (the smallest key among all that links reach, itself included) of every row.

    Null text counts as empty; texts without words are copies of each other, and texts of fewer words than a shingle are one
    shingle.  Texts of any length are read whole, repeated rows stay, other columns play no part, and an empty table gives an
    empty one.  docs are read more than once: they come from files or a checkpoint, and key is the same each time.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{key}`").alias("row"), F.col(f"`{text}`").alias("t"))
    kind = docs.schema[key].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            sets = [shingle_set(t, shingle) for t in text_bytes(part.column(1))]
            fps = np.array([some_fingerprints(s) for s in sets], np.uint64).reshape(-1, WORDS)
            columns = [np.array([set_id(s) for s in sets], np.uint64), *fps.T]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x.copy().view(np.int64)) for x in columns], pa.array([len(s) for s in sets], pa.int64())], names=["row", "sid", *FPS, "n"])

    own = cut(texts.mapInArrow(sign, f"row {kind}, sid long, " + ", ".join(f"{x} long" for x in FPS) + ", n long"))
    nodes = cut(own.groupBy("sid").agg(F.min("row").alias("row"), *[F.min(x).alias(x) for x in (*FPS, "n")]))
    named = nodes.select("sid", "row")

    plan, n = plan_for(nodes, BITS)
    met = candidates(nodes.withColumn("label", F.col("sid")), plan, n, BITS, "forest", hot)
    ends = met.select(F.explode(F.array("u", "v")).alias("sid")).distinct()
    found = similar_pairs(met, fetch_sets(ends, named, texts, shingle))
    roots = components(found).select("node", F.col("root").alias("label"))
    labelled = cut(nodes.join(roots, F.col("sid") == F.col("node"), "left").select("sid", *FPS, "n", F.coalesce("label", "sid").alias("label")))
    open_ = candidates(labelled, plan, n, BITS, "nodes", hot)
    sets = fetch_sets(open_, named, texts, shingle)
    left = labelled.join(sets.select("sid", "k"), "sid")
    rest = candidates(left, plan, sets.count(), BITS, "pairs", hot)
    roots = components(found.unionByName(similar_pairs(rest, sets)))
    rooted = nodes.join(roots, F.col("sid") == F.col("node"), "left").select("sid", "row", F.coalesce("root", "sid").alias("root"))
    # cut, so that the join's sides are plain exchanges, whose hot partitions Spark can split
    least = cut(rooted.groupBy("root").agg(F.min("row").alias("component_id")))
    of_sid = rooted.select("sid", "root").join(least, "root").select(F.col("sid").alias("sid2"), "component_id")
    return own.join(of_sid, F.col("sid") == F.col("sid2")).select(F.col("row").alias(key), "component_id")
