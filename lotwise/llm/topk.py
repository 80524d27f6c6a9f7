"""Operator 10: exact top-k by inner product, with a KD-tree for each shard of the vectors.

Vectors alike count once for all but their ``k + 1`` smallest keys, which is all that
ties can ask for.  A coarse KD-tree of a bounded sample (``SAMPLE``) cuts space into cells;
it decides costs only.  A cell is one shard or, by a hash of the key, several,
and each shard becomes one KD-tree: median splits along the widest side, leaves
of ``LEAF`` vectors, and a tight bounding box at every node.  A box bounds the
inner products of its vectors with a query by sum(max(q * low, q * high)).

Each query is first answered by its own shard.  The k-th score found there goes
with it: cells whose tight boxes do not reach it are left out before anything is
shuffled, and to the shards of the others the query travels in blocks.  Within
a shard, nodes are expanded from the root while their bound reaches the
threshold, and leaves are visited best bound first, the threshold rising with
every leaf.  Boxes at exactly the threshold are opened, so ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship
from .common import cut

SHARD, BLOCK, LEAF = 2048, 512, 64
#: Cells of space, and sampled vectors that say where they are cut, at most.
CELLS, SAMPLE = 1024, 16_384
SCALE = 256.0


def build(points: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """order: points' places; nodes: start, stop, left (its right neighbour is the other child; -1: leaf), low, high, and where inner ones are cut: axis and at."""
    order = np.arange(len(points))
    start, stop, left, low, high, axis, at = [0], [len(points)], [-1], [], [], [], []
    i = 0
    while i < len(start):
        a, b = start[i], stop[i]
        own = points[order[a:b]]
        lo, hi = own.min(0), own.max(0)
        low.append(lo)
        high.append(hi)
        axis.append(int(np.argmax(hi - lo)) if own.shape[1] else 0)
        at.append(0.0)
        if b - a > leaf:
            along = own[:, axis[-1]]
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, mid)]
            at[-1] = points[order[a + mid], axis[-1]]
            left[i] = len(start)
            start += [a, a + mid]
            stop += [a + mid, b]
            left += [-1, -1]
        i += 1
    return {"order": order, "start": np.array(start), "stop": np.array(stop), "left": np.array(left), "low": np.array(low), "high": np.array(high), "axis": np.array(axis), "at": np.array(at)}


def cell_of(tree: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    """The leaf (its node's number) that each point falls into."""
    node = np.zeros(len(points), np.int64)
    while True:
        inner = np.flatnonzero(tree["left"][node] >= 0)
        if not len(inner):
            return node
        own = node[inner]
        node[inner] = tree["left"][own] + (points[inner, tree["axis"][own]] >= tree["at"][own])


def search(tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores (queries x k) of the best of this tree at or over ``floor``, by falling score and rising id; unfilled: -inf."""
    n = len(queries)
    best, best_ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.copy()
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = up @ tree["high"].T + down @ tree["low"].T  # queries x nodes
    # from the root down, while a node's bound reaches the threshold
    open_ = np.zeros(bound.shape, bool)
    open_[:, 0] = True
    for i in range(len(tree["left"])):
        open_[:, i] &= bound[:, i] >= kth
        if tree["left"][i] >= 0:
            open_[:, tree["left"][i] : tree["left"][i] + 2] = open_[:, i : i + 1]
    leaves = np.flatnonzero(tree["left"] < 0)
    first = np.where(open_[:, leaves], bound[:, leaves], -np.inf)
    turn = np.argsort(-first, axis=1, kind="stable")
    for r in range(len(leaves)):
        at = turn[:, r]
        going = (first[np.arange(n), at] >= kth) & (first[np.arange(n), at] > -np.inf)
        if not going.any():
            break  # leaves come by falling bound
        for leaf in np.unique(at[going]):
            rows = np.flatnonzero(going & (at == leaf))
            node = leaves[leaf]
            put = tree["order"][tree["start"][node] : tree["stop"][node]]
            score = queries[rows] @ points[put].T
            score[ids[put][None, :] == own[rows][:, None]] = -np.inf
            hit = (score >= kth[rows][:, None]).any(1)
            rows, score = rows[hit], score[hit]
            if not len(rows):
                continue
            all_scores = np.concatenate([best[rows], score], axis=1)
            all_ids = np.concatenate([best_ids[rows], np.broadcast_to(ids[put], score.shape)], axis=1)
            top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows], best_ids[rows] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
            kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
    best[best < floor[:, None]] = -np.inf
    return best_ids, best


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _exact(points: np.ndarray, dim: int) -> np.ndarray:
    """Doubles where all products and sums are exact in them, Python integers else."""
    top = float(np.abs(points).max()) if points.size else 0.0
    return points if dim * top * top < 2**53 else np.vectorize(int, otypes=[object])(points)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, shard: int = SHARD, block: int = BLOCK, scale: float = SCALE) -> DataFrame:
    """query_id, rank (from 1), key and score of the k best of every query: rows whose key is divisible by ``every``.

    Components become floor(scale * x).  Candidates are the rows of another key and the same number of components, repeated rows
    each; ties go to the smaller key.  A query's own repeated rows are one query; a key of several vectors is answered by the k best of
    all their products.  Vectors that are null, empty or hold null or non-finite components, and rows with a null key, take no part.
    Fewer than k candidates: all of them; an empty table: no rows.  Other columns, whatever their names, play no part.
    """
    spark = vectors.sparkSession
    ship(spark)
    c = F.col(f"`{vector}`")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col(f"`{key}`").isNotNull() & c.isNotNull() & (F.size(c) > 0) & fine).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )
    rows = cut(good.groupBy("id", "v").agg(F.count("*").alias("times")))
    first = F.row_number().over(W.partitionBy("v").orderBy("id"))
    points = rows.withColumn("_r", first).where(F.col("_r") <= k + 1)
    points = cut(points.select("id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))).alias("_c")).drop("_c"))
    n = points.count()
    n_cells = min(CELLS, 1 << max(0, -(-n // shard) - 1).bit_length())
    # the sample: what comes first by a hash
    taken = points.select("dim", "v").orderBy(F.xxhash64("v", "id"), "dim").limit(min(SAMPLE, 16 * n_cells)).toArrow()
    cuts: dict[int, dict[str, np.ndarray]] = {}
    for dim in set(taken.column("dim").to_pylist()):
        own = _matrix(taken.filter(pa.compute.equal(taken.column("dim"), dim)).column("v"), dim)
        cuts[dim] = build(own, max(1, -(-len(own) // n_cells)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in cuts:
                    own = np.flatnonzero(dims == dim)
                    cell[own] = cell_of(cuts[dim], _matrix(batch.column("v").take(pa.array(own)), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    def dealt(df: DataFrame) -> DataFrame:
        """With each row's cell and shard of it."""
        placed = df.mapInArrow(deal, "id long, v array<double>, dim int, cell int").join(F.broadcast(subs), ["dim", "cell"])
        return placed.withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))

    # CELLS rows for each number of components
    subs = cut(points.mapInArrow(deal, "id long, v array<double>, dim int, cell int").groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("subs")))

    def plant(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        tree = build(points := _matrix(t.column("v"), dim))
        out = {x: [t.column(x)[0].as_py()] for x in ("dim", "cell", "sub")} | {"ids": [t.column("id").to_numpy().tobytes()], "points": [points.tobytes()]}
        out |= {x: [tree[x].astype(float if x in BOXES else np.int64).tobytes()] for x in TREE}
        out |= {"root_low": [tree["low"][0].tolist()], "root_high": [tree["high"][0].tolist()]}
        kinds = [*[(x, pa.int32()) for x in ("dim", "cell", "sub")], *[(x, pa.binary()) for x in ("ids", "points", *TREE)], *[(x, pa.list_(pa.float64())) for x in ("root_low", "root_high")]]
        return pa.table(out, schema=pa.schema(kinds))

    tree_schema = "dim int, cell int, sub int, ids binary, points binary, " + ", ".join(f"{x} binary" for x in TREE) + ", root_low array<double>, root_high array<double>"
    trees = cut(dealt(points).groupBy("dim", "cell", "sub").applyInArrow(plant, tree_schema))
    # tight boxes of cells: CELLS rows for each number of components
    sides = trees.select("dim", "cell", F.posexplode(F.arrays_zip("root_low", "root_high")).alias("i", "x")).groupBy("dim", "cell", "i").agg(F.min("x.root_low").alias("low"), F.max("x.root_high").alias("high"))
    boxes: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
    gathered = sides.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("side")).orderBy("dim", "cell").collect()
    for r in gathered:
        boxes.setdefault(r["dim"], ([], [], []))
        for put, x in zip(boxes[r["dim"]], (r["cell"], [s["low"] for s in r["side"]], [s["high"] for s in r["side"]]), strict=True):
            put.append(x)
    shared = spark.sparkContext.broadcast({dim: (np.array(c, np.int32), np.array(lo), np.array(hi)) for dim, (c, lo, hi) in boxes.items()})
    queries = cut(dealt(rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", F.size("v").alias("dim"))).select("id", "v", "dim", "cell", "sub"))
    blocks = max(1, -(-queries.count() // block))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the cells whose boxes reach its threshold."""
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                dims, kth = batch.column("dim").to_numpy(), batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
                for dim in np.unique(dims).tolist():
                    cells, low, high = shared.value.get(dim, (np.empty(0, np.int32), np.empty((0, dim)), np.empty((0, dim))))
                    own = np.flatnonzero(dims == dim)
                    q = _matrix(batch.column("v").take(pa.array(own)), dim)
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    # the bound's own rounding, far under one unit while scores stay under 2^52, must not cut off a tie
                    at, to = np.nonzero(~(bound + np.abs(bound) * 1e-12 < kth[own][:, None]))
                    part = batch.take(pa.array(own[at]))
                    yield pa.RecordBatch.from_arrays([*[part.column(x) for x in ("id", "v", "dim", "kth", "cell", "sub")], pa.array(cells[to])], names=["id", "v", "dim", "kth", "home", "home_sub", "cell"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                tree = {x: np.frombuffer(row[x], float if x in BOXES else np.int64) for x in TREE}
                tree["low"], tree["high"] = tree["low"].reshape(-1, dim), tree["high"].reshape(-1, dim)
                points = _exact(np.frombuffer(row["points"], float).reshape(-1, dim), dim)
                queries = _exact(np.array([q["v"] for q in row["asked"]], float).reshape(-1, dim), dim)
                own = np.array([q["id"] for q in row["asked"]], np.int64)
                floor = np.array([-np.inf if q["kth"] is None else q["kth"] for q in row["asked"]])
                ids, scores = search(tree, points, np.frombuffer(row["ids"], np.int64), queries, own, floor, k)
                q, j = np.nonzero(scores > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[q, j]), pa.array(scores[q, j].astype(np.int64))], names=["query_id", "id", "score"])

    def round_of(asked: DataFrame) -> DataFrame:
        """asked: id, v, dim, kth, cell and sub to be searched."""
        packed = asked.groupBy("dim", "cell", "sub", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v", "kth")).alias("asked"))  # at most about ``block`` rows
        return trees.drop("root_low", "root_high").join(packed, ["dim", "cell", "sub"]).mapInArrow(meet, "query_id long, id long, score long")

    home = cut(round_of(queries.withColumn("kth", F.lit(None).cast("double"))))
    kth = home.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("found")).select(F.col("query_id").alias("q"), F.when(F.col("found") >= k, F.col("kth")).alias("kth"))
    known = queries.join(kth, F.col("id") == F.col("q"), "left").select("id", "v", "dim", "kth", "cell", "sub")
    rest = known.mapInArrow(reached, "id long, v array<double>, dim int, kth double, home int, home_sub int, cell int").join(F.broadcast(subs), ["dim", "cell"])
    rest = rest.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).where((F.col("cell") != F.col("home")) | (F.col("sub") != F.col("home_sub")))
    found = home.unionByName(round_of(rest))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


#: Arrays of a tree that travel, and those of them that hold doubles.
TREE = ("order", "start", "stop", "left", "low", "high")
BOXES = ("low", "high")
