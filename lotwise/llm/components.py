"""Connected components of a graph held in a DataFrame of links.

Alternating large-star and small-star steps: every node's links are moved to
its smallest neighbour until each component is a star around its smallest node.
The number of steps is logarithmic in a component's diameter; each ends in a
checkpoint, so neither lineage nor a lost executor matters.  Links are never
gathered on the driver.  Before the steps tasks contract the links they hold,
``LOCAL`` at a time; no more links than that are settled so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import cut

#: Links that a task contracts at once.
LOCAL = 1 << 18


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.withColumnRenamed("u", "u2"), F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct()


def _contract(batches: Iterator[pa.RecordBatch], local: int) -> Iterator[pa.RecordBatch]:
    """Each ``local`` links as stars around the smallest node of what they connect."""
    held, rows = [], 0

    def stars() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        every = np.arange(len(ids))
        label = merge_labels(every.copy(), at[: len(u)], at[len(u) :])
        moved = label != every
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    for batch in batches:
        while batch.num_rows:
            part, batch = batch.slice(0, local - rows), batch.slice(local - rows)
            held.append(part)
            rows += part.num_rows
            if rows == local:
                yield stars()
                held, rows = [], 0
    if rows:
        yield stars()


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """links: columns u and v (long; self-links and repeats allowed).  Returns node, root (its component's smallest node) for each linked node but the roots."""
    ship(links.sparkSession)
    now = cut(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = now.count()
    if n:
        now = cut(now.coalesce(-(-n // local)).mapInArrow(lambda it: _contract(it, local), "u long, v long"))
    before = None
    while n > local:
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if sign == before:
            break
        before = sign
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a node's smallest known fellow) after linking a[i] with b[i]."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:  # point to the end of each chain
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
    return label


def pairs_by_key(keys: np.ndarray, probe: np.ndarray, portion: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of equal keys, about ``portion`` at once; two probes do not meet.  Rows are sorted by key, index entries before probes."""
    if not len(keys):
        return
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
    sizes = np.diff(np.append(0, ends))
    start = np.repeat(ends - sizes, sizes)
    entries = np.repeat(np.add.reduceat((~probe).astype(np.int64), ends - sizes), sizes)
    before = np.minimum(np.arange(len(keys)) - start, entries)  # the index entries that stand before a row
    total = np.append(0, np.cumsum(before))
    r = 0
    while r < len(keys):
        stop = max(r + 1, int(np.searchsorted(total, total[r] + portion, side="right")) - 1)
        a = np.repeat(np.arange(r, stop), before[r:stop])
        yield a, np.arange(len(a)) - np.repeat(total[r:stop] - total[r], before[r:stop]) + start[a]
        r = stop
