"""Operator 9: mixing sources to target weights, in DataFrame functions only.

Every document starts at a rate of one copy and may be taken up to ``most``
(two) times.  Entropy balancing looks for the rates nearest to that start, in
the entropy of a bounded rate, whose words meet each source's target.  Its
convex dual has one multiplier a source: a document of x words gets

    rate = 2 / (1 + exp(-lambda * x / mean words of its source)),

an exponential tilt of its odds of a further copy.  Newton iterations (with a
bracket that guards each step) solve all sources' duals at once, every
iteration one distributed aggregate over the classes of documents of equal
source and size, which are all that the dual depends on.

Rates become whole copies by systematic rounding: documents stand in order of
falling size, and a document gets the copies by which the running sum of rates,
rounded, grows at it.  What a source is still off its target is made up with
its small documents.  Running sums go over blocks of classes first, so that no
task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, cut

#: The weights that sources take in turn, in order of their names, null last.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all; and the most times a document may be taken.
SHARE, MOST = 1.5, 2
#: Documents of equal source and size are dealt into cells of about this many.
CELL = 512


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: one row each, with source and source_size.  Adds weight and target.

    The whole is shared by weight; a target stops at ``most`` times its source's size and the excess goes to the others by
    weight, until none is above.  In order of cap per weight that is a single level: the capped sources come first.
    """
    named = F.col("source").isNull()
    place = F.row_number().over(W.orderBy(named, "source")) - 1  # one row a source: a small table
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy(F.col("cap") / F.col("weight"), named, "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole = F.sum("source_size").over(W.partitionBy(F.lit(0))) * share
    level = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first source that its share does not fill sets the level for itself and all after it
    final = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(every.partitionBy(F.lit(0)))["level"]
    return leveled.withColumn("target", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap")))).select("source", "source_size", "weight", "target")


def rate(x: Column, lam: Column, most: float = MOST) -> Column:
    """Copies of a document of relative size x; arguments are bounded so that exp stays finite."""
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * x))
    return F.lit(float(most)) / (1 + F.exp(-z))


def exact_sum(x: Column) -> Column:
    """A sum that does not depend on the order of its terms, so that reruns agree."""
    return F.sum(x.cast("decimal(38,9)")).cast("double")


def solve(classes: DataFrame, wanted: DataFrame, rounds: int = 60, most: float = MOST) -> DataFrame:
    """sid, lam and mean for each source of ``wanted`` (sid, source_size, target, mean); classes: sid, size, docs."""
    # each source's multiplier with the bracket that holds its root: the words taken grow with it;
    # a source at its cap takes every document as often as it may, the limit of large multipliers
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    now = wanted.select("sid", "target", "mean", F.when(full, 1e4).otherwise(0.0).alias("lam"), F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"))
    known = classes.select(F.col("sid").alias("cid"), "size", "docs")
    for k in range(rounds):
        x = F.col("size") / F.col("mean")
        r = rate(x, F.col("lam"), most)
        sums = known.join(now, F.col("cid") == F.col("sid")).groupBy("sid").agg(
            exact_sum(F.col("docs") * F.col("size") * r).alias("got"),
            exact_sum(F.col("docs") * F.col("size") * x * r * (1 - r / most)).alias("slope"),
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") + (F.col("target") - F.col("got")) / F.greatest("slope", F.lit(1e-9))
        off = F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0))
        joined = now.join(sums.withColumnRenamed("sid", "gid"), F.col("sid") == F.col("gid"))
        moved = joined.select(
            "sid", "target", "mean",
            F.when(off < 1e-9, F.col("lam")).when((step > low) & (step < high), step).otherwise((low + high) / 2).alias("lam"),
            low.alias("low"), high.alias("high"), off.alias("off"),
        )
        now = cut(moved.coalesce(1))  # a row a source: one small file, not one for every shuffle partition
        if not (now.agg(F.max("off").alias("off")).first()["off"] or 0.0) > 1e-8:
            break
        now = now.drop("off")
    return now.select("sid", "lam", "mean")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the key; those named like the following are left out) of every row, with size, source_size, target, rate, copies and taken.

    Null and empty texts have size 0 and no copies; a null source is a source like any other, last in order.  Copies depend
    on rows' contents alone, so reruns agree; rows alike in key, size and source may trade places.
    """
    made = {"size", "source_size", "target", "rate", "copies", "taken"}
    kept = [n for n in ([key] if keep is None else keep) if n not in made]
    rows = docs.select(
        F.struct(*[F.col(f"`{n}`") for n in kept]).alias("_row"),
        F.xxhash64(F.col(f"`{key}`")).alias("h"),
        F.col(f"`{source}`").alias("source"),
        count_words(f"`{text}`").alias("size"),
    )
    rows = cut(rows)
    per_source = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).coalesce(1))
    goal = cut(
        targets(per_source.select("source", "source_size"), weights, share)
        .withColumn("sid", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")))
        .join(per_source.select(F.col("source").alias("source2"), "n_docs"), F.col("source").eqNullSafe(F.col("source2")))
        .drop("source2")
        .withColumn("mean", F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)))
        .coalesce(1)
    )
    named = goal.select(F.col("source").alias("source2"), "sid")
    classes = cut(rows.groupBy("source", "size").agg(F.count("*").alias("docs")).join(named, F.col("source").eqNullSafe(F.col("source2"))).select("sid", "size", "docs"))
    lam = solve(classes, goal.select("sid", "source_size", "target", "mean"))
    # cells: the documents of a class in portions, so that none is large
    counts = classes.withColumn("cells", F.ceil(F.col("docs") / CELL).cast("long"))
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("source2"))).drop("source2", "source")
    placed = (
        placed.join(counts.select(F.col("sid").alias("s2"), F.col("size").alias("z2"), "cells"), (F.col("sid") == F.col("s2")) & (F.col("size") == F.col("z2")))
        .withColumn("cell", F.pmod(F.col("h"), F.col("cells")))
        # a cell has one value to be dealt out by: a partitioning by source and size would do for Catalyst too, and hold a whole class
        .select("_row", "h", "sid", "size", "cell", F.concat_ws("-", "sid", "size", "cell").alias("place"))
    )
    cells = placed.groupBy("place").agg(F.first("sid").alias("sid"), F.first("size").alias("size"), F.first("cell").alias("cell"), F.count("*").alias("docs")).drop("place")
    lam2 = lam.select(F.col("sid").alias("s3"), "lam", "mean")
    rated = cut(cells.join(lam2, F.col("sid") == F.col("s3")).withColumn("rate", rate(F.col("size") / F.col("mean"), F.col("lam"))).drop("s3", "lam", "mean"))
    dealt = _round(rated)
    fixed = _make_up(dealt, goal.select("sid", "target"))
    # within a cell the first documents by hash get the copies that do not go round
    spot = F.row_number().over(W.partitionBy("place").orderBy("h"))
    of_cell = fixed.select(F.col("sid").alias("s4"), F.col("size").alias("z4"), F.col("cell").alias("c4"), "docs", "rate", "copies")
    copies = (F.floor(F.col("copies") / F.col("docs")) + F.when(F.col("spot") <= F.col("copies") % F.col("docs"), 1).otherwise(0)).cast("long")
    out = placed.withColumn("spot", spot).join(of_cell, (F.col("sid") == F.col("s4")) & (F.col("size") == F.col("z4")) & (F.col("cell") == F.col("c4")))
    out = out.select("_row", "sid", "size", "rate", copies.alias("copies"))
    about = goal.select(F.col("sid").alias("s5"), "source_size", "target")
    return out.join(about, F.col("sid") == F.col("s5")).select("_row.*", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _running(cells: DataFrame, value: Column, falling: bool) -> DataFrame:
    """cells with ``upto``: the sum of value over the source's cells in order of size, own included; blocks of sizes first."""
    block = F.floor(F.log2(F.col("size") + 1) * 4)
    df = cells.withColumn("_v", value.cast("decimal(38,9)")).withColumn("_b", -block if falling else block)
    size = F.col("size").desc() if falling else F.col("size").asc()
    inner = F.sum("_v").over(W.partitionBy("sid", "_b").orderBy(size, "cell").rowsBetween(W.unboundedPreceding, 0))
    sums = df.groupBy("sid", "_b").agg(F.sum("_v").alias("_t"))
    base = sums.select(
        F.col("sid").alias("_s"), F.col("_b").alias("_c"),
        F.coalesce(F.sum("_t").over(W.partitionBy("sid").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    return df.withColumn("_in", inner).join(base, (F.col("sid") == F.col("_s")) & (F.col("_b") == F.col("_c"))).withColumn("upto", F.col("_in") + F.col("_base")).drop("_s", "_c", "_base", "_in", "_t")


def _round(rated: DataFrame) -> DataFrame:
    """rated cells with copies: whole numbers whose running sum follows that of docs * rate; empty documents get none."""
    amount = F.when(F.col("size") > 0, F.col("docs") * F.col("rate")).otherwise(0.0)
    summed = _running(rated, amount, falling=True)
    got = F.round(F.col("upto")) - F.round(F.col("upto") - F.col("_v"))
    copies = F.least(got, F.col("docs") * MOST).cast("long")
    return cut(summed.select("sid", "size", "cell", "docs", "rate", copies.alias("copies")))


def _make_up(dealt: DataFrame, goal: DataFrame) -> DataFrame:
    """Move each source's sum to its target, from its smallest documents on, as far as whole copies go."""
    off = dealt.groupBy("sid").agg(F.sum(F.col("size") * F.col("copies")).alias("got")).join(goal.select(F.col("sid").alias("_g"), "target"), F.col("sid") == F.col("_g"))
    off = off.select(F.col("sid").alias("_o"), F.round(F.col("target") - F.col("got")).cast("long").alias("off"))
    df = dealt.join(off, F.col("sid") == F.col("_o")).drop("_o")
    room = F.when(F.col("off") > 0, F.col("docs") * MOST - F.col("copies")).otherwise(F.col("copies"))
    df = df.withColumn("room", F.when(F.col("size") > 0, room).otherwise(F.lit(0)))
    summed = _running(df, F.col("room") * F.col("size"), falling=False)
    left = F.greatest(F.abs(F.col("off")) - (F.col("upto") - F.col("_v")).cast("long"), F.lit(0))
    n = F.least(F.col("room"), F.when(F.col("size") > 0, F.floor(left / F.col("size"))).otherwise(F.lit(0))).cast("long")
    return cut(summed.withColumn("copies", (F.col("copies") + F.signum("off").cast("long") * n)).select("sid", "size", "cell", "docs", "rate", "copies"))
