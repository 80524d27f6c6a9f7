"""Fragments: each the part of a sell that takes part of an open lot.

A sell takes open lots of its (client, symbol) in the policy's order; what no
lot is open for is dropped and never becomes a short position.  All else in the
package is a filter or an aggregate of the fragments.

FIFO is done with windows.  The inventory after each trade is the running sum of
signed quantities less its running minimum under zero ("reflected"), so what a
sell really takes is the fall of the inventory at it.  Buys and sells then lie on
one axis of shares, each ending where its running sum stands; between two
neighbouring ends one buy meets one sell.  One exchange by key, no join.

``chunk`` does the same for keys too large for a task: running sums and minima
go over chunks of the key first (a small relation of totals), then within chunks,
and so do the nearest buy and sell on the axis of shares.

LIFO and HIFO walk each key's trades in order.  Trades are dealt out by key and
sorted, and Python walks the sorted stream of Arrow batches, so memory holds open
lots only, however long a key's history.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import MatchPolicy
from ..schema import FRAGMENTS, KEY
from ..session import ship

UP_TO = (W.unboundedPreceding, 0)


def _effective(trades: DataFrame) -> DataFrame:
    """trades with inv (inventory after each) and eff (what a sell takes, else 0)."""
    w = W.partitionBy(*KEY).orderBy("seq")
    df = trades.withColumn("_s", F.sum("signed_qty").over(w.rowsBetween(*UP_TO)))
    df = df.withColumn("inv", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w.rowsBetween(*UP_TO))))
    before = F.coalesce(F.lag("inv").over(w), F.lit(0))
    return df.withColumn("eff", F.when(F.col("signed_qty") < 0, before - F.col("inv")).otherwise(F.lit(0))).drop("_s")


def _ends(df: DataFrame) -> DataFrame:
    """One row for each buy and each sell that takes something: pos (its end on the axis of shares), buy and sell (structs, one null)."""
    lot = F.struct("seq", "price_ticks", "day")
    is_buy = F.col("signed_qty") > 0
    pos = F.when(is_buy, F.col("_cb")).otherwise(F.col("_cs"))
    return df.where(is_buy | (F.col("eff") > 0)).select(*KEY, pos.alias("pos"), F.when(is_buy, lot).alias("buy"), F.when(~is_buy, lot).alias("sell"))


def _fragments(df: DataFrame) -> DataFrame:
    """From rows with qty, buy and sell."""
    return df.where((F.col("qty") > 0) & F.col("buy").isNotNull() & F.col("sell").isNotNull()).select(
        *KEY,
        F.col("buy.seq").alias("buy_seq"), F.col("sell.seq").alias("sell_seq"), F.col("buy.day").alias("buy_day"), F.col("sell.day").alias("sell_day"),
        "qty", F.col("buy.price_ticks").alias("buy_ticks"), F.col("sell.price_ticks").alias("sell_ticks"),
    )


def _fifo(trades: DataFrame) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy("seq").rowsBetween(*UP_TO)
    df = _effective(trades)
    df = df.withColumn("_cb", F.sum(F.greatest("signed_qty", F.lit(0))).over(w)).withColumn("_cs", F.sum("eff").over(w))
    down = W.partitionBy(*KEY).orderBy(F.col("pos").desc())
    near = down.rowsBetween(*UP_TO)
    out = _ends(df).select(
        *KEY,
        (F.col("pos") - F.coalesce(F.lead("pos").over(down), F.lit(0))).alias("qty"),
        F.last("buy", ignorenulls=True).over(near).alias("buy"),
        F.last("sell", ignorenulls=True).over(near).alias("sell"),
    )
    return _fragments(out)


def _with_totals(df: DataFrame, part: str, totals: DataFrame) -> DataFrame:
    return df.join(totals, [*KEY, part])


def _fifo_chunked(trades: DataFrame, chunk: int) -> DataFrame:
    """``chunk``: sequence numbers to a chunk, and shares times as many to a stretch of the axis."""
    df = trades.withColumn("_c", F.floor(F.col("seq") / chunk))
    inner = W.partitionBy(*KEY, "_c").orderBy("seq")
    outer = W.partitionBy(*KEY).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # running sum and minimum
    df = df.withColumn("_in", F.sum("signed_qty").over(inner.rowsBetween(*UP_TO)))
    totals = df.groupBy(*KEY, "_c").agg(F.sum("signed_qty").alias("_t"), F.min("_in").alias("_m"))
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(outer), zero)).withColumn("_low", F.coalesce(F.min(F.col("_base") + F.col("_m")).over(outer), zero))
    df = _with_totals(df, "_c", totals.select(*KEY, "_c", "_base", "_low"))
    at = F.col("_base") + F.col("_in")
    floor_now = F.least(zero, "_low", F.col("_base") + F.min("_in").over(inner.rowsBetween(*UP_TO)))
    floor_before = F.least(zero, F.col("_low"), F.coalesce(F.col("_base") + F.min("_in").over(inner.rowsBetween(W.unboundedPreceding, -1)), zero))
    df = df.withColumn("_now", at - floor_now).withColumn("_was", at - F.col("signed_qty") - floor_before)
    df = df.withColumn("eff", F.when(F.col("signed_qty") < 0, F.col("_was") - F.col("_now")).otherwise(zero))
    # running buys and effective sells
    df = df.withColumn("_b", F.sum(F.greatest("signed_qty", zero)).over(inner.rowsBetween(*UP_TO))).withColumn("_e", F.sum("eff").over(inner.rowsBetween(*UP_TO)))
    sums = df.groupBy(*KEY, "_c").agg(F.max("_b").alias("_tb"), F.max("_e").alias("_te"))
    sums = sums.select(*KEY, "_c", F.coalesce(F.sum("_tb").over(outer), zero).alias("_pb"), F.coalesce(F.sum("_te").over(outer), zero).alias("_pe"))
    df = _with_totals(df, "_c", sums).withColumn("_cb", F.col("_pb") + F.col("_b")).withColumn("_cs", F.col("_pe") + F.col("_e"))
    # on the axis: stretches, each with the nearest buy and sell above it and the last end below it
    ends = _ends(df).withColumn("_x", F.floor((F.col("pos") - 1) / (chunk * 16)))
    down = W.partitionBy(*KEY, "_x").orderBy(F.col("pos").desc())
    near = down.rowsBetween(*UP_TO)
    above = W.partitionBy(*KEY).orderBy(F.col("_x").desc()).rowsBetween(W.unboundedPreceding, -1)
    edge = ends.groupBy(*KEY, "_x").agg(
        F.max("pos").alias("_top"),
        F.min_by("buy", F.when(F.col("buy").isNotNull(), F.struct("pos", -F.col("buy.seq")))).alias("_lb"),
        F.min_by("sell", F.when(F.col("sell").isNotNull(), F.struct("pos", -F.col("sell.seq")))).alias("_ls"),
    )
    edge = edge.select(
        *KEY, "_x",
        F.coalesce(F.lead("_top").over(W.partitionBy(*KEY).orderBy(F.col("_x").desc())), zero).alias("_under"),
        F.last("_lb", ignorenulls=True).over(above).alias("_hb"), F.last("_ls", ignorenulls=True).over(above).alias("_hs"),
    )
    out = _with_totals(ends, "_x", edge).select(
        *KEY,
        (F.col("pos") - F.coalesce(F.lead("pos").over(down), F.col("_under"))).alias("qty"),
        F.coalesce(F.last("buy", ignorenulls=True).over(near), "_hb").alias("buy"),
        F.coalesce(F.last("sell", ignorenulls=True).over(near), "_hs").alias("sell"),
    )
    return _fragments(out)


class Lots:
    """A key's open lots under a policy."""

    def __init__(self, policy: MatchPolicy):
        self.policy = policy
        self.open: deque | list = deque() if policy is MatchPolicy.FIFO else []

    def buy(self, seq: int, qty: int, price: int, day: int) -> None:
        lot = [-price, seq, qty, day] if self.policy is MatchPolicy.HIFO else [price, seq, qty, day]
        if self.policy is MatchPolicy.HIFO:
            heapq.heappush(self.open, lot)
        else:
            self.open.append(lot)

    def sell(self, qty: int) -> Iterator[tuple[int, int, int, int]]:
        """(seq, day, price, quantity) of what is taken; the rest is dropped."""
        while qty and self.open:
            lot = self.open[-1] if self.policy is MatchPolicy.LIFO else self.open[0]
            got = min(qty, lot[2])
            yield lot[1], lot[3], -lot[0] if self.policy is MatchPolicy.HIFO else lot[0], got
            qty -= got
            lot[2] -= got
            if not lot[2]:
                if self.policy is MatchPolicy.HIFO:
                    heapq.heappop(self.open)
                elif self.policy is MatchPolicy.LIFO:
                    self.open.pop()
                else:
                    self.open.popleft()

    def left(self) -> list[tuple[int, int, int, int]]:
        """(seq, quantity, price, day) in order of time."""
        sign = -1 if self.policy is MatchPolicy.HIFO else 1
        return sorted((seq, qty, sign * price, day) for price, seq, qty, day in self.open)


LOTS = "client_id long, symbol_id long, seq long, signed_qty long, price_ticks long, day int"


def _walk(trades: DataFrame, policy: MatchPolicy, lots: bool) -> DataFrame:
    """Fragments, or the lots left open, by walking each key's trades in order."""
    ship(trades.sparkSession)
    schema = LOTS if lots else FRAGMENTS
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, book = None, Lots(policy)
        rows: list[tuple[int, ...]] = []

        def close() -> None:
            if lots and key is not None:
                rows.extend((*key, *lot) for lot in book.left())

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            rows.clear()
            return made

        for batch in batches:
            for c, s, seq, qty, price, day in zip(*[batch.column(i).to_numpy().tolist() for i in range(6)], strict=True):
                if (c, s) != key:
                    close()
                    key, book = (c, s), Lots(policy)
                if qty > 0:
                    book.buy(seq, qty, price, day)
                elif qty < 0:
                    for b_seq, b_day, b_price, got in book.sell(-qty):
                        if not lots:
                            rows.append((c, s, b_seq, seq, b_day, day, got, b_price, price))
            if len(rows) > 1 << 16:
                yield out()
        close()
        yield out()

    ordered = trades.select(*KEY, "seq", "signed_qty", "price_ticks", "day").repartition(*KEY).sortWithinPartitions(*KEY, "seq")
    return ordered.mapInArrow(run, schema)


def fragments(trades: DataFrame, policy: MatchPolicy = MatchPolicy.FIFO, carry: DataFrame | None = None, chunk: int | None = None) -> DataFrame:
    """client_id, symbol_id, buy_seq, sell_seq, buy_day, sell_day, qty, buy_ticks, sell_ticks.

    carry: lots open before the trades (columns of trades, signed_qty what is left), their seq under the trades' own.
    chunk: FIFO only; see above.
    """
    cols = [*KEY, "seq", "signed_qty", "price_ticks", "day"]
    every = trades.select(*cols)
    if carry is not None:
        every = every.unionByName(carry.select(*cols))
    if policy is not MatchPolicy.FIFO:
        return _walk(every, policy, lots=False)
    return _fifo_chunked(every, chunk) if chunk else _fifo(every)


def open_lots(trades: DataFrame, policy: MatchPolicy = MatchPolicy.FIFO, carry: DataFrame | None = None) -> DataFrame:
    """The lots left open after all trades: columns of trades, signed_qty what is left."""
    cols = [*KEY, "seq", "signed_qty", "price_ticks", "day"]
    every = trades.select(*cols)
    if carry is not None:
        every = every.unionByName(carry.select(*cols))
    if policy is not MatchPolicy.FIFO:
        return _walk(every, policy, lots=True)
    whole = W.partitionBy(*KEY)
    df = _effective(every).withColumn("_cb", F.sum(F.greatest("signed_qty", F.lit(0))).over(W.partitionBy(*KEY).orderBy("seq").rowsBetween(*UP_TO)))
    df = df.withColumn("_sold", F.sum("eff").over(whole))
    left = F.least(F.col("signed_qty"), F.greatest(F.lit(0), F.col("_cb") - F.col("_sold")))
    return df.where("signed_qty > 0").withColumn("left", left).where("left > 0").select(*KEY, "seq", F.col("left").alias("signed_qty"), "price_ticks", "day")


def specific_lot_fragments(trades: DataFrame, picks: DataFrame) -> DataFrame:
    """Fragments for sells whose lots the caller names: picks has the key, sell_seq, buy_seq and qty.

    Lots are those of buys; a pick counts up to what earlier picks (in order of sell_seq) have left of its lot and of its sell.
    """
    lot = W.partitionBy(*KEY, "buy_seq").orderBy("sell_seq").rowsBetween(W.unboundedPreceding, -1)
    sale = W.partitionBy(*KEY, "sell_seq").orderBy("buy_seq").rowsBetween(W.unboundedPreceding, -1)
    buys = trades.where("signed_qty > 0").select(*KEY, F.col("seq").alias("buy_seq"), F.col("signed_qty").alias("_bq"), F.col("price_ticks").alias("buy_ticks"), F.col("day").alias("buy_day"))
    sells = trades.where("signed_qty < 0").select(*KEY, F.col("seq").alias("sell_seq"), (-F.col("signed_qty")).alias("_sq"), F.col("price_ticks").alias("sell_ticks"), F.col("day").alias("sell_day"))
    df = picks.select(*KEY, "sell_seq", "buy_seq", "qty").join(buys, [*KEY, "buy_seq"]).join(sells, [*KEY, "sell_seq"]).where("buy_seq < sell_seq")
    df = df.withColumn("_of_sale", F.greatest(F.lit(0), F.least("qty", F.col("_sq") - F.coalesce(F.sum("qty").over(sale), F.lit(0)))))
    got = F.greatest(F.lit(0), F.least("_of_sale", F.col("_bq") - F.coalesce(F.sum("_of_sale").over(lot), F.lit(0))))
    return df.withColumn("qty", got).where("qty > 0").select(*[x.split()[0] for x in FRAGMENTS.split(", ")])


def average_cost(trades: DataFrame) -> DataFrame:
    """Each sell's quantity matched and gain over the average cost of what is held: key, sell_seq, sell_day, qty, cost_ticks, realized_ticks (double).

    The average starts anew when nothing is held, so a key's trades are walked in order.
    """
    ship(trades.sparkSession)
    schema = "client_id long, symbol_id long, sell_seq long, sell_day int, qty long, cost_ticks double, realized_ticks double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cost = None, 0, 0.0
        for batch in batches:
            rows = []
            for c, s, seq, qty, price, day in zip(*[batch.column(i).to_numpy().tolist() for i in range(6)], strict=True):
                if (c, s) != key:
                    key, held, cost = (c, s), 0, 0.0
                if qty > 0:
                    cost = (cost * held + price * qty) / (held + qty)
                    held += qty
                elif qty < 0 and held:
                    got = min(-qty, held)
                    rows.append((c, s, seq, day, got, cost, got * (price - cost)))
                    held -= got
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    ordered = trades.select(*KEY, "seq", "signed_qty", "price_ticks", "day").repartition(*KEY).sortWithinPartitions(*KEY, "seq")
    return ordered.mapInArrow(run, schema)
