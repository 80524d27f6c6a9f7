"""Matching over a stream of trades: open lots are the state.

Keys are dealt into a fixed number of buckets, and a bucket has one state for all its
keys: what Spark and pandas spend on a group is spent by bucket, not by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import BucketRules, MatchPolicy
from ..operators.matching import Lots
from ..operators.pnl import pnl
from ..schema import FRAGMENTS, KEY
from ..session import ship


#: Buckets of keys.  A batch reads and writes the states of the buckets it has trades of, so memory goes with the open lots of one.
BUCKETS = 1024
TRADE = [*KEY, "seq", "signed_qty", "price_ticks", "day"]


def _column(values: list | tuple) -> np.ndarray:
    """Integers, or doubles where some are missing."""
    return np.array(values) if len(values) else np.empty(0, np.int64)


def _values(name: str, column: np.ndarray) -> list:
    """Numbers; keys that are missing as None, so that they are one key."""
    if name in KEY and column.dtype.kind == "f":
        return [None if x != x else int(x) for x in column.tolist()]
    return column.tolist()


def _pack(rows: list[tuple]) -> bytes:
    """Rows of TRADE as compressed Arrow."""
    columns = [pa.array(_column(c), from_pandas=True).cast(pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(TRADE))]
    batch, sink = pa.RecordBatch.from_arrays(columns, names=TRADE), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(data).read_all()
    return list(zip(*[_values(c, table.column(c).to_numpy()) for c in TRADE], strict=True))


def stream_fragments(trades: DataFrame, policy: MatchPolicy = MatchPolicy.FIFO, buckets: int = BUCKETS) -> DataFrame:
    """Fragments of each micro-batch, appended; a key's trades must arrive in order of seq over the batches.

    A trade of a seq at or under the last one seen of its key comes too late to be matched and is dropped.  ``buckets`` must
    stay the same over the life of a stream's checkpoint.
    """
    ship(trades.sparkSession)
    names = [x.split()[0] for x in FRAGMENTS.split(", ")]

    def step(key: tuple[Any, ...], chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the state's rows: open lots in order of seq by key, and one of no quantity with the last seq seen of each key
        last: dict[tuple[int, int], int] = {}
        kept: dict[tuple[int, int], list[tuple]] = {}
        for c, s, *lot in _unpack(state.get[0]) if state.exists else ():
            if lot[1]:
                kept.setdefault((c, s), []).append(lot)
            else:
                last[c, s] = lot[0]
        pdf = pd.concat(list(chunks))
        order = np.lexsort([pdf[c].to_numpy() for c in ("seq", *KEY[::-1])])
        rows, now, book, seen = [], None, Lots(policy), None

        def close() -> None:
            if now is not None:
                last[now], kept[now] = seen, book.left()

        for c, s, seq, qty, price, day in zip(*[_values(n, pdf[n].to_numpy()[order]) for n in TRADE], strict=True):
            if (c, s) != now:
                close()
                now, book = (c, s), Lots(policy)
                seen = last.get(now)
                for lot in kept.get(now, ()):
                    book.buy(*lot)
            if seen is not None and seq <= seen:
                continue
            seen = seq
            if qty > 0:
                book.buy(seq, qty, price, day)
            elif qty < 0:
                rows += [(c, s, b_seq, seq, b_day, day, got, b_price, price) for b_seq, b_day, b_price, got in book.sell(-qty)]
        close()
        state.update((_pack([(*k, *lot) for k, lots in kept.items() for lot in lots] + [(*k, seq, 0, 0, 0) for k, seq in last.items()]),))
        yield pd.DataFrame({n: _column(x) for n, x in zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True)})

    dealt = trades.select(*TRADE, F.pmod(F.xxhash64(*KEY), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandasWithState(step, FRAGMENTS, "book binary", "append", GroupStateTimeout.NoTimeout)


def stream_pnl(fragments: DataFrame, rules: BucketRules | None = None) -> DataFrame:
    """Running sums by bucket, for output mode complete or update."""
    return pnl(fragments, rules)


def stream_volume(trades: DataFrame, time: str = "ts", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Bought and sold quantity by window and symbol of trades with an event time; rows later than ``late`` are dropped."""
    q = F.col("signed_qty")
    return (
        trades.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("w"), "symbol_id")
        .agg(F.sum(F.greatest(q, F.lit(0))).alias("bought"), F.sum(F.greatest(-q, F.lit(0))).alias("sold"))
        .select(F.col("w.start").alias("start"), "symbol_id", "bought", "sold")
    )
