"""The seven-query matrix: each query with and without checkpoints, compared and timed."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checkpoint, stats
from ..operators.pnl import compare
from .query import Query, metrics, run
from .router import Coefficients


def matrix(trades: DataFrame, days: list[int]) -> dict[str, Query]:
    """The middle day, the 22 days from there, a tenth to seven tenths of the days."""
    pick = {r["role"]: r["client_id"] for r in stats.whale_and_retail(trades).collect()}  # two rows
    n = len(days)
    mid, month, lo, hi = days[n // 2], days[min(n - 1, n // 2 + 22)], days[n // 10], days[n * 7 // 10]
    whale, retail = pick["whale"], pick.get("retail", pick["whale"])
    return {
        "whale_day": Query(client=whale, lo=mid, hi=mid), "whale_month": Query(client=whale, lo=mid, hi=month), "whale_random": Query(client=whale, lo=lo, hi=hi),
        "retail_all": Query(client=retail), "whale_all": Query(client=whale), "all_month": Query(lo=mid, hi=month), "all": Query(),
    }


def bench(trades: DataFrame, n_checkpoints: int = 3) -> list[dict]:
    """A row for each query: seconds with and without checkpoints, whether the results agree, metrics, and the predicted route."""
    days = sorted(r[0] for r in trades.select("day").distinct().collect())  # a row a day
    lots = checkpoint.build(trades, [days[len(days) * k // (n_checkpoints + 1)] for k in range(1, n_checkpoints + 1)])
    out = []
    for name, q in matrix(trades, days).items():
        t0 = time.perf_counter()
        plain = run(trades, q).collect()  # a row a bucket
        t1 = time.perf_counter()
        fast = run(trades, q, lots)
        fast.collect()
        t2 = time.perf_counter()
        spark = trades.sparkSession
        before = spark.createDataFrame(plain, fast.schema) if plain else fast.limit(0)
        equal = compare(before, fast).where(F.col("verdict") != "equal").count() == 0
        m = metrics(trades, q, lots if q.lo is not None else None).first().asDict()
        route = Coefficients().route(m["rows_touched"], m["partition_fanout"], m["max_partition_rows"], m["checkpoints_loaded"])
        out.append({"query": name, "span": q.span, "plain_s": t1 - t0, "checkpoint_s": t2 - t1, "equal": equal, "route": route, **m})
    return out
