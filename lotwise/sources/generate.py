"""A deterministic synthetic tradebook: a pure function of (seed, client), spread over the cluster by client."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import SESSION_MINUTES, SESSION_OPEN_MINUTES, trading_days
from ..functions.hashing import SYMBOL_SALT, SYMBOL_STEP, splitmix64, unit
from ..functions.ticks import TICK
from ..session import ship


@dataclass(frozen=True)
class GenConfig:
    """The published defaults."""

    seed: int = 42
    clients: int = 5000
    days: int = 250
    start: str = "2020-01-01"
    symbols: int = 1000
    mean_per_day: float = 6.0
    whales: int = 8
    body_mu: float = 1.1
    body_sigma: float = 1.3
    pareto: float = 1.5
    qty_mu: float = 4.6
    qty_sigma: float = 1.0
    p_intraday: float = 0.35

    @property
    def target(self) -> int:
        return round(self.clients * self.days * self.mean_per_day)

    @property
    def stride(self) -> int:
        return max(1, self.clients // max(1, self.whales))

    def is_whale(self, client: int) -> bool:
        return client % self.stride == 0 and client // self.stride < self.whales

    def as_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def _rng(cfg: GenConfig, *parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence([cfg.seed, *parts])))


#: Fixed value: popularity falls with rank by this power.
ZIPF = 1.07


def symbol_prices(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base price, exp(3) to exp(9), and daily volatility, 0.005 to 0.05: functions of the symbol alone."""
    ids = ids.astype(np.uint64)
    price = unit(splitmix64(ids ^ np.uint64(SYMBOL_SALT)))
    vol = unit(splitmix64(ids * np.uint64(SYMBOL_STEP) ^ np.uint64(SYMBOL_SALT)))
    return np.exp(3 + 6 * price), 0.005 + 0.045 * vol


def symbol_universe(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """symbol_id, base_price, daily_vol."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            price, vol = symbol_prices(pdf["id"].to_numpy())
            yield pd.DataFrame({"symbol_id": pdf["id"], "base_price": price, "daily_vol": vol})

    return spark.range(cfg.symbols).mapInPandas(run, "symbol_id long, base_price double, daily_vol double")


def pick_symbols(r: np.random.Generator, n: int, k: int) -> list[int]:
    """k different symbols of n by popularity, ascending; after many draws the most popular fill up."""
    k = min(k, n)
    upto = np.cumsum(np.arange(1, n + 1, dtype=float) ** -ZIPF)
    drawn = np.minimum(np.searchsorted(upto, r.random(8 * k + 16) * upto[-1]), n - 1)
    chosen = list(dict.fromkeys(drawn.tolist()))[:k]
    known = set(chosen)
    return sorted(chosen + [s for s in range(n) if s not in known][: k - len(chosen)])


def client_weights(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """client_id, body (trades of an ordinary client, else 0) and weight (of a whale, else 0)."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c in pdf["id"]:
                r = _rng(cfg, 2, int(c))
                rows.append((int(c), 0, float(r.pareto(cfg.pareto) + 1)) if cfg.is_whale(int(c)) else (int(c), max(1, round(r.lognormal(cfg.body_mu, cfg.body_sigma))), 0.0))
            yield pd.DataFrame(rows, columns=["client_id", "body", "weight"])

    return spark.range(cfg.clients).mapInPandas(run, "client_id long, body long, weight double")


def plan(spark: SparkSession, cfg: GenConfig) -> DataFrame:
    """client_id and trades: ordinary clients as drawn, whales fill the rest of the target by weight."""
    w = client_weights(spark, cfg)
    total = w.agg(F.sum("body").alias("b"), F.sum("weight").alias("w"))  # one row
    budget = F.lit(cfg.target) - F.least(F.col("b"), F.lit(cfg.target))
    share = F.greatest(F.lit(1), F.round(budget * F.col("weight") / F.col("w"))).cast("long")
    return w.crossJoin(total).select("client_id", F.when(F.col("weight") > 0, share).otherwise(F.col("body")).alias("trades"))


def split_count(total: int, weights: np.ndarray) -> np.ndarray:
    """Whole numbers of the sum ``total`` by weight, each 1 or more where the total reaches."""
    n = len(weights)
    if total <= n:
        return np.array([1] * total + [0] * (n - total))
    raw = weights / weights.sum() * (total - n)
    out = np.floor(raw).astype(int)
    out[np.argsort(out - raw, kind="stable")[: total - n - out.sum()]] += 1
    return out + 1


def client_trades(cfg: GenConfig, client: int, count: int, day_list: np.ndarray) -> pd.DataFrame:
    """All trades of one client, in order of symbol and time."""
    r = _rng(cfg, 3, client)
    k = int(np.clip(round(count**0.4), 1, min(50, cfg.symbols)))
    symbols = pick_symbols(r, cfg.symbols, k)
    prices, vols = symbol_prices(np.array(symbols))
    rows = []
    for s, n, base, vol in zip(symbols, split_count(count, r.exponential(size=len(symbols))), prices, vols, strict=True):
        at, held, drift = int(r.integers(0, max(1, len(day_list) // 4))), 0, 0.0
        ts_day = -1
        micros = 0
        for _ in range(int(n)):
            day = int(day_list[min(at, len(day_list) - 1)])
            micros = (micros if day == ts_day else 0) + int(r.integers(1, 60_000_000))
            micros, ts_day = min(micros, SESSION_MINUTES * 60_000_000 - 1), day
            drift = float(np.clip(drift + vol * r.standard_normal() * 0.3, -2, 2))
            price = max(round(base * math.exp(drift) / TICK) * TICK, TICK)
            qty = max(1, round(r.lognormal(cfg.qty_mu, cfg.qty_sigma)))
            sell = held > 0 and r.random() < min(0.92, 0.35 + held / 4000)
            qty = min(qty, held) if sell else qty
            held += -qty if sell else qty
            rows.append((client, s, -1 if sell else 1, qty, price, day * 86_400_000_000 + SESSION_OPEN_MINUTES * 60_000_000 + micros, int(r.integers(0, 5)), qty * price * 0.0003 + 0.35))
            if r.random() >= cfg.p_intraday:
                at += int(r.integers(60, 500)) if r.random() < 0.03 else min(30, 1 + int(r.geometric(0.35)))
    df = pd.DataFrame(rows, columns=["client_id", "symbol_id", "side", "quantity", "price", "ts", "venue", "fees"])
    df.insert(0, "trade_id", client * 1_000_000_000 + np.arange(len(df)))
    return df


def generate(spark: SparkSession, cfg: GenConfig, clients: list[int] | None = None) -> DataFrame:
    """The tradebook of all clients, or of those given."""
    ship(spark)
    days = np.array([r["day"] for r in trading_days(spark, cfg.start, cfg.days).orderBy("idx").collect()])  # a row a trading day

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, n in zip(pdf["client_id"], pdf["trades"], strict=True):
                out = client_trades(cfg, int(c), int(n), days)
                yield out.assign(ts=out["ts"].astype("datetime64[us]"), side=out["side"].astype("int8"), venue=out["venue"].astype("int16"), fees=out["fees"].astype("float32"))

    asked = plan(spark, cfg)
    if clients is not None:
        asked = asked.where(F.col("client_id").isin(clients))
    schema = "trade_id long, client_id long, symbol_id long, side tinyint, quantity long, price double, ts timestamp_ntz, venue smallint, fees float"
    return asked.repartition("client_id").mapInPandas(run, schema)


def manifest(cfg: GenConfig, book: DataFrame) -> dict:
    row = book.agg(F.count("*").alias("n"), F.countDistinct("client_id").alias("c")).first()
    return {"config": asdict(cfg), "total_trades": row["n"], "clients": row["c"]}
