"""Command line: gen, stats, pack, checkpoint, query, rollup, correct, bench, version."""

from __future__ import annotations

import argparse
import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import BucketRules, MatchPolicy
from .operators import checkpoint, correction, pages, pnl, stats
from .operators.matching import fragments
from .plans import bench, query
from .sources import generate as gen
from .sources import store, tradebook


def day(text: str) -> int:
    try:
        return (datetime.date.fromisoformat(text) - datetime.date(1970, 1, 1)).days
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is no date like 2020-01-31") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lotwise")
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("gen", help="write a synthetic tradebook")
    a.add_argument("--out", required=True)
    for name, kind in (("seed", int), ("clients", int), ("days", int), ("symbols", int), ("whales", int)):
        a.add_argument(f"--{name}", type=kind, default=getattr(gen.GenConfig, name))
    a.add_argument("--mean-per-day", type=float, default=gen.GenConfig.mean_per_day)
    a = sub.add_parser("stats", help="skew of a tradebook")
    a.add_argument("--tradebook", required=True)
    a = sub.add_parser("pack", help="cluster a tradebook")
    a.add_argument("--tradebook", required=True)
    a.add_argument("--packed", required=True)
    a.add_argument("--page", type=int, default=pages.PAGE)
    for verb in ("checkpoint", "query", "rollup", "correct", "bench", "version"):
        a = sub.add_parser(verb)
        a.add_argument("--packed")
        a.add_argument("--uri", help="a versioned table")
        a.add_argument("--version", type=int)
        if verb in ("checkpoint", "query", "rollup", "correct"):
            a.add_argument("--policy", default="fifo")
        if verb == "checkpoint":
            a.add_argument("--out", required=True)
            a.add_argument("--count", type=int, default=4)
        if verb in ("query", "rollup"):
            a.add_argument("--ltcg-days", type=int, default=365)
            a.add_argument("--bands", help="like 30,365; goes before --ltcg-days")
            a.add_argument("--no-intraday", action="store_true")
        if verb == "query":
            a.add_argument("--client", type=int)
            a.add_argument("--symbol", type=int)
            a.add_argument("--from", dest="lo", type=day)
            a.add_argument("--to", dest="hi", type=day)
            a.add_argument("--checkpoints")
        if verb == "rollup":
            a.add_argument("--out", required=True)
        if verb == "correct":
            a.add_argument("--delta", required=True, help="Parquet with the columns of trades, and op")
            a.add_argument("--checkpoints")
    return p


def rules_of(a: argparse.Namespace) -> BucketRules:
    return BucketRules.bands(a.bands, not a.no_intraday) if a.bands else BucketRules((a.ltcg_days,), not a.no_intraday)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | dict | list | None:
    """Runs a verb, prints what it finds, and returns it."""
    p = parser()
    a = p.parse_args(argv)
    if a.verb == "query" and (a.lo is None) != (a.hi is None):
        p.error("give --from and --to, or neither")
    spark = spark or SparkSession.builder.appName("lotwise").getOrCreate()
    if a.verb == "gen":
        cfg = gen.GenConfig(seed=a.seed, clients=a.clients, days=a.days, symbols=a.symbols, whales=a.whales, mean_per_day=a.mean_per_day)
        store.write_tradebook(gen.generate(spark, cfg), a.out)
        gen.symbol_universe(spark, cfg).write.mode("overwrite").parquet(f"{a.out}-symbols")
        found = gen.manifest(cfg, spark.read.parquet(a.out))
        store.write_manifest(spark, f"{a.out}-symbols", found)
        print(json.dumps(found, indent=2))
        return found
    if a.verb == "stats":
        book = tradebook.read_tradebook(spark, a.tradebook)
        n_days = book.select(F.to_date("ts")).distinct().count()
        for df in (stats.summary(book, max(1, n_days)), stats.percentiles(book), stats.top_share(book), stats.log2_histogram(book)):
            df.show(truncate=False)
        return {"rows": tradebook.row_count(spark, a.tradebook)}
    if a.verb == "pack":
        store.write_packed(tradebook.to_trades(tradebook.read_tradebook(spark, a.tradebook)), a.packed)
        packed = store.read_packed(spark, a.packed)
        pages.page_summary(packed, a.page).write.mode("overwrite").parquet(f"{a.packed}-pages")
        return packed
    trades = store.open_source(spark, a.packed, a.uri, a.version) if a.verb != "version" else store.read_packed(spark, a.packed)
    if a.verb == "checkpoint":
        days = sorted(r[0] for r in trades.select("day").distinct().collect())  # a row a day
        checkpoint.write(checkpoint.build(trades, sorted(set(checkpoint.cutoffs_of(days, a.count))), MatchPolicy.of(a.policy)), a.out)
        out = checkpoint.listing(checkpoint.read(spark, a.out), MatchPolicy.of(a.policy))
    elif a.verb == "query":
        q = query.Query(a.client, a.symbol, a.lo, a.hi, rules_of(a), MatchPolicy.of(a.policy))
        found = query.run(trades, q, checkpoint.read(spark, a.checkpoints) if a.checkpoints else None)
        out = found.withColumn("label", q.rules.labels(F.col("bucket"))).orderBy("bucket")
    elif a.verb == "rollup":
        table = pnl.rollup(fragments(trades, MatchPolicy.of(a.policy)), rules_of(a))
        table.write.mode("overwrite").parquet(a.out)
        out = spark.read.parquet(a.out).orderBy("period", "bucket")
    elif a.verb == "correct":
        delta = spark.read.parquet(a.delta)
        out = correction.difference(trades, delta, policy=MatchPolicy.of(a.policy))
        if a.checkpoints:
            lots = checkpoint.read(spark, a.checkpoints)
            correction.stale(checkpoint.listing(lots, MatchPolicy.of(a.policy)), delta).show()
            checkpoint.write(correction.rebuild(trades, lots, delta, MatchPolicy.of(a.policy)), a.checkpoints)
    elif a.verb == "bench":
        found = bench.bench(trades)
        print(json.dumps(found, indent=2))
        return found
    else:
        version = store.write_version(trades, a.uri)
        print(f"version {version}")
        return {"version": version}
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
