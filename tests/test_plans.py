from __future__ import annotations

import datetime
import math

import pytest
from helpers import frame
from pyspark.sql import functions as F

from lotwise.__main__ import main
from lotwise.functions import calendar, ticks
from lotwise.functions.rules import MatchPolicy
from lotwise.operators import checkpoint, correction, matching, pages, pnl, stats
from lotwise.plans import bench, query, router
from lotwise.schema import KEY
from lotwise.sources import generate as gen
from lotwise.sources import store, tradebook
from lotwise.streaming import lots as streaming

PACKED = {(1, 10): [(100, 2000, 1), (-100, 2100, 2)], (1, 20): [(50, 500, 1)], (2, 10): [(10, 100, 5), (10, 110, 400), (-20, 120, 800)]}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_range_via_checkpoint(spark):
    t = frame(spark, {(1, 1): [(100, 1000, 10), (100, 1500, 20), (-150, 3000, 200), (50, 2000, 300), (-50, 2500, 400)]})
    lots = checkpoint.build(t, [100])
    q = query.Query(lo=150, hi=250)
    assert rows(query.run(t, q, lots)) == rows(query.run(t, q)) == [(1, 2, 150, 100 * 2000 + 50 * 1500)]


@pytest.mark.parametrize("policy", list(MatchPolicy))
def test_checkpoints_by_policy(spark, policy, tmp_path):
    t = frame(spark, {(1, 1): [(100, 1000, 10), (40, 1500, 20), (-60, 3000, 30), (-10, 3100, 50)]})
    path = str(tmp_path / "lots")
    checkpoint.write(checkpoint.build(t, [25, 35], policy), path)
    lots = checkpoint.read(spark, path)
    assert rows(lots.where("cutoff_day = 25").select("seq", "signed_qty")) == [(1, 100), (2, 40)]
    left = {"fifo": [(1, 40), (2, 40)], "lifo": [(1, 80)], "hifo": [(1, 80)]}[policy.value]
    assert rows(lots.where("cutoff_day = 35").select("seq", "signed_qty")) == left
    assert checkpoint.nearest(lots, 35) == 25 and checkpoint.nearest(lots, 36) == 35 and checkpoint.nearest(lots, 25) is None
    assert checkpoint.written_cutoffs(spark, path, policy) == [25, 35]
    q = query.Query(lo=40, hi=60, policy=policy)
    assert rows(query.run(t, q, lots)) == rows(query.run(t, q))


def test_rewriting_clears_stale_checkpoints(spark, tmp_path):
    """Built at two days, then after a correction at an earlier one: the old ones would give wrong ranges."""
    rows_ = [(30, 700, 12), (80, 900, 18), (-50, 1100, 22), (-20, 1300, 45)]
    path = str(tmp_path / "lots")
    checkpoint.write(checkpoint.build(frame(spark, {(4, 2): rows_}), [16, 40]), path)
    checkpoint.write(checkpoint.build(frame(spark, {(4, 2): rows_}), [16], MatchPolicy.LIFO), path)
    fixed = frame(spark, {(4, 2): [(90, 300, 12), *rows_[1:]]})
    checkpoint.write(checkpoint.build(fixed, [20]), path)
    assert checkpoint.written_cutoffs(spark, path) == [20] and checkpoint.written_cutoffs(spark, path, MatchPolicy.LIFO) == [16]
    lots = checkpoint.read(spark, path)
    q = query.Query(lo=41, hi=60)
    assert rows(query.run(fixed, q, lots)) == rows(query.run(fixed, q)) == [(1, 1, 20, 20 * (1300 - 300))]
    n = lots.where("policy = 'fifo'").count()
    checkpoint.write(lots.where("policy = 'fifo'"), path)  # onto itself
    assert checkpoint.written_cutoffs(spark, path) == [20] and checkpoint.read(spark, path).where("policy = 'fifo'").count() == n
    checkpoint.clear(spark, path, MatchPolicy.FIFO)
    assert checkpoint.written_cutoffs(spark, path) == []


def test_query_selects_and_measures(spark):
    t = frame(spark, {(7, 1): [(100, 1000, 1), (-100, 1200, 1)], (7, 2): [(50, 500, 2), (-50, 700, 50)], (8, 1): [(1, 1, 1)]})
    assert rows(query.run(t, query.Query(client=7))) == [(0, 1, 100, 20000), (1, 1, 50, 10000)]
    assert rows(query.metrics(t, query.Query(client=7))) == [(4, 2, 2, 0)]
    assert rows(query.metrics(t, query.Query(client=9))) == [(0, 0, 0, 0)]
    with pytest.raises(ValueError):
        query.Query(lo=3)
    plan = query.run(t, query.Query(client=7))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("client_id#") > plan.rindex("Window")  # the predicate stands below the windows


def test_rollup(spark):
    j, f = ((datetime.date(2024, m, 10) - datetime.date(1970, 1, 1)).days for m in (1, 2))
    frags = matching.fragments(frame(spark, {(1, 1): [(100, 1000, j), (-100, 1200, j), (50, 1000, j), (-50, 1500, f)]}))
    table = pnl.rollup(frags)
    jan = 2024 * 12
    assert rows(table) == [(jan, 0, 1, 100, 20000), (jan + 1, 1, 1, 50, 25000)]
    assert rows(pnl.rollup_range(table, jan + 1, jan + 5)) == [(1, 1, 50, 25000)]
    assert rows(pnl.merge_rollup(table, table)) == [(jan, 0, 2, 200, 40000), (jan + 1, 1, 2, 100, 50000)]
    assert table.select(calendar.period_label(F.col("period"))).orderBy("period").first()[0] == "2024-01"


def test_packed_and_versions(spark, tmp_path):
    t = frame(spark, PACKED)
    path, uri = str(tmp_path / "packed"), str(tmp_path / "versions")
    store.write_packed(t, path)
    back = store.read_packed(spark, path)
    assert rows(back) == rows(t)
    assert rows(back.where("client_id = 9 and symbol_id = 9")) == []
    assert back.where("client_id = 2 and day between 400 and 800").count() == 2
    assert "EqualTo(client_id,1)" in back.where("client_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert store.write_version(t, uri) == 1 and store.write_version(t.where("client_id = 1"), uri) == 2
    assert store.read_version(spark, uri).count() == 3 and store.read_version(spark, uri, 1).count() == 6
    with pytest.raises(ValueError):
        store.read_version(spark, uri, 3)
    assert rows(store.partition_starts(back)) == rows(pages.partition_offsets(t).drop("rows"))
    assert store.open_source(spark, packed=path).count() == 6
    with pytest.raises(FileNotFoundError):
        store.read_manifest(spark, path)
    store.write_manifest(spark, path, {"a": 1})
    assert store.read_manifest(spark, path) == {"a": 1}


def test_exchanges(spark):
    """Windows share one exchange by key, and need none on a bucketed table."""

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(client_id")

    t = frame(spark, PACKED)
    assert exchanges(matching.fragments(t)) == 1
    store.write_bucketed(t, "packed_trades", 4)
    back = spark.table("packed_trades")
    assert exchanges(matching.fragments(back)) == 0 and exchanges(pnl.pnl(matching.fragments(back), by=KEY)) == 0
    assert rows(matching.fragments(back)) == rows(matching.fragments(t))
    spark.sql("DROP TABLE packed_trades")


def test_pages(spark):
    t = frame(spark, {(1, 1): [(1, 1, 1), (1, 1, 2)], (9, 1): [(1, 1, 900), (1, 1, 901)]})
    summary = pages.page_summary(t, 2)
    assert rows(summary) == [(0, 0, 2, 1, 1, 1, 2), (1, 2, 4, 9, 9, 900, 901)]
    assert [r.page for r in pages.page_prune(summary, (1, 1), (0, 10)).collect()] == [0]
    assert [r.page for r in pages.page_prune(summary, (0, 100), (800, 1000)).collect()] == [1]


def test_correction(spark):
    t = frame(spark, PACKED)
    delta = spark.createDataFrame([(1, 10, 2, -60, 2100, 2, "update"), (2, 10, 3, -20, 120, 800, "delete"), (2, 10, 4, -5, 120, 900, "insert")], "client_id long, symbol_id long, seq long, signed_qty long, price_ticks long, day int, op string")
    fixed = correction.apply_delta(t, delta)
    after = rows(pnl.pnl(matching.fragments(fixed), by=KEY))
    assert rows(correction.recompute(t, delta)) == after
    verdicts = {(r.client_id, r.bucket): r.verdict for r in correction.difference(t, delta).collect()}
    assert verdicts == {(1, 1): "differs", (2, 2): "differs"}
    cutoffs = spark.createDataFrame([(1,), (2,), (900,)], "cutoff_day int")
    assert rows(correction.stale(cutoffs, delta)) == [(2,), (900,)]
    lots = checkpoint.build(t, [1, 3, 850])
    again = correction.rebuild(t, lots, delta)
    assert rows(again.select("cutoff_day", *KEY, "seq", "signed_qty")) == rows(checkpoint.build(fixed, [1, 3, 850]).select("cutoff_day", *KEY, "seq", "signed_qty"))


def test_stats(spark):
    t = frame(spark, {(c, 1): [(1, 1, 1)] * n for c, n in ((0, 1), (1, 2), (2, 3), (3, 8))})
    assert rows(stats.percentiles(t, (0.5, 0.9))) == [(0.5, 3), (0.9, 8)]
    assert rows(stats.top_share(t, (0.1, 0.5))) == [(0.1, 1, 8 / 14), (0.5, 2, 11 / 14)]
    assert rows(stats.log2_histogram(t)) == [(1, 2, 1), (2, 4, 2), (4, 8, 0), (8, 16, 1)]
    assert rows(stats.whale_and_retail(t)) == [("retail", 0), ("whale", 3)]
    assert stats.summary(t, 7).first()["per_day"] == 2.0


def test_router(spark):
    c = router.Coefficients()
    assert c.route(50, 1, 50, 1) == "cpu" and c.route(50_000_000, 4, 15_000_000, 0) == "gpu"
    log = spark.createDataFrame([(n, 4 * n, None, None) for n in range(1, 11)], "rows long, cpu_ns long, gpu_h2d_ns long, gpu_kernel_ns long")
    assert tuple(router.fit(log).first()) == (4.0, 0.2, 1.6)


def test_calendar_and_ticks(spark):
    days = calendar.trading_days(spark, "2020-01-01", 5).orderBy("idx").collect()
    assert [str(r.date) for r in days] == ["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07"]
    one = spark.range(1)
    assert one.select(calendar.weekday(F.to_date(F.lit("1970-01-01")))).first()[0] == 4
    for p in (10, 10.02, 10.04, 99.99, 0.001):
        v = one.select(ticks.on_grid(F.lit(float(p)))).first()[0]
        assert v >= 0.05 and abs(v / 0.05 - round(v / 0.05)) < 1e-9
    assert one.select(ticks.day_of(F.lit("1969-12-31 23:00:00").cast("timestamp_ntz"))).first()[0] == -1


def test_generator(spark, tmp_path):
    cfg = gen.GenConfig(clients=60, days=40, mean_per_day=1.0, whales=3)
    book = gen.generate(spark, cfg).cache()
    again = gen.generate(spark, cfg, clients=[0])
    assert rows(again) == rows(book.where("client_id = 0"))
    counts = {r.client_id: r.n for r in stats.client_counts(book).collect()}
    assert abs(sum(counts.values()) - cfg.target) <= 0.05 * cfg.target
    assert sum(n for c, n in counts.items() if cfg.is_whale(c)) > sum(counts.values()) / 2
    from lotwise.operators.matching import _effective

    assert _effective(tradebook.to_trades(book)).where("signed_qty < 0 and eff <> -signed_qty").count() == 0  # never short
    import numpy as np

    for total, n in ((100, 5), (3, 4), (1, 1), (1000000, 50), (7, 3)):
        parts = gen.split_count(total, np.arange(1, n + 1, dtype=float))
        assert parts.sum() == total and (total < n or parts.min() >= 1)


def test_symbols_depend_on_their_number_alone(spark):
    def mixed(x):
        z, m = (x + 0x9E3779B97F4A7C15) % 2**64, 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % m
        z = (z ^ z >> 27) * 0x94D049BB133111EB % m
        return ((z ^ z >> 31) >> 11) / 2**53

    for r in gen.symbol_universe(spark, gen.GenConfig(symbols=50)).collect():
        assert r.base_price == pytest.approx(math.exp(3 + 6 * mixed(r.symbol_id ^ 0x505800)))
        assert r.daily_vol == pytest.approx(0.005 + 0.045 * mixed(r.symbol_id * 0x9E3779B9 ^ 0x505800))


def test_command_line(spark, tmp_path):
    book, packed, lots = (str(tmp_path / x) for x in ("book", "packed", "lots"))
    main(["gen", "--out", book, "--clients", "20", "--days", "30", "--whales", "2", "--mean-per-day", "1"], spark)
    assert main(["stats", "--tradebook", book], spark)["rows"] == tradebook.read_tradebook(spark, book).count()
    assert main(["pack", "--tradebook", book, "--packed", packed], spark).count() > 0
    assert main(["checkpoint", "--packed", packed, "--out", lots], spark).count() == 4
    full = rows(main(["query", "--packed", packed, "--bands", "5,20"], spark))
    assert {r[-1] for r in full} <= {"intraday", "1-5d", "6-20d", ">20d"}
    span = ["--from", "2020-01-20", "--to", "2020-02-10"]
    assert rows(main(["query", "--packed", packed, *span, "--checkpoints", lots], spark)) == rows(main(["query", "--packed", packed, *span], spark))
    assert main(["rollup", "--packed", packed, "--out", str(tmp_path / "rollup")], spark).count() > 0
    assert main(["version", "--packed", packed, "--uri", str(tmp_path / "v")], spark) == {"version": 1}
    assert main(["query", "--uri", str(tmp_path / "v"), "--bands", "5,20"], spark).count() == len(full)
    with pytest.raises(SystemExit):
        main(["query", "--packed", packed, "--from", "2020-01-20"], spark)
    assert all(r["equal"] for r in bench.bench(store.read_packed(spark, packed)))


@pytest.mark.parametrize("policy", list(MatchPolicy))
def test_stream_equals_batch(spark, policy, tmp_path):
    t = frame(spark, PACKED)
    folder = str(tmp_path / "in")
    for d in ((0, 3), (4, 500), (501, 900)):
        t.where(F.col("day").between(*d)).coalesce(1).write.mode("append").parquet(folder)
    stream = streaming.stream_fragments(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(folder), policy)
    q = stream.writeStream.format("memory").queryName(f"frags_{policy.value}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table(f"frags_{policy.value}")) == rows(matching.fragments(t, policy))


@pytest.mark.parametrize("policy", [MatchPolicy.FIFO, MatchPolicy.HIFO])
def test_stream_state_does_not_go_with_the_keys(spark, policy, tmp_path):
    """Many keys share a state; each has its own lots and its own last seq."""
    keys = 3000
    first = frame(spark, {(i, i % 3): [(10, 100 + i, 1), (5, 90, 2)] for i in range(keys)})
    late = spark.createDataFrame([(0, 0, 2, -9, 50, 3), (1, 1, 3, -12, 60, 3)], first.schema)  # key (0, 0) has seen seq 2
    folder = str(tmp_path / "in")
    out = []
    for i, t in enumerate((first, late)):
        t.coalesce(1).write.mode("append").parquet(folder)
        stream = streaming.stream_fragments(spark.readStream.schema(first.schema).parquet(folder), policy)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        out.append(max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress))
    assert max(out) <= 1024
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, 1, 1, 3, 1, 3, 10, 101, 60), (1, 1, 2, 3, 2, 3, 2, 90, 60)]


def test_stream_keeps_missing_keys_together(spark, tmp_path):
    days = [[(None, 5, 1, 10, 100, 1), (None, 6, 1, 3, 100, 1), (7, 5, 1, 4, 90, 1)], [(None, 5, 2, -6, 120, 2), (7, 5, 2, -9, 95, 2)], [(None, 5, 3, -6, 130, 3)]]
    t = spark.createDataFrame([r for d in days for r in d], "client_id long, symbol_id long, seq long, signed_qty long, price_ticks long, day int")
    folder = str(tmp_path / "in")
    for d in (1, 2, 3):
        t.where(F.col("day") == d).coalesce(1).write.mode("append").parquet(folder)
    stream = streaming.stream_fragments(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(folder), buckets=1)
    q = stream.writeStream.format("memory").queryName("missing_keys").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("missing_keys").collect()}
    assert got == {(None, 5, 1, 2, 1, 2, 6, 100, 120), (None, 5, 1, 3, 1, 3, 4, 100, 130), (7, 5, 1, 2, 1, 2, 4, 90, 95)}
    assert got == {tuple(r) for r in matching.fragments(t).collect()}
