"""Queries on the star-schema test tables, one for each operator, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calendar import is_weekend, period_label, session_start, trading_days, weekday
from .functions.rules import BucketRules, MatchPolicy
from .functions.ticks import on_grid, relative_error, speedup, ticks_to_value
from .operators import accumulators, checkpoint, correction, matching, pages, pnl, stats
from .plans import query, router
from .schema import FRAGMENTS, KEY
from .session import scratch
from .sources import generate as gen
from .sources import tradebook
from .streaming import lots

LI, EV = tradebook.lineitem_trades, tradebook.event_trades
FIFO, LIFO, HIFO = MatchPolicy.FIFO, MatchPolicy.LIFO, MatchPolicy.HIFO
BANDS = BucketRules.bands([30, 365])
#: Days of the range queries, a cutoff before them, and a day that is corrected.
DAY, MONTH, RANGE, CUTOFFS, LATE = (9500, 9500), (9500, 9529), (9200, 10000), (9250, 9400, 9800), 9300
CLIENT, SYMBOL = 3, 7
PAGE = 4096

# --- SQL shared by the oracles -------------------------------------------------

SQL_LI = """SELECT l_suppkey AS client_id, l_partkey % 20 AS symbol_id,
  row_number() OVER (PARTITION BY l_suppkey, l_partkey % 20 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS seq,
  (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * CAST(l_quantity AS BIGINT) AS signed_qty,
  CAST(round(l_extendedprice / l_quantity / 0.05) AS BIGINT) AS price_ticks,
  CAST(datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day FROM lineitem"""
SQL_WHALE = SQL_LI.replace("l_suppkey AS client_id, l_partkey % 20 AS symbol_id", "CAST(0 AS BIGINT) AS client_id, CAST(0 AS BIGINT) AS symbol_id").replace("PARTITION BY l_suppkey, l_partkey % 20 ", "")
SQL_EV = """SELECT user_id AS client_id, CAST(0 AS BIGINT) AS symbol_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  (CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END) * CAST(greatest(1, floor(value)) AS BIGINT) AS signed_qty,
  CAST(round((20 + value) / 0.05) AS BIGINT) AS price_ticks,
  CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events"""
KEYS = "PARTITION BY client_id, symbol_id"
SUMS = "count(*) AS fragments, CAST(sum(qty) AS BIGINT) AS matched_qty, CAST(sum(qty * (sell_ticks - buy_ticks)) AS BIGINT) AS realized_ticks"


def sql_inventory(trades: str = SQL_LI) -> str:
    """t, and e: with inv and eff."""
    return f"""t AS MATERIALIZED ({trades}),
r AS (SELECT *, sum(signed_qty) OVER ({KEYS} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM t),
n AS (SELECT *, run - least(0, min(run) OVER ({KEYS} ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS inv FROM r),
e AS (SELECT *, CASE WHEN signed_qty < 0 THEN coalesce(lag(inv) OVER ({KEYS} ORDER BY seq), 0) - inv ELSE 0 END AS eff FROM n)"""


def sql_fifo(trades: str = SQL_LI) -> str:
    """Common table expressions that end in f: the FIFO fragments, by an interval join."""
    return f"""WITH {sql_inventory(trades)},
c AS MATERIALIZED (SELECT *, sum(greatest(signed_qty, 0)) OVER ({KEYS} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cb, sum(eff) OVER ({KEYS} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cs FROM e),
f AS (SELECT b.client_id, b.symbol_id, b.seq AS buy_seq, s.seq AS sell_seq, b.day AS buy_day, s.day AS sell_day,
  CAST(least(b.cb, s.cs) - greatest(b.cb - b.signed_qty, s.cs - s.eff) AS BIGINT) AS qty, b.price_ticks AS buy_ticks, s.price_ticks AS sell_ticks
  FROM c b JOIN c s ON b.client_id = s.client_id AND b.symbol_id = s.symbol_id AND b.signed_qty > 0 AND s.eff > 0 AND b.cb > s.cs - s.eff AND b.cb - b.signed_qty < s.cs)"""


def sql_priority(order: str, trades: str = SQL_LI) -> str:
    """The same by thresholds of priority, for any order of lots that does not change."""
    return f"""WITH t AS MATERIALIZED ({trades}),
b AS (SELECT *, row_number() OVER ({KEYS} ORDER BY {order}) AS pr FROM t WHERE signed_qty > 0),
x AS (SELECT b.client_id, b.symbol_id, b.pr, t.seq, t.signed_qty, t.price_ticks, t.day,
  CASE WHEN t.signed_qty < 0 THEN t.signed_qty WHEN b2.pr <= b.pr THEN t.signed_qty ELSE 0 END AS v
  FROM b JOIN t USING (client_id, symbol_id) LEFT JOIN b b2 ON b2.client_id = t.client_id AND b2.symbol_id = t.symbol_id AND b2.seq = t.seq),
s AS (SELECT *, sum(v) OVER ({KEYS}, pr ORDER BY seq) AS cum FROM x),
i AS (SELECT *, cum - least(0, min(cum) OVER ({KEYS}, pr ORDER BY seq)) AS inv FROM s),
d AS (SELECT *, coalesce(lag(inv) OVER ({KEYS}, pr ORDER BY seq), 0) - inv AS eff FROM i),
m AS (SELECT *, eff - coalesce(lag(eff) OVER ({KEYS}, seq ORDER BY pr), 0) AS q FROM d WHERE signed_qty < 0),
f AS (SELECT m.client_id, m.symbol_id, b.seq AS buy_seq, m.seq AS sell_seq, b.day AS buy_day, m.day AS sell_day, CAST(m.q AS BIGINT) AS qty,
  b.price_ticks AS buy_ticks, m.price_ticks AS sell_ticks FROM m JOIN b USING (client_id, symbol_id, pr) WHERE m.q > 0)"""


SQL_ORDER = {LIFO: "seq DESC", HIFO: "price_ticks DESC, seq"}


def sql_pnl(source: str, rules: BucketRules = BucketRules(), by: str = "", where: str = "") -> str:
    return f"{source} SELECT {by}{rules.sql('(sell_day - buy_day)')} AS bucket, {SUMS} FROM f {where} GROUP BY ALL"


def sql_lots(policy: MatchPolicy, cutoff: int, trades: str = SQL_LI) -> str:
    """Lots left open at a cutoff: buys less what fragments took."""
    cut = f"SELECT * FROM ({trades}) WHERE day <= {cutoff}"
    source = sql_fifo(cut) if policy is FIFO else sql_priority(SQL_ORDER[policy], cut)
    return f"""{source}, g AS (SELECT client_id, symbol_id, buy_seq, sum(qty) AS took FROM f GROUP BY ALL)
SELECT t.client_id, t.symbol_id, t.seq, CAST(t.signed_qty - coalesce(g.took, 0) AS BIGINT) AS signed_qty, t.price_ticks, t.day
FROM t LEFT JOIN g ON g.client_id = t.client_id AND g.symbol_id = t.symbol_id AND g.buy_seq = t.seq
WHERE t.signed_qty > 0 AND t.signed_qty - coalesce(g.took, 0) > 0"""


# --- queries -------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def lots_table(s: SparkSession, d: str, policy: MatchPolicy = FIFO) -> DataFrame:
    """Written and read again."""
    path = scratch(s, "checkpoints")
    checkpoint.write(checkpoint.build(LI(s, d), list(CUTOFFS), policy), path)
    return checkpoint.read(s, path)


def rewritten(s: SparkSession, d: str) -> DataFrame:
    """Checkpoints at all cutoffs, replaced by those at the second: the listing of what is left."""
    path = scratch(s, "rewritten")
    for cutoffs in (list(CUTOFFS), [CUTOFFS[1]]):
        checkpoint.write(checkpoint.build(LI(s, d), cutoffs), path)
    return checkpoint.listing(checkpoint.read(s, path))


# trades and their places
register("trades_packed", LI, SQL_LI)
register("trades_events", EV, SQL_EV)
register(
    "trade_values",
    lambda s, d: LI(s, d).select(*KEY, "seq", (F.col("signed_qty") > 0).alias("is_buy"), F.abs("signed_qty").alias("abs_qty"), ticks_to_value(F.col("price_ticks")).alias("price"), on_grid(ticks_to_value(F.col("price_ticks")) + 0.01).alias("grid_price")),
    f"SELECT client_id, symbol_id, seq, signed_qty > 0 AS is_buy, abs(signed_qty) AS abs_qty, price_ticks * CAST(0.05 AS DOUBLE) AS price, round(greatest(price_ticks * CAST(0.05 AS DOUBLE) + CAST(0.01 AS DOUBLE), CAST(0.05 AS DOUBLE)) / CAST(0.05 AS DOUBLE)) * CAST(0.05 AS DOUBLE) AS grid_price FROM ({SQL_LI})",
)
register("partition_counts", lambda s, d: pages.partition_counts(LI(s, d)), f"SELECT client_id, symbol_id, count(*) AS rows FROM ({SQL_LI}) GROUP BY ALL")
register(
    "partition_offsets",
    lambda s, d: pages.partition_offsets(LI(s, d)),
    f"WITH c AS (SELECT client_id, symbol_id, count(*) AS rows FROM ({SQL_LI}) GROUP BY ALL) SELECT *, CAST(coalesce(sum(rows) OVER (ORDER BY client_id, symbol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c",
)
SQL_ROWS = f"SELECT *, row_number() OVER (ORDER BY client_id, symbol_id, seq) - 1 AS rn FROM ({SQL_LI})"
SQL_PAGES = f"SELECT CAST(rn // {PAGE} AS BIGINT) AS page, min(rn) AS row_start, max(rn) + 1 AS row_end, min(client_id) AS min_client, max(client_id) AS max_client, min(day) AS min_day, max(day) AS max_day FROM ({SQL_ROWS}) GROUP BY ALL"
register("page_summary", lambda s, d: pages.page_summary(LI(s, d), PAGE), SQL_PAGES)
register("page_prune", lambda s, d: pages.page_prune(pages.page_summary(LI(s, d), PAGE), (20, 60), MONTH), f"SELECT * FROM ({SQL_PAGES}) WHERE max_client >= 20 AND min_client <= 60 AND max_day >= {MONTH[0]} AND min_day <= {MONTH[1]}")
register("partition_starts", lambda s, d: pages.key_changes(pages.with_row_number(LI(s, d))), f"SELECT client_id, symbol_id, min(rn) AS start FROM ({SQL_ROWS}) GROUP BY ALL")
register(
    "partition_day_range",
    lambda s, d: query.select(LI(s, d), query.Query(client=CLIENT)).where(F.col("day").between(*RANGE)),
    f"SELECT * FROM ({SQL_LI}) WHERE client_id = {CLIENT} AND day BETWEEN {RANGE[0]} AND {RANGE[1]}",
)

# FIFO
register("fifo_fragments", lambda s, d: matching.fragments(LI(s, d)), f"{sql_fifo()} SELECT * FROM f")
register("fifo_pnl_all", lambda s, d: query.run(LI(s, d), query.Query()), sql_pnl(sql_fifo()))
register("fifo_pnl_events", lambda s, d: query.run(EV(s, d), query.Query()), sql_pnl(sql_fifo(SQL_EV)))
register("fifo_pnl_wide", lambda s, d: pnl.pnl(matching.fragments(LI(s, d)), wide=True).withColumn("realized_ticks", F.col("realized_ticks").cast("long")), sql_pnl(sql_fifo()))
register("fifo_pnl_by_client", lambda s, d: pnl.pnl(matching.fragments(LI(s, d)), by=("client_id",)), sql_pnl(sql_fifo(), by="client_id, "))
register("fifo_pnl_by_partition", lambda s, d: pnl.pnl(matching.fragments(LI(s, d)), by=KEY), sql_pnl(sql_fifo(), by="client_id, symbol_id, "))
register("fifo_pnl_client", lambda s, d: query.run(LI(s, d), query.Query(client=CLIENT)), sql_pnl(sql_fifo(), where=f"WHERE client_id = {CLIENT}"))
register("fifo_pnl_symbol", lambda s, d: query.run(LI(s, d), query.Query(symbol=SYMBOL)), sql_pnl(sql_fifo(), where=f"WHERE symbol_id = {SYMBOL}"))
register("fifo_pnl_client_symbol", lambda s, d: query.run(LI(s, d), query.Query(client=CLIENT, symbol=SYMBOL)), sql_pnl(sql_fifo(), where=f"WHERE client_id = {CLIENT} AND symbol_id = {SYMBOL}"))
register(
    "fifo_pnl_total",
    lambda s, d: pnl.pnl_total(matching.fragments(LI(s, d))),
    f"""{sql_fifo()}, p AS (SELECT {BucketRules().sql('(sell_day - buy_day)')} AS bucket, {SUMS} FROM f GROUP BY ALL),
a AS (SELECT * FROM p UNION ALL SELECT NULL, CAST(sum(fragments) AS BIGINT), CAST(sum(matched_qty) AS BIGINT), CAST(sum(realized_ticks) AS BIGINT) FROM p),
l AS (SELECT CAST(0 AS INTEGER) AS bucket, 'intraday' AS label UNION ALL SELECT 1, '1-365d' UNION ALL SELECT 2, '>365d' UNION ALL SELECT NULL, 'TOTAL')
SELECT l.bucket, l.label, coalesce(a.fragments, 0) AS fragments, coalesce(a.matched_qty, 0) AS matched_qty, coalesce(a.realized_ticks, 0) AS realized_ticks,
  coalesce(a.realized_ticks, 0) * CAST(0.05 AS DOUBLE) AS value FROM l LEFT JOIN a ON l.bucket IS NOT DISTINCT FROM a.bucket""",
)
register("fifo_pnl_bands_30_365", lambda s, d: query.run(LI(s, d), query.Query(rules=BANDS)), sql_pnl(sql_fifo(), BANDS))
NO_INTRADAY, LTCG_100 = BucketRules((365,), False), BucketRules.equity(100)
register("fifo_pnl_no_intraday", lambda s, d: query.run(LI(s, d), query.Query(rules=NO_INTRADAY)), sql_pnl(sql_fifo(), NO_INTRADAY))
register("fifo_pnl_ltcg_100", lambda s, d: query.run(LI(s, d), query.Query(rules=LTCG_100)), sql_pnl(sql_fifo(), LTCG_100))
register(
    "bucket_labels",
    lambda s, d: s.range(BANDS.count).select(F.col("id").cast("int").alias("bucket"), BANDS.labels(F.col("id")).alias("label")),
    "SELECT * FROM (VALUES (0, 'intraday'), (1, '1-30d'), (2, '31-365d'), (3, '>365d')) v(bucket, label)",
)
for _name, _days in (("day", DAY), ("month", MONTH), ("random", RANGE)):
    register(f"fifo_pnl_range_{_name}", lambda s, d, r=_days: query.run(LI(s, d), query.Query(lo=r[0], hi=r[1])), sql_pnl(sql_fifo(), where=f"WHERE sell_day BETWEEN {_days[0]} AND {_days[1]}"))
register("range_via_checkpoint", lambda s, d: query.run(LI(s, d), query.Query(lo=MONTH[0], hi=MONTH[1]), lots_table(s, d)), sql_pnl(sql_fifo(), where=f"WHERE sell_day BETWEEN {MONTH[0]} AND {MONTH[1]}"))
register("whale_pnl", lambda s, d: pnl.pnl(matching.fragments(tradebook.whale_trades(s, d), chunk=4096)), sql_pnl(sql_fifo(SQL_WHALE)))
register("chunked_fragments", lambda s, d: matching.fragments(LI(s, d), chunk=8), f"{sql_fifo()} SELECT * FROM f")

# other policies
for _policy in (LIFO, HIFO):
    _sql = sql_priority(SQL_ORDER[_policy])
    register(f"{_policy.value}_fragments", lambda s, d, p=_policy: matching.fragments(LI(s, d), p), f"{_sql} SELECT * FROM f")
    register(f"{_policy.value}_pnl", lambda s, d, p=_policy: query.run(LI(s, d), query.Query(policy=p)), sql_pnl(_sql))
    register(
        f"{_policy.value}_range_via_checkpoint",
        lambda s, d, p=_policy: query.run(LI(s, d), query.Query(lo=MONTH[0], hi=MONTH[1], policy=p), lots_table(s, d, p)),
        sql_pnl(_sql, where=f"WHERE sell_day BETWEEN {MONTH[0]} AND {MONTH[1]}"),
    )
PICKS = f"""SELECT s.client_id, s.symbol_id, s.seq AS sell_seq, b.seq AS buy_seq, -s.signed_qty AS qty FROM ({SQL_LI}) s JOIN ({SQL_LI}) b
  ON b.client_id = s.client_id AND b.symbol_id = s.symbol_id AND b.seq = s.seq - 1 AND b.signed_qty > 0 AND s.signed_qty < 0"""


def picks(s: SparkSession, d: str) -> DataFrame:
    """Each sell names the buy just before it."""
    t = LI(s, d)
    b = t.where("signed_qty > 0").select(*KEY, F.col("seq").alias("buy_seq"), (F.col("seq") + 1).alias("sell_seq"))
    return t.where("signed_qty < 0").select(*KEY, F.col("seq").alias("sell_seq"), (-F.col("signed_qty")).alias("qty")).join(b, [*KEY, "sell_seq"])


register(
    "specific_lot_fragments",
    lambda s, d: matching.specific_lot_fragments(LI(s, d), picks(s, d)),
    f"""WITH t AS MATERIALIZED ({SQL_LI}), p AS ({PICKS}) SELECT p.client_id, p.symbol_id, p.buy_seq, p.sell_seq, b.day AS buy_day, s.day AS sell_day,
  CAST(least(p.qty, b.signed_qty) AS BIGINT) AS qty, b.price_ticks AS buy_ticks, s.price_ticks AS sell_ticks
FROM p JOIN t b ON b.client_id = p.client_id AND b.symbol_id = p.symbol_id AND b.seq = p.buy_seq JOIN t s ON s.client_id = p.client_id AND s.symbol_id = p.symbol_id AND s.seq = p.sell_seq""",
)
register(
    "avg_cost_pnl",
    lambda s, d: matching.average_cost(LI(s, d)),
    f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER ({KEYS} ORDER BY seq) AS rn FROM ({SQL_LI})), w AS (
  SELECT DISTINCT client_id, symbol_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS held, CAST(0 AS DOUBLE) AS cost, CAST(0 AS BIGINT) AS seq, CAST(0 AS INTEGER) AS day, CAST(0 AS BIGINT) AS price, CAST(0 AS BIGINT) AS qty FROM t
  UNION ALL
  SELECT t.client_id, t.symbol_id, t.rn, CAST(CASE WHEN signed_qty > 0 THEN held + signed_qty ELSE held - least(-signed_qty, held) END AS BIGINT),
    CASE WHEN signed_qty > 0 THEN (cost * held + CAST(price_ticks * signed_qty AS DOUBLE)) / (held + signed_qty) ELSE cost END,
    CAST(t.seq AS BIGINT), CAST(t.day AS INTEGER), CAST(price_ticks AS BIGINT), CAST(CASE WHEN signed_qty < 0 THEN least(-signed_qty, held) ELSE 0 END AS BIGINT)
  FROM w JOIN t ON t.client_id = w.client_id AND t.symbol_id = w.symbol_id AND t.rn = w.rn + 1
)
SELECT client_id, symbol_id, seq AS sell_seq, day AS sell_day, qty, cost AS cost_ticks, qty * (price - cost) AS realized_ticks FROM w WHERE qty > 0""",
)

# lots and checkpoints
for _policy in MatchPolicy:
    register(f"open_lots_{_policy.value}", lambda s, d, p=_policy: checkpoint.lots_at(LI(s, d), MONTH[0], p), sql_lots(_policy, MONTH[0]))
register(
    "checkpoints",
    lambda s, d: lots_table(s, d).groupBy("policy", "cutoff_day").agg(F.count("*").alias("lots"), F.sum("signed_qty").alias("open_qty")),
    " UNION ALL ".join(f"SELECT 'fifo' AS policy, CAST({c} AS INTEGER) AS cutoff_day, count(*) AS lots, CAST(sum(signed_qty) AS BIGINT) AS open_qty FROM ({sql_lots(FIFO, c)})" for c in CUTOFFS),
)
SQL_CUTOFFS = "(VALUES " + ", ".join(f"({c})" for c in CUTOFFS) + ") v(cutoff_day)"


def cutoffs(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(c,) for c in CUTOFFS], "cutoff_day int")


register("checkpoints_rewritten", rewritten, f"SELECT CAST({CUTOFFS[1]} AS INTEGER) AS cutoff_day")
register("nearest_checkpoint", lambda s, d: s.createDataFrame([(checkpoint.nearest(lots_table(s, d), MONTH[0]),)], "cutoff_day int"), f"SELECT max(cutoff_day) AS cutoff_day FROM {SQL_CUTOFFS} WHERE cutoff_day < {MONTH[0]}")
register("checkpoint_invalidated", lambda s, d: checkpoint.invalidated(cutoffs(s), LATE), f"SELECT cutoff_day FROM {SQL_CUTOFFS} WHERE cutoff_day >= {LATE}")

# rollups
SQL_PERIOD = "CAST(year(DATE '1970-01-01' + sell_day) * 12 + month(DATE '1970-01-01' + sell_day) - 1 AS INTEGER)"
register("rollup_month", lambda s, d: pnl.rollup(matching.fragments(LI(s, d))), sql_pnl(sql_fifo(), by=f"{SQL_PERIOD} AS period, "))
PERIODS = (1995 * 12, 1995 * 12 + 5)
register("rollup_range", lambda s, d: query.run_from_rollup(pnl.rollup(matching.fragments(LI(s, d))), *PERIODS), sql_pnl(sql_fifo(), where=f"WHERE {SQL_PERIOD} BETWEEN {PERIODS[0]} AND {PERIODS[1]}"))
register(
    "period_labels",
    lambda s, d: pnl.rollup(matching.fragments(LI(s, d))).select("period", period_label(F.col("period")).alias("label")).distinct(),
    f"{sql_fifo()} SELECT DISTINCT {SQL_PERIOD} AS period, strftime(DATE '1970-01-01' + sell_day, '%Y-%m') AS label FROM f",
)

# corrections: the trades of a day go, and those of the next day double
SQL_FIXED = f"SELECT client_id, symbol_id, seq, CASE WHEN day = {LATE + 1} THEN 2 * signed_qty ELSE signed_qty END AS signed_qty, price_ticks, day FROM ({SQL_LI}) WHERE day <> {LATE}"
SQL_TOUCHED = f"SELECT DISTINCT client_id, symbol_id FROM ({SQL_LI}) WHERE day IN ({LATE}, {LATE + 1})"


def delta(s: SparkSession, d: str) -> DataFrame:
    t = LI(s, d).where(F.col("day").isin(LATE, LATE + 1))
    gone = F.col("day") == LATE
    return t.withColumn("op", F.when(gone, "delete").otherwise("update")).withColumn("signed_qty", F.when(gone, F.col("signed_qty")).otherwise(2 * F.col("signed_qty")))


SQL_BY_KEY = "client_id, symbol_id, "
register("correction_recompute", lambda s, d: correction.recompute(LI(s, d), delta(s, d)), sql_pnl(sql_fifo(SQL_FIXED), by=SQL_BY_KEY, where=f"SEMI JOIN ({SQL_TOUCHED}) k USING (client_id, symbol_id)"))
_AFTER, _BEFORE = (sql_pnl(sql_fifo(x), by=SQL_BY_KEY, where=f"SEMI JOIN ({SQL_TOUCHED}) k USING (client_id, symbol_id)") for x in (SQL_FIXED, SQL_LI))
register(
    "correction_diff",
    lambda s, d: correction.difference(LI(s, d), delta(s, d)),
    f"""SELECT coalesce(a.client_id, b.client_id) AS client_id, coalesce(a.symbol_id, b.symbol_id) AS symbol_id, coalesce(a.bucket, b.bucket) AS bucket,
  a.fragments AS fragments_a, b.fragments AS fragments_b, a.matched_qty AS matched_qty_a, b.matched_qty AS matched_qty_b, a.realized_ticks AS realized_ticks_a, b.realized_ticks AS realized_ticks_b,
  CASE WHEN b.fragments IS NULL THEN 'left_only' WHEN a.fragments IS NULL THEN 'right_only'
    WHEN a.fragments = b.fragments AND a.matched_qty = b.matched_qty AND a.realized_ticks = b.realized_ticks THEN 'equal' ELSE 'differs' END AS verdict
FROM ({_BEFORE}) a FULL JOIN ({_AFTER}) b ON a.client_id = b.client_id AND a.symbol_id = b.symbol_id AND a.bucket = b.bucket""",
)
register("correction_stale", lambda s, d: correction.stale(cutoffs(s), delta(s, d)), f"SELECT cutoff_day FROM {SQL_CUTOFFS} WHERE cutoff_day >= (SELECT min(day) FROM ({SQL_LI}) WHERE day IN ({LATE}, {LATE + 1}))")
register(
    "engine_compare",
    lambda s, d: pnl.compare(query.run(LI(s, d), query.Query(lo=MONTH[0], hi=MONTH[1])), query.run(LI(s, d), query.Query(lo=MONTH[0], hi=MONTH[1]), lots_table(s, d))),
    f"SELECT bucket, fragments AS fragments_a, fragments AS fragments_b, matched_qty AS matched_qty_a, matched_qty AS matched_qty_b, realized_ticks AS realized_ticks_a, realized_ticks AS realized_ticks_b, 'equal' AS verdict FROM ({sql_pnl(sql_fifo(), where=f'WHERE sell_day BETWEEN {MONTH[0]} AND {MONTH[1]}')})",
)

# skew
SQL_N = f"n AS MATERIALIZED (SELECT client_id, count(*) AS n FROM ({SQL_LI}) GROUP BY ALL)"
register(
    "skew_summary",
    lambda s, d: stats.summary(LI(s, d), 2500, 10, 3),
    f"WITH {SQL_N} SELECT count(*) AS clients, CAST(sum(n) AS BIGINT) AS total, avg(n) AS mean, sum(n) / CAST(2500 AS DOUBLE) AS per_day, max(n) AS most, CAST(sum(CASE WHEN client_id % 10 = 0 AND client_id / 10 < 3 THEN n ELSE 0 END) / sum(n) AS DOUBLE) AS whale_share FROM n",
)
SQL_Q = ", ".join(f"(CAST({q} AS DOUBLE))" for q in stats.QUANTILES)
register(
    "skew_percentiles",
    lambda s, d: stats.percentiles(LI(s, d)),
    f"WITH {SQL_N}, o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS spot, count(*) OVER () AS m FROM n) SELECT q, n AS trades FROM (VALUES {SQL_Q}) v(q) JOIN o ON spot = CAST(round(q * (m - 1)) AS BIGINT)",
)
SQL_F = ", ".join(f"(CAST({f} AS DOUBLE))" for f in stats.FRACTIONS)
register(
    "skew_top_share",
    lambda s, d: stats.top_share(LI(s, d)),
    f"WITH {SQL_N}, o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS spot, count(*) OVER () AS m, sum(n) OVER () AS t FROM n), k AS (SELECT fraction, CAST(greatest(1, least(ceil(fraction * (SELECT max(m) FROM o)), (SELECT max(m) FROM o))) AS BIGINT) AS k FROM (VALUES {SQL_F}) v(fraction)) SELECT fraction, k, CAST(sum(n) AS DOUBLE) / CAST(max(t) AS DOUBLE) AS share FROM k JOIN o ON spot <= k GROUP BY ALL",
)
register(
    "skew_log2_hist",
    lambda s, d: stats.log2_histogram(LI(s, d)),
    f"WITH {SQL_N}, h AS (SELECT CAST(floor(log2(n)) AS BIGINT) AS i, count(*) AS clients FROM n GROUP BY ALL) SELECT CAST(1 AS BIGINT) << j AS lo, CAST(1 AS BIGINT) << (j + 1) AS hi, coalesce(clients, 0) AS clients FROM range((SELECT max(i) + 1 FROM h)) r(j) LEFT JOIN h ON i = j",
)
register(
    "whale_retail_pick",
    lambda s, d: stats.whale_and_retail(LI(s, d)),
    f"WITH {SQL_N}, w AS (SELECT client_id FROM n ORDER BY n DESC, client_id LIMIT 1) SELECT 'whale' AS role, client_id FROM w UNION ALL SELECT 'retail', coalesce((SELECT min(client_id) FROM n WHERE n >= 4 AND client_id NOT IN (SELECT client_id FROM w)), (SELECT min(client_id) FROM n))",
)

# calendar
register(
    "calendar_trading_days",
    lambda s, d: trading_days(s, "2020-01-01", 250).select("idx", "date", "day"),
    "SELECT CAST(row_number() OVER (ORDER BY dt) - 1 AS INTEGER) AS idx, CAST(dt AS DATE) AS date, CAST(datediff('day', DATE '1970-01-01', CAST(dt AS DATE)) AS INTEGER) AS day FROM range(TIMESTAMP '2020-01-01', TIMESTAMP '2021-06-01', INTERVAL 1 DAY) r(dt) WHERE dayofweek(dt) NOT IN (0, 6) QUALIFY idx < 250",
)
register("weekday", lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy(weekday(F.to_date("o_orderdate")).alias("weekday")).agg(F.count("*").alias("orders")), "SELECT CAST(dayofweek(CAST(o_orderdate AS DATE)) AS INTEGER) AS weekday, count(*) AS orders FROM orders GROUP BY ALL")

# metrics and the router
SQL_METRICS = f"SELECT CAST(sum(n) AS BIGINT) AS rows_touched, count(*) AS partition_fanout, max(n) AS max_partition_rows, CAST(0 AS BIGINT) AS checkpoints_loaded FROM (SELECT client_id, symbol_id, count(*) AS n FROM ({SQL_LI}) GROUP BY ALL)"
register("query_metrics", lambda s, d: query.metrics(LI(s, d), query.Query()), SQL_METRICS)
register(
    "query_metrics_range",
    lambda s, d: query.metrics(LI(s, d), query.Query(lo=MONTH[0], hi=MONTH[1]), lots_table(s, d)),
    f"""WITH t AS MATERIALIZED ({SQL_LI}), k AS (SELECT client_id, symbol_id, count(*) FILTER (day > {CUTOFFS[1]} AND day <= {MONTH[1]}) AS n FROM t GROUP BY ALL), l AS ({sql_lots(FIFO, CUTOFFS[1])})
SELECT CAST(sum(n) AS BIGINT) AS rows_touched, count(*) AS partition_fanout, max(n) AS max_partition_rows, (SELECT count(*) FROM (SELECT DISTINCT client_id, symbol_id FROM l)) AS checkpoints_loaded FROM k""",
)
register(
    "router_predict",
    lambda s, d: router.predict_columns(query.metrics(LI(s, d), query.Query())),
    f"SELECT *, rows_touched * CAST(3 AS DOUBLE) + checkpoints_loaded * CAST(500 AS DOUBLE) AS cpu_ns, CAST(50000 AS DOUBLE) + rows_touched * CAST(1.8 AS DOUBLE) + partition_fanout * CAST(2000 AS DOUBLE) + max_partition_rows * (CAST(0.2 AS DOUBLE) / 256) AS gpu_ns, CASE WHEN gpu_ns < cpu_ns THEN 'gpu' ELSE 'cpu' END AS route FROM ({SQL_METRICS})",
)


def observations(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' line items as if they were runs: rows, and times linear in them."""
    n = LI(s, d).groupBy("client_id").agg(F.count("*").alias("rows"))
    return n.select("rows", (4 * F.col("rows") + F.col("client_id") % 3).alias("cpu_ns"), F.when(F.col("client_id") % 2 == 0, 2 * F.col("rows")).alias("gpu_h2d_ns"), F.lit(None).cast("long").alias("gpu_kernel_ns"))


register(
    "router_fit",
    lambda s, d: router.fit(observations(s, d)).select(F.round("cpu_per_row", 9).alias("cpu_per_row"), F.round("gpu_per_row", 9).alias("gpu_per_row"), F.round("h2d_per_row", 9).alias("h2d_per_row")),
    f"WITH {SQL_N} SELECT round(CAST(sum(n * (4 * n + client_id % 3)) AS DOUBLE) / CAST(sum(n * n) AS DOUBLE), 9) AS cpu_per_row, CAST(0.2 AS DOUBLE) AS gpu_per_row, CAST(2 AS DOUBLE) AS h2d_per_row FROM n",
)

# further accumulators
register("running_position", lambda s, d: accumulators.running_position(LI(s, d)), f"WITH {sql_inventory()} SELECT client_id, symbol_id, seq, day, CAST(inv AS BIGINT) AS position FROM e")
register(
    "vwap",
    lambda s, d: accumulators.vwap(LI(s, d)),
    f"SELECT client_id, symbol_id, CAST(sum(abs(signed_qty)) AS BIGINT) AS volume, CAST(sum(abs(signed_qty) * price_ticks) AS DOUBLE) / CAST(sum(abs(signed_qty)) AS DOUBLE) AS vwap_ticks FROM ({SQL_LI}) GROUP BY ALL",
)
register(
    "running_vwap",
    lambda s, d: accumulators.running_vwap(LI(s, d)),
    f"SELECT client_id, symbol_id, seq, CAST(sum(abs(signed_qty) * price_ticks) OVER w AS DOUBLE) / CAST(sum(abs(signed_qty)) OVER w AS DOUBLE) AS vwap_ticks FROM ({SQL_LI}) WINDOW w AS ({KEYS} ORDER BY seq)",
)
register(
    "avg_cost_at_buy",
    lambda s, d: accumulators.average_buy(LI(s, d)),
    f"SELECT client_id, symbol_id, seq, CAST(sum(signed_qty * price_ticks) OVER w AS DOUBLE) / CAST(sum(signed_qty) OVER w AS DOUBLE) AS avg_buy_ticks FROM ({SQL_LI}) WHERE signed_qty > 0 WINDOW w AS ({KEYS} ORDER BY seq)",
)
register(
    "unrealized_mtm",
    lambda s, d: accumulators.unrealized(LI(s, d)),
    f"WITH l AS ({sql_lots(FIFO, 1_000_000)}), p AS (SELECT client_id, symbol_id, arg_max(price_ticks, seq) AS mark FROM ({SQL_LI}) GROUP BY ALL) SELECT client_id, symbol_id, CAST(sum(signed_qty) AS BIGINT) AS open_qty, CAST(sum(signed_qty * (mark - price_ticks)) AS BIGINT) AS unrealized_ticks FROM l JOIN p USING (client_id, symbol_id) GROUP BY ALL",
)
register(
    "exposure",
    lambda s, d: accumulators.exposure(LI(s, d)),
    f"WITH {sql_inventory()} SELECT client_id, symbol_id, CAST(arg_max(inv, seq) AS BIGINT) AS position, arg_max(price_ticks, seq) AS mark_ticks, CAST(arg_max(inv, seq) * arg_max(price_ticks, seq) AS BIGINT) AS exposure_ticks FROM e GROUP BY ALL",
)
register(
    "max_drawdown",
    lambda s, d: accumulators.max_drawdown(matching.fragments(LI(s, d))),
    f"{sql_fifo()}, y AS (SELECT client_id, sell_day, sum(qty * (sell_ticks - buy_ticks)) AS r FROM f GROUP BY ALL), z AS (SELECT *, sum(r) OVER (PARTITION BY client_id ORDER BY sell_day) AS cum FROM y), u AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY client_id ORDER BY sell_day)) AS peak FROM z) SELECT client_id, CAST(max(peak - cum) AS BIGINT) AS max_drawdown_ticks FROM u GROUP BY ALL",
)
register("holding_histogram", lambda s, d: pnl.holding_histogram(matching.fragments(LI(s, d))), f"{sql_fifo()} SELECT sell_day - buy_day AS span, count(*) AS fragments, CAST(sum(qty) AS BIGINT) AS matched_qty FROM f GROUP BY ALL")

# a stream of the trades, in one batch after another, gives the fragments of the whole; the second batch goes on from the checkpoint
def streamed(s: SparkSession, d: str, policy: MatchPolicy) -> DataFrame:
    path = scratch(s, "stream")
    LI(s, d).write.parquet(f"{path}/trades")  # ordered once for both parts
    trades = s.read.parquet(f"{path}/trades")
    for part in (F.col("day") <= CUTOFFS[1], F.col("day") > CUTOFFS[1]):
        trades.where(part).write.mode("append").parquet(f"{path}/in")
        source = s.readStream.schema(trades.schema).parquet(f"{path}/in")
        run = lots.stream_fragments(source, policy).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return s.read.schema(FRAGMENTS).parquet(f"{path}/out")


register("stream_fragments_fifo", lambda s, d: streamed(s, d, FIFO), f"{sql_fifo()} SELECT * FROM f")
register("stream_fragments_hifo", lambda s, d: streamed(s, d, HIFO), f"{sql_priority(SQL_ORDER[HIFO])} SELECT * FROM f")

# scalars
register("row_count", lambda s, d: s.createDataFrame([(tradebook.row_count(s, f"{d}/lineitem.parquet"),)], "rows long"), "SELECT count(*) AS rows FROM lineitem")
register(
    "relative_errors",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", relative_error(F.col("l_extendedprice"), 1000 * F.col("l_quantity")).alias("error"), speedup(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio")),
    "SELECT l_orderkey, l_linenumber, CASE WHEN abs(1000 * l_quantity) < 1 THEN abs(l_extendedprice - 1000 * l_quantity) ELSE abs((l_extendedprice - 1000 * l_quantity) / (1000 * l_quantity)) END AS error, CASE WHEN l_discount <= 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice / l_discount END AS ratio FROM lineitem",
)
register(
    "session_starts",
    lambda s, d: trading_days(s, "2020-01-01", 20).select("idx", session_start(F.col("date")).alias("opens"), is_weekend(F.col("date")).alias("weekend")),
    "SELECT CAST(row_number() OVER (ORDER BY dt) - 1 AS INTEGER) AS idx, dt + INTERVAL 225 MINUTE AS opens, false AS weekend FROM range(TIMESTAMP '2020-01-01', TIMESTAMP '2020-03-01', INTERVAL 1 DAY) r(dt) WHERE dayofweek(dt) NOT IN (0, 6) QUALIFY idx < 20",
)
register("query_spans", lambda s, d: s.createDataFrame([(i, q.span) for i, q in enumerate((query.Query(), query.Query(lo=DAY[0], hi=DAY[1])))], "id int, span string"), f"SELECT CAST(0 AS INTEGER) AS id, 'all-history' AS span UNION ALL SELECT 1, 'range[{DAY[0]},{DAY[1]}]'")

# generated data: random by construction, so rows only
SMALL = gen.GenConfig(clients=40, days=60, mean_per_day=1.0, whales=2)
register("generated_tradebook", lambda s, d: gen.generate(s, SMALL))
register("generated_symbols", lambda s, d: gen.symbol_universe(s, SMALL))
register("generated_pnl", lambda s, d: query.run(tradebook.to_trades(gen.generate(s, SMALL)), query.Query()))
