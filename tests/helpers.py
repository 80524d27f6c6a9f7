"""The rule of matching, written down as plainly as can be: a sequential fold."""

from __future__ import annotations

from lotwise.functions.rules import MatchPolicy


def fold(rows, policy=MatchPolicy.FIFO, carry=()):
    """rows: (signed_qty, price, day) of one key in order.  Returns fragments (buy_seq, sell_seq, buy_day, sell_day, qty, buy, sell) and lots left."""
    lots = [list(x) for x in carry]  # seq, qty, price, day
    out = []
    for seq, (qty, price, day) in enumerate(rows, 1):
        if qty > 0:
            lots.append([seq, qty, price, day])
        need = -qty
        while need > 0 and lots:
            i = 0
            if policy is MatchPolicy.LIFO:
                i = len(lots) - 1
            elif policy is MatchPolicy.HIFO:
                i = max(range(len(lots)), key=lambda k: (lots[k][2], -k))
            got = min(need, lots[i][1])
            out.append((lots[i][0], seq, lots[i][3], day, got, lots[i][2], price))
            need -= got
            lots[i][1] -= got
            if not lots[i][1]:
                lots.pop(i)
    return out, [tuple(x) for x in lots]


def frame(spark, keys):
    """keys: {(client, symbol): rows}."""
    from lotwise.schema import TRADES

    return spark.createDataFrame([(c, s, i, q, p, d) for (c, s), rows in keys.items() for i, (q, p, d) in enumerate(rows, 1)], TRADES)


def got(df):
    return sorted((r.client_id, r.symbol_id, r.buy_seq, r.sell_seq, r.buy_day, r.sell_day, r.qty, r.buy_ticks, r.sell_ticks) for r in df.collect())


def want(keys, policy=MatchPolicy.FIFO):
    return sorted((*k, *f) for k, rows in keys.items() for f in fold(rows, policy)[0])
