"""Schemas of the relations, and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = ("client_id", "symbol_id")

TRADEBOOK = T.StructType([
    T.StructField("trade_id", T.LongType()), T.StructField("client_id", T.LongType()), T.StructField("symbol_id", T.LongType()),
    T.StructField("side", T.ByteType()), T.StructField("quantity", T.LongType()), T.StructField("price", T.DoubleType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("venue", T.ShortType()), T.StructField("fees", T.FloatType()),
])
SYMBOLS = T.StructType([T.StructField("symbol_id", T.LongType()), T.StructField("base_price", T.DoubleType()), T.StructField("daily_vol", T.DoubleType())])
TRADES = T.StructType([
    T.StructField("client_id", T.LongType()), T.StructField("symbol_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("signed_qty", T.LongType()), T.StructField("price_ticks", T.LongType()), T.StructField("day", T.IntegerType()),
])
FRAGMENTS = "client_id long, symbol_id long, buy_seq long, sell_seq long, buy_day int, sell_day int, qty long, buy_ticks long, sell_ticks long"


def validate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns of the schema, by name; ValueError if one is missing or of another type."""
    found = {f.name: f.dataType for f in df.schema.fields}
    for f in schema.fields:
        if f.name not in found:
            raise ValueError(f"column {f.name} is missing")
        if found[f.name] != f.dataType:
            raise ValueError(f"column {f.name} is {found[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*[f.name for f in schema.fields])
