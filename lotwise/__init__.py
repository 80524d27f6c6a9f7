"""Lot matching and realized profit-and-loss over trades, on Spark DataFrames.

``sources`` reads and writes trades, ``functions`` holds column expressions and
rules, ``operators`` the relations derived from trades (fragments, lots, sums,
checkpoints, rollups, statistics), ``plans`` composes them into queries, and
``streaming`` keeps open lots over a stream.
"""
