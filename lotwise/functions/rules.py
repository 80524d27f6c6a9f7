"""Holding-period buckets and match policies."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class MatchPolicy(str, Enum):
    """Which open lot a sell takes: the earliest, the latest, or the dearest (ties: the earliest)."""

    FIFO = "fifo"
    LIFO = "lifo"
    HIFO = "hifo"

    @classmethod
    def of(cls, name: str) -> MatchPolicy:
        try:
            return cls(name.lower())
        except ValueError:
            raise ValueError(f"policy must be one of {[p.value for p in cls]}, not {name!r}") from None


@dataclass(frozen=True)
class BucketRules:
    """Bounds are days held, ascending; same-day sales have a bucket of their own if ``intraday``."""

    bounds: tuple[int, ...] = (365,)
    intraday: bool = True

    def __post_init__(self) -> None:
        if not self.bounds:
            raise ValueError("at least one bound is needed")
        if list(self.bounds) != sorted(set(self.bounds)) or self.bounds[0] < (1 if self.intraday else 0):
            raise ValueError("bounds must rise, and start with 1 or more after an intraday bucket")

    @classmethod
    def equity(cls, long_term_days: int = 365) -> BucketRules:
        return cls((long_term_days,), True)

    @classmethod
    def bands(cls, bounds: list[int] | tuple[int, ...] | str, intraday: bool = True) -> BucketRules:
        """A list, or text like "30,365"."""
        if isinstance(bounds, str):
            try:
                bounds = [int(x.strip()) for x in bounds.split(",")]
            except ValueError:
                raise ValueError(f"bands must be numbers between commas, not {bounds!r}") from None
        return cls(tuple(bounds), intraday)

    @property
    def count(self) -> int:
        return self.intraday + len(self.bounds) + 1

    def label(self, bucket: int) -> str:
        if not 0 <= bucket < self.count:
            raise ValueError(f"there is no bucket {bucket}")
        if self.intraday and bucket == 0:
            return "intraday"
        i = bucket - self.intraday
        if i == len(self.bounds):
            return f">{self.bounds[-1]}d"
        low = self.bounds[i - 1] + 1 if i else int(self.intraday)
        return f"{low}-{self.bounds[i]}d"

    def classify(self, span: Column) -> Column:
        """The bucket of a number of days held."""
        out = F.lit(self.count - 1)
        for i in reversed(range(len(self.bounds))):
            out = F.when(span <= self.bounds[i], i + self.intraday).otherwise(out)
        return (F.when(span == 0, 0).otherwise(out) if self.intraday else out).cast("int")

    def labels(self, bucket: Column) -> Column:
        out = F.lit(None).cast("string")
        for i in range(self.count):
            out = F.when(bucket == i, self.label(i)).otherwise(out)
        return out

    def sql(self, span: str) -> str:
        """The same as ``classify``, as SQL text."""
        parts = [f"WHEN {span} = 0 THEN 0"] * self.intraday + [f"WHEN {span} <= {b} THEN {i + self.intraday}" for i, b in enumerate(self.bounds)]
        return f"CAST(CASE {' '.join(parts)} ELSE {self.count - 1} END AS INTEGER)"
