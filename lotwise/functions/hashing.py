"""SplitMix64, the public-domain 64-bit mixer, over numpy arrays: bigint arithmetic in SQL raises where this must wrap."""

from __future__ import annotations

import numpy as np

#: The mixer's increment and multipliers, and the salt of symbols' prices.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SYMBOL_STEP, SYMBOL_SALT = 0x9E3779B9, 0x505800


def splitmix64(x: np.ndarray) -> np.ndarray:
    z = x.astype(np.uint64) + np.uint64(GAMMA)
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return z ^ (z >> np.uint64(31))


def unit(h: np.ndarray) -> np.ndarray:
    """The upper 53 bits as a number from 0 to under 1."""
    return (h >> np.uint64(11)).astype(float) / 2.0**53
