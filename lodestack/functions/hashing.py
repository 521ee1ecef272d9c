"""Hashes that results depend on bit by bit: BLAKE2b node keys and SplitMix64 projections."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

#: SplitMix64; fixed values.
GAMMA, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1


def node_key_of(kind: str, key: str) -> int:
    """The unsigned 64-bit key of a vertex."""
    return int.from_bytes(hashlib.blake2b(f"{kind}\x1f{key}".encode(), digest_size=8).digest(), "little")


@pandas_udf(LongType())
def node_key(kind: pd.Series, key: pd.Series) -> pd.Series:
    """The key as a signed long; unsigned order is that of the key with its top bit flipped."""
    found = np.fromiter((node_key_of(a, b) for a, b in zip(kind, key, strict=True)), np.uint64, len(kind))
    return pd.Series(found.view(np.int64))


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
        return z ^ (z >> np.uint64(31))


def splitmix_of(x: int) -> int:
    return int(splitmix(np.array([x & MASK], np.uint64))[0])
