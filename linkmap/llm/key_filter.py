"""Filters of a fixed size over 64-bit keys.

A filter is a plain bitmap over a hash of the key: what is in it is always
found, and what isn't is found by chance once it fills up.  It serves to keep
rows out of a shuffle, never to decide a result, so its size need not grow.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 24
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)


def has(bitmap: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    s = slots(keys, bits)
    return (bitmap[s >> np.uint64(3)] >> (np.uint8(7) - (s & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def _first_column(b: pa.RecordBatch) -> np.ndarray:
    return np.array(b.column(0).drop_null())


def key_filter(keys: DataFrame, bits: int = BITS, of: Callable[[pa.RecordBatch], np.ndarray] = _first_column) -> np.ndarray:
    """The bitmap of the long keys that ``of`` gives (the first column), as packed bits; at most 2**bits bits reach the driver."""
    n_ranges = 1 << min(bits - 10, 6)
    down = np.uint64(bits - int(math.log2(n_ranges)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << bits, bool)
        for b in batches:
            mark[slots(of(b), bits)] = True
        s = np.flatnonzero(mark)
        cut = np.searchsorted(s.astype(np.uint64) >> down, np.arange(n_ranges + 1, dtype=np.uint64))
        some = [r for r in range(n_ranges) if cut[r] < cut[r + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([s[cut[r] : cut[r + 1]].astype("<u4").tobytes() for r in some], pa.binary())], names=["r", "slots"])

    width = (1 << bits) // n_ranges

    def meet(key, pdf: pd.DataFrame) -> pd.DataFrame:
        mark = np.zeros(width, np.uint8)
        for x in pdf["slots"]:
            mark[np.frombuffer(x, "<u4") & np.uint32(width - 1)] = 1
        return pd.DataFrame({"r": [key[0]], "marks": [np.packbits(mark).tobytes()]})

    out = np.zeros(1 << bits - 3, np.uint8)
    n = width // 8
    for r, marks in keys.mapInArrow(pack, "r int, slots binary").groupBy("r").applyInPandas(meet, "r int, marks binary").collect():
        out[r * n : (r + 1) * n] = np.frombuffer(bytes(marks), np.uint8)
    return out
