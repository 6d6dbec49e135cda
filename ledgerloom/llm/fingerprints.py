"""Rabin-Karp fingerprints of byte runs by prefix polynomials, bytes of Arrow columns, and bit maps of common fingerprints."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bit map has at most so many bits (32 MB), whatever the table; beyond that more bits are set by chance, which costs work and changes nothing.
MOST_BITS = 28
_MIX = np.uint64(0x9E3779B97F4A7C15)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the n + 1 offsets of its values, without a copy of the bytes; a null is empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit values spread over all bits."""
    values = (values ^ (values >> np.uint64(31))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


class Polynomial:
    """Prefix polynomials modulo 2**64 to an odd base: the value of any run is the difference of two prefixes, shifted back by the inverse base."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) * 8 + 5
        self.symbols = rng.integers(1, np.iinfo(np.uint64).max, 256, np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = n + n // 8 + 1024
            back = pow(self.base, -1, 1 << 64)
            for name, base in (("powers", self.base), ("inverses", back)):
                steps = np.full(size, base % (1 << 64), np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefixes(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix values of bytes, or of 64-bit symbols."""
        n = len(symbols)
        self._grow(n)
        values = self.symbols[symbols] if symbols.dtype == np.uint8 else symbols
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:n], out=out[1:])
        return out

    def runs(self, prefixes: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """Values of the runs [start, end), the same wherever they stand."""
        return (prefixes[ends] - prefixes[starts]) * self.inverses[: len(prefixes)][starts]


@lru_cache(None)
def polynomial(seed: int) -> Polynomial:
    return Polynomial(seed)


def as_longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def bit_map(found: DataFrame, column: str, count: int) -> np.ndarray:
    """Bits of the fingerprints in `column` as bytes, made by Spark; `count` says how many they are, by which the map is sized up to MOST_BITS."""
    bits = min(MOST_BITS, max(15, (16 * max(1, count)).bit_length()))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    parts = found.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.collect():  # at most 2 ** (MOST_BITS - 15) rows of 4 KB
        out[row["part"] << 12 : (row["part"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each value is set: true for all that the map was made of, and for few others."""
    at = values & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
