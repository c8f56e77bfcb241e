"""Bitmaps of fixed size over long columns, for sure prefilters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(df: DataFrame, col: str, bits: int) -> np.ndarray:
    """Which remainders modulo ``bits`` (a power of two) a column has, as packed
    bytes.  The driver gets 4 kB for each 32,768 bits, whatever the rows."""
    bit = F.pmod(col, F.lit(bits)) + 1
    parts = df.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits")).collect()
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for p in parts:
        out[(p.k - 1) * 4096 : p.k * 4096] = np.frombuffer(bytes(p.bits), np.uint8)
    return out


def member(packed: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Which values may be in the column; never wrong about one that is."""
    at = values & (bits - 1)
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
