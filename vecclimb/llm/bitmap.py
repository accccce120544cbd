"""A bitmap of fixed size over the hashes of a table's keys: what is not in it is not in the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap_of(rows: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """A bit for the first `bits` bits of every 64-bit hash, eight to a byte.

    Built by partial aggregates; 2 ** (bits - 15) rows of 4 KB at most go to the driver, whatever the number of rows.
    """
    bit = F.shiftrightunsigned(hashed, 64 - bits)
    found = rows.groupBy(F.floor(bit / 32768).alias("k")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(32768))).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, held in found.collect():
        out[k * 4096 : (k + 1) * 4096] = np.frombuffer(bytes(held), np.uint8)
    return out


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of 64-bit hashes are set."""
    bit = hashes.view(np.uint64) >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
