"""Bitmaps of a fixed size that say which hashed keys may be in a table: never a wrong no, now and then a wrong yes.

Their size does not grow with the input, so they can be broadcast. They only spare work: what passes must be
decided exactly afterwards, and where a bitmap is full nothing is spared and nothing lost.
"""

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26


def bitmap(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int = BITS) -> np.ndarray:
    """Bits (a power of two of them) set at ``hashes`` of all rows; at most ``bits`` / 64 numbers reach the driver."""

    def found(batches: Iterable[pa.RecordBatch]):
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            place = hashes(batch) & np.uint64(bits - 1)
            np.bitwise_or.at(held, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(held)
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(held[part].view(np.int64))], ["i", "b"]
            )

    parts = rows.mapInArrow(found, "i int, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[parts.column("i").to_numpy()] = parts.column("b").to_numpy()
    return out.view(np.uint64)


def among(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    place = hashes & np.uint64(64 * len(table) - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
