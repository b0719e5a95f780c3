"""A bounded membership filter that tasks use before a shuffle.

A bitmap of ``2 ** BITS`` slots (16 MB, whatever the data's size) marks the slots
of a set of 64-bit fingerprints. A scan asks it which of its rows may be in the
set, and only those are shuffled to the exact join that follows. More
fingerprints mean more rows that pass in vain, never a row lost.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 27
_PART = 15  # bits of a slot inside one bitmap of bitmap_construct_agg


def slot_filter(members: DataFrame, column: str) -> Broadcast:
    """Broadcast bitmap of the fingerprints in ``column``."""
    slot = F.col(column).bitwiseAND(F.lit((1 << BITS) - 1))
    parts = (members.select(slot.alias("slot")).groupBy(F.shiftright("slot", _PART).alias("part"))
             .agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << _PART) - 1))).alias("bits")))
    table = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    size = 1 << (_PART - 3)
    for r in parts.toLocalIterator():
        table[r["part"] * size: (r["part"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return members.sparkSession.sparkContext.broadcast(table)


def may_contain(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = (values.view(np.uint64) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
