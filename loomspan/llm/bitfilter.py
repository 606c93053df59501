"""Filters of hash bits that tasks test keys with: bounded in size, without false negatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and most bits of a filter (32 MB).  Beyond it a filter prunes less and the join behind it does the rest.
BITS_A_KEY, MOST_BITS = 16, 1 << 28
#: Words of 64 bits that come to the driver together.
PIECE = 8192


def filter_bits(n_keys: int) -> int:
    """The size of a filter for so many keys: a power of two."""
    return min(MOST_BITS, max(1 << 16, 1 << (BITS_A_KEY * n_keys).bit_length()))


def build(places: DataFrame, bits: int) -> bytearray:
    """The filter with the bits of the one column ``at`` (0 to bits - 1) set.

    Tasks put pieces of PIECE words together and the driver takes them a partition
    at a time, so it holds the filter once and little else.
    """
    word = places.selectExpr("cast(at >> 6 AS int) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bits")
    merged = word.groupBy("word").agg(F.bit_or("bits").alias("bits")).withColumn("piece", F.expr(f"word DIV {PIECE}"))

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("word").to_numpy().astype(np.int64)
        piece = np.zeros(min(PIECE, bits // 64), dtype=np.int64)
        piece[at % PIECE] = rows.column("bits").to_numpy()
        return pa.table({"piece": pa.array([int(at[0]) // PIECE], pa.int64()), "octets": pa.array([piece.tobytes()], pa.binary())})

    table = bytearray(bits // 8)
    for row in merged.groupBy("piece").applyInArrow(run, "piece long, octets binary").toLocalIterator():
        at = row["piece"] * PIECE * 8
        table[at : at + len(row["octets"])] = row["octets"]
    return table


def inside(table: bytes | bytearray, place: np.ndarray) -> np.ndarray:
    """Whether the bit of each place (unsigned) is set."""
    octets = np.frombuffer(table, dtype=np.uint8)
    return (octets[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
