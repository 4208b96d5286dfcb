"""Bloom filters over 64-bit hashes that tell which hashes at least two rows may have, one filter per range of hashes.

The hash space is cut into ranges of about ROWS rows, so each filter has the same bounded size whatever the number of
rows, and there are as many as are needed. Tasks first merge equal hashes among their own rows (a hash with a third of all rows
is one row a task after that); then each range is filled by one task, as two bit maps: positions set at least once, and at least
twice. Only hashes travel, 9 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one filter is made for, and its bits: 16 a row, so about 0.5 % of unique hashes pass.
ROWS = 1 << 20
BITS = ROWS * 16
PROBES = 3
#: Hashes that a task holds to merge equal ones.
HELD = 1 << 18


def ranges_for(rows: int) -> int:
    """How many filters (a power of two) so many rows need."""
    return 1 << max(0, (max(rows, 1) - 1).bit_length() - ROWS.bit_length() + 1)


def bits_for(rows: int) -> int:
    """Bits of one filter: all BITS, or fewer where the whole table is smaller than a range."""
    return BITS if rows >= ROWS else max(1 << 10, 1 << (max(rows, 1) * 16 - 1).bit_length())


def range_of(h: Column, ranges: int) -> Column:
    """The range of a hash: its upper bits."""
    return F.shiftrightunsigned(h, 65 - ranges.bit_length()).cast("int") if ranges > 1 else F.lit(0)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit positions of each hash in its range's filter: an array of (PROBES, n). ``bits`` is a power of two."""
    h = hashes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length()) for i in range(PROBES)])


class Filter:
    """The bit maps of one range while it is filled."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray, many: np.ndarray) -> None:
        """Distinct hashes, and which of them stand for several rows."""
        for at in positions(hashes, self.bits):  # one probe at a time: a row's own probes that coincide count once each
            place, index, n = np.unique(at, return_index=True, return_counts=True)
            byte, bit = place >> np.uint64(3), (np.uint8(128) >> (place & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
            some = np.zeros(len(at), bool)
            some[index] = n > 1
            repeated = some[index] | (self.once[byte] & bit > 0)
            np.bitwise_or.at(self.twice, byte[repeated], bit[repeated])
            np.bitwise_or.at(self.once, byte, bit)
            all_of = at[many]
            np.bitwise_or.at(self.twice, all_of >> np.uint64(3), (np.uint8(128) >> (all_of & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def merged(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and whether each came several times, or already stood for several rows."""
    one, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
    flag = n > 1
    np.logical_or.at(flag, inverse, many)
    return one, flag


def filters(hashes: DataFrame, rows: int) -> DataFrame:
    """(range, twice) for a DataFrame with one long column: bits that at least two of its ``rows`` rows set, per range."""
    ranges, bits = ranges_for(rows), bits_for(rows)
    name = hashes.columns[0]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            one, flag = merged(np.concatenate(held), np.zeros(n, bool))
            return pa.RecordBatch.from_arrays([pa.array(one), pa.array(flag)], names=["h", "many"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += batch.num_rows
            if n >= HELD:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, at = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([made.twice.tobytes()], pa.binary())], names=["range", "twice"])

        for batch in batches:
            h, many, of = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
            for x, y in zip(edges, [*edges[1:], len(of)], strict=True):
                if of[x] != at:
                    if made is not None:
                        yield done()
                    made, at = Filter(bits), int(of[x])
                made.add(*merged(h[x:y], many[x:y]))
        if made is not None:
            yield done()

    parts = hashes.select(F.col(name).alias("h")).mapInArrow(combine, "h long, many boolean").withColumn("range", range_of(F.col("h"), ranges))
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(fill, "range int, twice binary")


def all_set(twice: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether all bits of each hash are set in its range's filter: false means that no second row has this hash."""
    at = positions(hashes, bits)
    return ((twice[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0)
