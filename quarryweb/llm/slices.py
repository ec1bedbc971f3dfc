"""Sorted runs of 64-bit keys that tasks send in blobs to slices of the range of keys, and filters of fixed size made slice by slice.

A task sends every different key once, with its count, so no key is hot; a
slice holds the keys of its part of the range only, so memory is bounded by
the number of slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of one blob.
ENTRIES = 1 << 13
#: Bits of a filter, in blocks of which each key's two bits share one.
FILTER_BITS, BLOCKS = 1 << 26, 1 << 16
#: Columns of rows that hold blobs.
ROW = "part long, kind int, data binary"
#: The most tasks that slices are dealt to, evenly; a task takes its slices one after the other.
TASKS = 20_000


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits as planes of bytes: sorted and small numbers then compress."""
    return b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    n = len(data) // (8 * len(kinds))
    whole = np.frombuffer(data, np.uint8).reshape(len(kinds), 8, n)
    return [np.ascontiguousarray(whole[i].T).reshape(-1).view({"u": np.uint64, "i": np.int64, "f": np.float64}[k]) for i, k in enumerate(kinds)]


def row(part: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["part", "kind", "data"])


def slice_of(key: np.ndarray, slices: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)


def blobs(kind: int, key: np.ndarray, columns: list[np.ndarray], slices: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted keys with their columns, for each slice, in blobs of at most ENTRIES."""
    of = slice_of(key, slices)
    cut = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]]) if len(of) else [0]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        for i in range(a, b, ENTRIES):
            at = slice(i, min(b, i + ENTRIES))
            yield row(int(of[a]), kind, pack(key[at], *[c[at] for c in columns]))


def gathered(parts: list[list[np.ndarray]], counted: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted different keys, their counts (or the sums of the counts), and others of one of each, of parts (key, count if counted, others); empties parts, and joins one column at a time, so that memory is not held twice."""
    columns = [list(c) for c in zip(*parts, strict=True)]
    parts.clear()
    key = np.concatenate(columns.pop(0))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size, key = len(key), key[first]
    if counted:
        count = np.concatenate(columns.pop(0))
        sums = np.add.reduceat(count[order], first) if size else count
        del count
    else:
        sums = np.diff(np.append(first, size))
    order = order[first]
    return key, sums, [np.concatenate(columns.pop(0))[order] for _ in range(len(columns))]


def segment(keys: np.ndarray, part: int, slices: int) -> tuple[int, np.ndarray]:
    """(first word, words) of the filter's blocks that keys of this slice fall in."""
    low, high = ((((p << 32) + slices - 1) // slices) * BLOCKS >> 32 for p in (part, part + 1))
    high = min(high, BLOCKS - 1)
    each = FILTER_BITS // BLOCKS
    bits = np.zeros((high - low + 1) * each, bool)
    for at in _bits(keys):
        bits[at - low * each] = True
    return low * each // 64, np.packbits(bits, bitorder="little").view(np.uint64)


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each = FILTER_BITS // BLOCKS
    one = (keys >> np.uint64(65 - FILTER_BITS.bit_length())).astype(np.int64)
    block = (keys >> np.uint64(65 - BLOCKS.bit_length())).astype(np.int64)
    return one, block * each + (keys & np.uint64(each - 1)).astype(np.int64)


def may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = _bits(keys)
    return ((bits[one >> 6] >> (one & 63).astype(np.uint64)) & (bits[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def filter_of(segments: list) -> np.ndarray:
    """The filter from its segments (first word, bytes)."""
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for at, data in segments:
        words = np.frombuffer(data, np.uint64)
        out[at : at + len(words)] |= words
    return out


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()


def dealt(rows: DataFrame, slices: int, by_kind: bool = False) -> DataFrame:
    """Rows of blobs by slice, and by kind if asked; each slice is whole in one task, and slices are dealt out evenly."""
    n = min(slices, TASKS)
    out = rows.repartitionById(n, (F.col("part") % n).cast("int"))
    # A task of one slice has nothing to sort.
    return out.sortWithinPartitions("part", "kind") if by_kind else out.sortWithinPartitions("part") if n < slices else out
