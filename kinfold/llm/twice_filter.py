"""Two Bloom filters over all tasks: keys seen once, keys seen twice.

Every task keeps two bit arrays, of the keys it has seen and of those it has seen
again, which it updates batch by batch; of each block of them it sends the set
bits or the array, whichever is smaller. The bit sets are merged block by block; a bit of the second filter is set
where a task saw a key twice or where two tasks saw it once. A key that occurs
twice always passes the second filter; others pass by chance, more of them the
smaller the filter is for the data. Its size is fixed, which bounds what is
broadcast; whoever uses it confirms exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm._shared import gives_back

BLOCK_BITS = 1 << 19


def positions(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """(key, k): the bits of each 64-bit hash, by double hashing on its halves."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] * np.uint64(0x9E3779B1) + high[:, None] * np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x85EBCA77C2B2AE63 & 0xFFFFFFFFFFFF)) >> np.uint64(13) & np.uint64(bits - 1)


def passes(table: np.ndarray, hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """Which hashes the filter (packed bits) holds."""
    at = positions(hashes, bits, k)
    return (table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def seen_twice(df: DataFrame, text_col: str, keys: Callable[[pa.Array], Iterable[np.ndarray]], bits: int, k: int) -> bytes:
    """The filter of keys seen twice, ``bits`` / 8 bytes. ``keys`` gives arrays of 64-bit hashes, each occurrence counting."""

    @gives_back
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for hashes in keys(batch.column(0)):
                at, times = np.unique(positions(hashes, bits, k), return_counts=True)
                byte, mask = at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)
                repeated = (times > 1) | (seen[byte] & mask > 0)
                np.bitwise_or.at(again, byte[repeated], mask[repeated])
                np.bitwise_or.at(seen, byte, mask)
        for kind, table in (("once", seen), ("twice", again)):
            for block, part in enumerate(table.reshape(-1, BLOCK_BITS // 8)):
                set_bits = int(np.bitwise_count(part).sum())
                if set_bits:
                    listed = 4 * set_bits < len(part)  # whichever is smaller
                    held = np.flatnonzero(np.unpackbits(part)).astype("<u4") if listed else part
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind]), pa.array([listed]), pa.array([held.tobytes()])], names=["block", "kind", "listed", "at"])

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
        for part in parts:
            for kind, listed, at in zip(*(part.column(c).to_pylist() for c in ("kind", "listed", "at")), strict=True):
                at = np.frombuffer(at, "<u4") if listed else np.flatnonzero(np.unpackbits(np.frombuffer(at, np.uint8)))
                if kind == "twice":
                    again[at] = True
                else:
                    again[at] |= seen[at]
                    seen[at] = True
        if again.any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(again).tobytes()])], names=["block", "bits"])

    blocks = df.select(text_col).mapInArrow(local, "block long, kind string, listed boolean, at binary").groupBy("block").applyInArrow(merge, "block long, bits binary")
    out = bytearray(bits // 8)
    for block, part in blocks.collect():  # bounded: bits / 8 bytes in all
        out[block * BLOCK_BITS // 8 : block * BLOCK_BITS // 8 + len(part)] = part
    return bytes(out)
