"""Blocks of texts that ask a distributed table of counts about their keys.

A block's distinct keys are sorted numbers. Cut at fixed places of the key space, they travel as a few binaries, one for
each range of keys: coded by their gaps, a key costs about half of its eight bytes and Spark moves thousands as one row. The
task of a range adds the counts that blocks send along and answers each block in the order of its keys, so answers need
no keys. Every key counts; hashed keys spread evenly over the ranges, and a frequent one stands once in each block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)


def coded(numbers: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned numbers as bytes, plane by plane; ascending ones by their gaps."""
    numbers = np.ascontiguousarray(numbers, dtype="<u8")
    if not len(numbers):
        return b""
    if ascending:
        numbers = np.diff(numbers, prepend=np.uint64(0))
    wide = max(1, -(-int(numbers.max()).bit_length() // 8))
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return len(numbers).to_bytes(8, "little") + bytes([wide]) + _CODEC.compress(planes.tobytes(), asbytes=True)


def decoded(data: bytes, ascending: bool = False) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=np.uint64)
    n, wide = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(_CODEC.decompress(data[9:], decompressed_size=n * wide, asbytes=True), dtype=np.uint8)
    numbers = np.zeros((n, 8), dtype=np.uint8)
    numbers[:, :wide] = planes.reshape(wide, n).T
    numbers = numbers.view("<u8").reshape(-1)
    return np.cumsum(numbers, dtype=np.uint64) if ascending else numbers


def cuts(keys: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each of `ranges` equal ranges of the key space begins and ends among sorted keys of so many bits."""
    edges = np.array([(i << bits) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their sums, and where each part's keys stand among them."""
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    kinds, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(place, weights=np.concatenate(counts).astype(np.float64), minlength=len(kinds)).astype(np.int64)
    return kinds, sums, np.split(place, sizes)


def new_block() -> int:
    return uuid.uuid4().int >> 65


def row(schema: pa.Schema, values: dict) -> pa.RecordBatch:
    """A record batch of one row."""
    return pa.RecordBatch.from_arrays([pa.array([values[f.name]], type=f.type) for f in schema], schema=schema)
