"""Words of many texts hashed at once with numpy: no Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in groups of about so many bytes; a longer text makes a group by itself.
GROUP_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 1)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACES] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        size = max(n, 64, 2 * len(_powers))
        table = np.full(size, _BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) and where each text's words begin and end in them."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    space = _SPACES[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    at = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), at
    lengths = ends - starts
    table = _power_table(int(lengths.max()) + 1)
    # The place of each byte in its word: bytes between words weigh 0, whatever their place.
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.concatenate(
        (np.arange(starts[0]), np.repeat(starts, np.diff(np.append(starts, len(raw)))))
    )
    np.minimum(place, len(table) - 1, out=place)
    sums = np.add.reduceat(_BYTE[raw] * table[place], starts)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), at


def grouped(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of groups of about GROUP_BYTES."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > GROUP_BYTES:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Multipliers for the words of a shingle; longer sequences repeat them under another mix.
_PLACE = constants(64, 2)


def _sequence(words: np.ndarray) -> np.uint64:
    """One hash of a whole sequence that is shorter than a shingle."""
    total = (words * _PLACE[8 : 8 + len(words)]).sum(dtype=np.uint64) if len(words) <= 56 else words.sum(dtype=np.uint64)
    return mix(np.array([total + np.uint64(len(words))], dtype=np.uint64))[0]


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its lower-cased word shingles.

    Fewer words than the width make one shingle of the whole sequence; no words make an empty set.
    """
    for _, group in grouped(texts):
        words, at = word_hashes(group)
        if len(words) >= width:
            n = len(words) - width + 1
            sums = np.zeros(n, dtype=np.uint64)
            for j in range(width):
                sums += words[j : j + n] * _PLACE[j]
            rolled = mix(sums)
        else:
            rolled = np.empty(0, dtype=np.uint64)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                yield np.array([_sequence(words[a:b])], dtype=np.uint64)
            else:
                yield np.empty(0, dtype=np.uint64)
