"""Texts of an Arrow batch as one byte buffer, and hashes of byte ranges of it, all with numpy."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An Arrow batch is worked on in blocks of about so many bytes.
BLOCK = 1_000_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def split_batch(batch: pa.RecordBatch, column: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about size bytes in a text column, a row at least."""
    offsets, _ = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes (uint8) of a string or binary array; nulls are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return (off - off[0] if len(off) else np.zeros(1, np.int64)), raw


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@functools.cache
def _values() -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; kept for the next block."""
    if len(_powers.get("up", ())) < n:
        m = max(n, BLOCK + BLOCK // 4)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class RangeHash:
    """Hashes of byte ranges of one buffer by running sums: equal bytes give equal hashes wherever they lie."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_values()[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        """Of all ranges of one size, by their starts."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text number of every word (runs of bytes other than space and 9 to 13), in order."""
    inside = ~_GAP[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[edge] |= inside[edge]
    stops[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words_at(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words of word_bounds as a binary array."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    bytes_ = data[np.arange(at[-1]) + np.repeat(start - at[:-1], size)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(bytes_)])


def word_digests(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Digests of 128 bits (two columns) and text number of every word (runs of bytes other than space and 9 to 13), in
    order. Equal words have equal digests; different ones have none in common that anyone knows of, whatever their
    length."""
    start, end, of = word_bounds(data, offsets)
    coded = words_at(_LOWER[data] if lower else data, start, end).dictionary_encode()
    at, raw = text_buffer(coded.dictionary)
    raw = raw.tobytes()
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in itertools.pairwise(at.tolist()))
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)[coded.indices.to_numpy(zero_copy_only=False)], of
