"""Numpy over the UTF-8 bytes of whole Arrow batches: words, shingles, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; one longer text goes alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def chunks(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts (one more entry than texts). Null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, CHUNK_BYTES + (CHUNK_BYTES >> 3)), base, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased, split at the bytes 0x20 and 0x09-0x0D.

    Returns the hashes in order and, for each text, the position of its first word (one more entry than texts).
    """
    n = len(raw)
    if n == 0:
        return np.empty(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, n), out=sums[1:])
    hashed = (sums[ends] - sums[starts]) * _power("down", _BASE_INV, n)[starts]
    return mix(hashed + (ends - starts).astype(np.uint64)), np.searchsorted(starts, at)


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours."""
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + n])
    return out


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text with fewer words has one shingle, one without words none."""
    hashes, first = words(raw, at)
    runs = fold(hashes, width) if len(hashes) >= width else np.empty(0, dtype=np.uint64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield fold(hashes[a:b], b - a) if b > a else hashes[:0]
