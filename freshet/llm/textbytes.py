"""Whole texts as byte arrays: slices of Arrow batches, words and their hashes.

Steps that run in Python work on the Arrow buffers with numpy, a few megabytes of
text at a time.  A text is never cut, so a very long one is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: Bytes above which a span gets a cryptographic hash.
LONG = 64

#: An odd number; its powers modulo 2**64 weigh the bytes of a hashed word.
BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over the texts of a batch; null reads as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if not n:
        return
    _, places, data = col.buffers()
    at = np.frombuffer(places, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    return _TO_LOWER[data]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 .. n-1."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = x + np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, long: int = LONG) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand.

    Polynomials modulo 2**64 meet on regular byte patterns of some thousand bytes, so
    spans of more than ``long`` bytes are hashed by BLAKE2 instead.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    out = mixed((sums[ends] - sums[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > long).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one more at the end).

    Words are runs of bytes other than space and 9 to 13; no word spans two texts.
    """
    n = len(data)
    inside = ~_IS_SPACE[data]
    edge = np.empty(n + 1, bool)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    here = at[:-1][at[:-1] < n]
    begins[here] = inside[here]
    edge[:n] = begins
    ends = np.zeros(n + 1, bool)
    ends[1:] = inside
    ends[1:n] &= ~inside[1:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < n)]
    ends[cut] = inside[cut - 1]
    starts = np.flatnonzero(edge[:n])
    return starts, np.flatnonzero(ends), np.searchsorted(starts, at)
