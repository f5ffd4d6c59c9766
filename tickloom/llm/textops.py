"""Vectorised text kernels over the Arrow buffers of a batch: no per-word Python loop.

All functions take the UTF-8 bytes of several texts laid end to end (``data``) and their
offsets (``offs``), in chunks of a few MB, so that memory does not depend on the batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE64 = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64, endpoint=True)
COEF = _rng.integers(1, 2**64 - 1, 64, dtype=np.uint64, endpoint=True) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INV = np.uint64(pow(int(BASE), -1, 2**64))
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        m = -(-n // (1 << 18)) << 18
        for k, b in ((0, BASE), (1, INV)):
            _pow[k] = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(m - 1, b, np.uint64))])
    return _pow[0][:n], _pow[1][:n]


def release_memory() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives free memory back: it stays alive beside the workers of later stages."""

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, data, offs) of runs of whole texts of about ``most`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[offs[:-1][offs[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    start, end = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def prefix(data: np.ndarray, table: np.ndarray = BYTE64) -> np.ndarray:
    """Prefix sums of the polynomial hash modulo 2**64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the bytes stand."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64) * COEF[63])


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every k-word shingle of ASCII-lower-cased texts, in text order.

    A text of fewer words than k has one shingle, its whole sequence; one without words has none.
    """
    low = FOLD[data]
    start, end, doc = words(low, offs)
    h = span_hash(prefix(low), start, end)
    m = len(h)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    if m >= k:
        ok = np.flatnonzero(doc[: m - k + 1] == doc[k - 1 :])
        s = np.zeros(len(ok), np.uint64)
        for j in range(k):
            s += h[ok + j] * COEF[j]
        out.append((mix(s + np.uint64(k)), doc[ok]))
    n = np.bincount(doc, minlength=len(offs) - 1)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(doc, short)
        s = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            s += np.where(j < n[short], h[np.minimum(first + j, m - 1)], np.uint64(0)) * COEF[j]
        out.append((mix(s + n[short].astype(np.uint64) * COEF[62]), short))
    hs, ds = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
    if len(short):
        o = np.argsort(ds, kind="stable")
        hs, ds = hs[o], ds[o]
    return hs, ds


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, sorted distinct shingle hashes) of every text that has words."""
    h, d = shingles(data, offs, k)
    cut = np.flatnonzero(np.diff(d)) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(d)]]), strict=True):
        if b > a:
            yield int(d[a]), np.unique(h[a:b])
