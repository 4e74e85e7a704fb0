"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of bytes outside the six ASCII white-space bytes, which
in UTF-8 equals the runs of code points outside ``[\\x20\\x09-\\x0D]``. Every
function works on whole texts; batches are cut between texts only, so that the
arrays of one step stay within some ten MB (a text longer than that is a
step of its own). Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None
STEP_BYTES = 1 << 18  # bytes of text hashed in one step

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_Q = U64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _inverse(x: np.uint64) -> np.uint64:
    return U64(pow(int(x), -1, 2**64))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**(n-1) modulo 2**64."""
    held = cache.get(int(base))
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, U64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if size <= 4 << 20:
            cache[int(base)] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words(NamedTuple):
    """Words of consecutive texts: ``first[k]:first[k + 1]`` are those of text k."""

    lo: int  # number of the first text in its batch
    data: np.ndarray  # bytes of the texts (lower-cased if asked for)
    offsets: np.ndarray  # of texts in data
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    first: np.ndarray


def tidy() -> None:
    """Gives memory of the last batch back: executors run other processes beside this one."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def steps(texts: pa.Array, lower: bool = False, step_bytes: int = STEP_BYTES) -> Iterator[Words]:
    """Cuts a batch between texts and finds the words of each step."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off, raw = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + step_bytes, "right")) - 1)
        hi = min(hi, n)
        data, o = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if lower:
            data = _LOWER[data]
        solid = ~_SPACE[data]
        before, after = np.zeros_like(solid), np.zeros_like(solid)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[o[:-1][o[:-1] < len(data)]] = False
        after[o[1:][o[1:] > 0] - 1] = False
        starts = np.flatnonzero(solid & ~before)
        ends = np.flatnonzero(solid & ~after) + 1
        yield Words(lo, data, o, starts, ends, np.searchsorted(starts, o))
        lo = hi
    if len(raw) > 1 << 20:
        del data, solid, before, after, starts, ends
        tidy()


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, independent of where it stands."""
    if not len(starts):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers(_P, len(data)), out=total[1:])
    back = _powers(_inverse(_P), len(data) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64) * _Q)


def word_hashes(w: Words) -> np.ndarray:
    return spans(w.data, w.starts, w.ends)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, at the place of the first."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    if k <= 16:
        out = np.zeros(n, U64)
        for j in range(k):
            out *= _Q
            out += h[j : j + n]
        return mix(out)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h + _P) * _powers(_Q, len(h)), out=total[1:])
    return mix((total[k:] - total[:n]) * _powers(_inverse(_Q), n))


def inside(first: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Marks the places whose k words all belong to one text."""
    n = max(0, n_words - k + 1)
    ok = np.ones(n, bool)
    for j in range(1, k):  # the last k - 1 places of each text
        at = first[1:] - j
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    # A text of fewer than k words has marked places of its predecessors, which
    # are crossing ones as well: nothing valid is lost.
    return ok


def text_of(place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text that holds each word place."""
    return np.searchsorted(first, place, "right") - 1


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
