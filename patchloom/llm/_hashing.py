"""Words, windows and their 64-bit polynomial hashes, computed with numpy on whole buffers.

A word's hash is the sum of ``CODE[byte] * BASE**j`` modulo 2**64, taken from one running sum
over the buffer; a window's hash is the same polynomial over word hashes. Both roll: no word or
window is hashed from its beginning again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes whose hashes are computed at once; longer buffers go piece by piece.
PIECE = 1 << 19

_IDENTITY = np.arange(256, dtype=np.uint8)
_LOWER = _IDENTITY.copy()
_LOWER[65:91] += 32


def _members(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


class Style(NamedTuple):
    """Which bytes belong to words, and what each byte is turned into first."""

    fold: bytes
    inside: np.ndarray


#: Runs of digits, letters and all non-ASCII characters, A-Z lower-cased.
ALNUM = Style(_LOWER.tobytes(), _members((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)))
#: Runs of anything but ASCII white space, unchanged or with A-Z lower-cased.
SPACED = Style(_IDENTITY.tobytes(), ~_members((0x20, 0x20), (0x09, 0x0D)))
SPACED_LOWER = Style(_LOWER.tobytes(), SPACED.inside)


class Words(NamedTuple):
    """Words of several texts: ``raw[start:end]``; text d has words first[d] to first[d + 1]."""

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**k and its inverse, modulo 2**64, for k below n at least."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for i, b in enumerate((BASE, inverse)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def spans(code: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of code[a:b] for each of the ascending, disjoint spans, by one running sum for each PIECE."""
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        lo, hi = int(start[at]), int(end[stop - 1])
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[code[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = start[at:stop] - lo, end[at:stop] - lo
        hashes[at:stop] = mix((sums[e] - sums[s]) * down[s])
        at = stop
    return hashes


def words(texts: list[bytes | None], style: Style) -> Words:
    raw = b" ".join(t or b"" for t in texts).translate(style.fold)
    sizes = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    bytes_ = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = style.inside[bytes_]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    hashes = spans(bytes_, CODE, start, end)
    first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    return Words(raw, start, end, hashes, first)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` hashes; position i covers i to i + width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        part = hashes[lo : hi + width - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        k = np.arange(hi - lo)
        out[lo:hi] = mix((sums[width:] - sums[: hi - lo]) * down[k])
    return out


def text_windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie in one text, and where they start among all words."""
    at = window_starts(w.first, width)
    return windows(w.hash, width)[at], at


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    if len(first) < 2 or first[-1] < width:
        return np.zeros(0, np.int64)
    bad = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(bad, np.maximum(first[1:] - width + 1, first[:-1]), 1)
    np.add.at(bad, first[1:], -1)
    return np.flatnonzero(np.cumsum(bad[:-1])[: int(first[-1]) - width + 1] == 0)


def chunks(texts: list[bytes | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of up to ``most`` bytes together, or one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def split_by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Cut points of sorted keys into equal ranges of the hash space: bucket b is cuts[b]:cuts[b + 1]."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte in turn, so that their leading zeros compress."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in a byte each, those from 255 on in full behind them."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out
