"""Vectorised words: numpy word hashes, shingles and lines for whole batches of texts.

A word is a maximal run of ASCII letters and digits and of non-ASCII characters, in lower
case. Words become 64-bit hashes straight from the UTF-8 bytes, so that no Python object is
made per word. Texts of any length are worked off in pieces of about ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18
SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _IS_WORD[_c] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) <= n:
        size = max(n + 1, PIECE + (1 << 16))
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one piece (lower case UTF-8)."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IS_WORD[raw]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``_hash_piece`` for data of any length, cut between words."""
    if len(data) <= PIECE:
        return _hash_piece(data)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and _IS_WORD[data[end]]:
            end += 1
        s, h = _hash_piece(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def chunks(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` characters together."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def doc_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the offsets at which each text's words begin and end."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    starts, hashes = hash_words(b"\n".join(parts))
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    return hashes, np.searchsorted(starts, bounds)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words per text; a shorter text with words gives one of all its words."""
    n, counts = len(hashes), np.diff(offsets)
    out_counts = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    out_offsets = np.concatenate(([0], np.cumsum(out_counts)))
    first = np.repeat(offsets[:-1] - out_offsets[:-1], out_counts) + np.arange(out_offsets[-1])
    last = np.repeat(offsets[1:], out_counts)
    total = np.zeros(len(first), np.uint64)
    for k in range(width):
        at = first + k
        word = hashes[np.minimum(at, max(n - 1, 0))] if n else total
        if k:
            word = np.where(at < last, word, np.uint64(k))
        total = total * np.uint64(0xD6E8FEB86659FD93) + word
    return mix(total), out_offsets
