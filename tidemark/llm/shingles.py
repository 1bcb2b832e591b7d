"""Word shingles of whole texts as 64-bit hashes, and what set joins need of them (numpy helpers for Spark tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words of more bytes are hashed before they enter a shingle, so that memory stays bounded.
LONG_WORD = 256
#: Words that are hashed at a time.
PIECE = 8192

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> None:
    """Grow the tables of powers to n entries: each doubling multiplies what is there by one power."""
    global _powers, _inverses
    while len(_powers) < n:
        k = len(_powers)
        _powers = np.concatenate([_powers, _powers * np.uint64(pow(_BASE, k, 1 << 64))])
        _inverses = np.concatenate([_inverses, _inverses * np.uint64(pow(_INVERSE, k, 1 << 64))])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _piece_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hash of each run of `size` words, joined by blanks: a polynomial over the bytes, from running sums."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * _powers[: len(raw)], out=sums[1:])
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: len(words) - size + 1], ends[size - 1 :]
    return mix((sums[last] - sums[first]) * _inverses[first])


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles of `size` words; A-Z lower-cased. With fewer words, the whole
    sequence is one shingle; without words there is none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if max(map(len, words)) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.blake2b(w, digest_size=24).digest().hex().encode() for w in words]
    size = min(size, len(words))
    if len(words) <= PIECE:
        return np.unique(_piece_hashes(words, size))
    return np.unique(np.concatenate([_piece_hashes(words[k : k + PIECE + size - 1], size) for k in range(0, len(words) - size + 1, PIECE)]))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values (signed) that name a set."""
    if not len(tokens):
        return 0, 0
    a = int(mix(tokens + np.uint64(0x632BE59BD9B4E019)).sum()) ^ (len(tokens) * _BASE % (1 << 64))
    b = int(mix(tokens ^ np.uint64(0xD6E8FEB86659FD93)).sum())
    both = mix(np.array([a, b], dtype=np.uint64)).astype(np.int64)
    return int(both[0]), int(both[1])


def parity_bits(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in at least twice as many buckets as tokens (a power of two of them, 64 at least).

    The bits in which two sets' parities differ are at most as many as the tokens in which the sets differ.
    """
    size = 64
    while size < 2 * len(tokens):
        size *= 2
    return np.packbits(np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """Differing bits of two parities, the longer folded to the length of the shorter."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())
