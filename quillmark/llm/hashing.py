"""Vectorised hashes of words and word shingles: the same in every process, so results don't depend on where a task runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BLOCK = 1 << 18
_pw = np.ones(1, dtype=U)
_ipw = np.ones(1, dtype=U)
#: Multipliers that make a shingle's hash depend on the order of its words.
_ORDER = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pw, _ipw
    if len(_pw) < n:
        size = max(n, _BLOCK + 1)
        a, b = np.full(size, _P, dtype=U), np.full(size, _P_INV, dtype=U)
        a[0] = b[0] = 1
        _pw, _ipw = np.cumprod(a, dtype=U), np.cumprod(b, dtype=U)
    return _pw[:n], _ipw[:n]


def _blocks(data: bytes) -> Iterator[bytes]:
    """Pieces of about a block, cut where a word ends."""
    at = 0
    while len(data) - at > _BLOCK:
        end = at + _BLOCK
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash a word, in order: a polynomial of its bytes modulo 2**64, finalised."""
    out = []
    for piece in _blocks(data):
        b = np.frombuffer(piece, dtype=np.uint8)
        if not len(b):
            continue
        word = ~_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
        s, e = edge[::2], edge[1::2]
        if not len(s):
            continue
        pw, ipw = _powers(len(b))
        total = np.zeros(len(b) + 1, dtype=U)
        np.cumsum((b.astype(U) + U(1)) * pw, out=total[1:])
        out.append(mix((total[e] - total[s]) * ipw[s] + (e - s).astype(U)))
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def windows(words: np.ndarray, n: int = 5) -> np.ndarray:
    """A hash for each run of ``n`` words, in order; none where there are fewer words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U)
    h = np.zeros(m, dtype=U)
    for k in range(n):
        h += words[k : k + m] * _ORDER[k]
    return mix(h)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased; with fewer than ``n`` words the whole sequence is one shingle."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if 0 < len(w) < n:
        h = U(len(w))
        with np.errstate(over="ignore"):
            for k, x in enumerate(w):
                h = h + x * _ORDER[k]
        return mix(np.array([h], dtype=U))
    return np.unique(windows(w, n))
