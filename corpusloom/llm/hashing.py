"""Vectorised hashing of words and shingles, for the operators that run numpy in the workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Bytes that are hashed at a time, however long the texts are.
BLOCK = 1 << 20


def _powers_of(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2 ** 64."""
    out = np.ones(n, dtype=U)
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            step = U(pow(base, done, 2**64))
            out[done : 2 * done] = out[: min(done, n - done)] * step
            done *= 2
    return out


_tables: dict[int, np.ndarray] = {}


def _kept(base: int, n: int) -> np.ndarray:
    """Powers from a table that a worker keeps, 8 MB at most; more of them are made anew."""
    if n > BLOCK + 1:
        return _powers_of(base, n)
    if base not in _tables or len(_tables[base]) < n:
        _tables[base] = _powers_of(base, min(BLOCK + 1, max(2 * n, 1 << 16)))
    return _tables[base][:n]


def powers(n: int) -> np.ndarray:
    return _kept(_BASE, n)


def inverses(n: int) -> np.ndarray:
    return _kept(_INVERSE, n)


def word_hashes(texts: list[bytes], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of all texts, in order: their hashes, and where each text's words start (one more than texts).

    A-Z count as a-z; words are split at ASCII white space. Texts are read in
    blocks; what a block has of a word that goes on in the next one is carried over.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    hashes, starts = [], []
    part, length, began = U(0), 0, 0  # of the word that is open at the end of the last block
    for at in range(0, len(data), block):
        piece = LOWER[data[at : at + block]]
        solid = ~SPACE[piece]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        sums = np.zeros(len(piece) + 1, dtype=U)
        np.cumsum((piece.astype(U) + U(1)) * powers(len(piece)), out=sums[1:])
        value, size, where = (sums[end] - sums[start]) * inverses(len(piece) + 1)[start], (end - start).astype(U), start + at
        if length:
            if solid[0]:
                with np.errstate(over="ignore"):
                    value[0] = part + value[0] * U(pow(_BASE, length, 2**64))
                size[0] += U(length)
                where[0] = began
            else:
                value, size, where = np.concatenate([[part], value]), np.concatenate([[U(length)], size]), np.concatenate([[began], where])
        length = 0
        if solid[-1]:
            part, length, began = value[-1], int(size[-1]), int(where[-1])
            value, size, where = value[:-1], size[:-1], where[:-1]
        hashes.append(mix(value + size * U(0xFF51AFD7ED558CCD)))
        starts.append(where)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; of fewer words, the one hash of all of them."""
    w, first = word_hashes(texts)
    n = max(0, len(w) - width + 1)
    rolled = np.zeros(n, dtype=U)
    for k in range(width):
        rolled += w[k : k + n] * _SHINGLE[k % 5]
    rolled = mix(rolled)
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield mix((w[a:b] * _SHINGLE[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
        else:
            yield rolled[:0]


def byte_runs(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of some ``most`` bytes each."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
