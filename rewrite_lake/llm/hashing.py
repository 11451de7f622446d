"""Vectorised hashing of words and word shingles (numpy, whole texts)."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C13)
_INV = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_POW = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_POW["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _MULT), ("down", _INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _POW[name] = np.cumprod(table)
    return _POW["up"][:n], _POW["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, powers): the hash of data[a:b] is (sums[b] - sums[a]) * powers[a]."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lowered, and the first word of each text (one more at the end)."""
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(data) and not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    sums, down = prefix_hash(data)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; of fewer words,
    the whole sequence is one; without words the set is empty."""
    words, first = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for j in range(k):
        rolled = (rolled ^ words[j:j + len(rolled)]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(j + 1)
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in words[a:b]:
                x = mix(np.array([x ^ w]))[0]
            out.append(np.array([x], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def chunks(items: list[bytes], most: int = 1 << 20):
    """Runs of items of about ``most`` bytes (an item alone may be longer)."""
    group, size = [], 0
    for x in items:
        group.append(x)
        size += len(x) + 1
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group
