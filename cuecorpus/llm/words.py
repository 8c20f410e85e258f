"""Words and word shingles of whole texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: An odd number for each byte value, from a rule.
_VALUE = (np.arange(1, 257, dtype=np.uint64) * _MUL) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits so that each depends on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_INVERSE = np.uint64(pow(int(_MUL), -1, 2**64))


def _powers(n: int, base: np.uint64 = _MUL) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text.

    A-Z are lowered; words are runs of bytes other than space, tab, line feed, VT, FF and CR.
    """
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    starts, ends = edges[0::2], edges[1::2]
    n = len(data)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[data] * _powers(n)[:n])))
    hashes = mix((sums[ends] - sums[starts]) * _powers(n, _INVERSE)[starts] ^ (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, limits))))
    return hashes, counts


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, one text after the other, and their number per text.

    A text of fewer words than ``size`` has its whole sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    out, sizes = [], np.zeros(len(texts), np.int64)
    if len(words) >= size:
        rolled = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            rolled = rolled * _MUL + words[k : len(words) - size + 1 + k]
        rolled = mix(rolled)
    at = 0
    for k, c in enumerate(counts):
        if c >= size:
            own = np.unique(rolled[at : at + c - size + 1])
        elif c:
            whole = np.zeros(1, np.uint64)
            for w in words[at : at + c]:
                whole = whole * _MUL + w
            own = mix(whole ^ np.uint64(c))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        sizes[k] = len(own)
        at += c
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def batches_of(texts, most: int = 4_000_000):
    """Slices of a list of texts of about ``most`` bytes, so that arrays stay small whatever a batch holds."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, k
            at, held = k, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)
