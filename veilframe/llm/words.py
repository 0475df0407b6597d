"""Hashes of the words of texts, worked out on whole arrays of bytes.

A word's hash is a sum over its bytes, A-Z in lower case, of a random number of the byte times one of its place, scrambled:
two words that differ collide with a chance of about 2**-64, whatever they are. Longer words than PLACES are hashed by XXH64.
"""

from __future__ import annotations

import numpy as np
import xxhash

PLACES = 256
_random = np.random.default_rng(20)
MARKS, PLACED = (_random.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (256, PLACES))
#: No byte of UTF-8 text.
BLANK = 255
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91] += 32
KIND[[32, *range(9, 14)]] = BLANK
#: Bytes that are looked at a time.
TOGETHER = 1 << 16


def scramble(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    y ^= z
    y *= np.uint64(0x94D049BB133111EB)
    y ^= np.right_shift(y, np.uint64(31), out=z)
    return y


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and where they start."""
    kind = KIND[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(kind) + 2, np.int8)
    np.not_equal(kind, BLANK, out=inside[1:-1], casting="unsafe")
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    sizes = ends - starts
    letters = kind[inside[1:-1].view(bool)]
    first = np.cumsum(sizes) - sizes
    places = np.arange(len(letters)) - np.repeat(first, sizes)
    value = PLACED[places if sizes.max() <= PLACES else places % PLACES]
    value *= MARKS[letters]
    out = scramble(np.add.reduceat(value, first))
    for i in np.flatnonzero(sizes > PLACES).tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]].lower(), 42)
    return out, starts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    out, low = [], 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) < TOGETHER):
            size += len(texts[high]) + 1
            high += 1
        hashes, starts = _hashed(b" ".join(texts[low:high]))
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[low:high]])).tolist()
        out += [hashes[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
        low = high
    return out
