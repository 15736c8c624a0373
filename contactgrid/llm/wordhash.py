"""Sets of word shingles as sorted arrays of 64-bit hashes, many texts at once.

Words are runs of bytes other than the six ASCII white spaces, A-Z lower-cased. A word's hash comes
from running sums over a block of texts; words over `LONG_WORD` bytes, which such sums may not tell
apart, are hashed on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of texts that are hashed at once; a longer text is taken alone.
BLOCK_BYTES = 1 << 19
LONG_WORD = 256
BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(5)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, np.uint64)
_PLACES = _RANDOM.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = []


def mixed(values: np.ndarray) -> np.ndarray:
    """A scramble of 64-bit values that loses nothing."""
    values = (values ^ values >> np.uint64(30)) * _MIX[0]
    values = (values ^ values >> np.uint64(27)) * _MIX[1]
    return values ^ values >> np.uint64(31)


def powers(length: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < length:
        size = max(length, BLOCK_BYTES + 1)
        made = []
        for factor in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[:] = made
    return _POWERS


def word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of every word of a lower-cased block."""
    raw = np.frombuffer(block, np.uint8)
    space = np.r_[True, _SPACE[raw], True]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:len(raw)], out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + length * _MIX[0])
    for at in np.flatnonzero(length > LONG_WORD):
        hashes[at] = xxhash.xxh64_intdigest(block[starts[at]:ends[at]], 42)
    return starts, hashes


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The set of each text; with fewer words than `width`, all of them are its one shingle."""
    begin = size = 0
    for place in range(len(texts) + 1):
        if place == len(texts) or (size and size + len(texts[place]) > BLOCK_BYTES):
            yield from _block_sets(texts[begin:place], width)
            begin, size = place, 0
        if place < len(texts):
            size += len(texts[place]) + 1


def _block_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    starts, hashes = word_hashes(b" ".join(texts).lower())
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(text) + 1 for text in texts)]))
    many = max(0, len(hashes) - width + 1)
    total = np.full(many, width, np.uint64)
    for place in range(width):
        total += hashes[place:place + many] * _PLACES[place]
    total = mixed(total)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= width:
            found = np.sort(total[begin:end - width + 1])
            yield found[np.r_[True, found[1:] != found[:-1]]]
        elif end > begin:
            few = hashes[begin:end] * _PLACES[:end - begin]
            yield mixed(np.array([few.sum(dtype=np.uint64) + np.uint64(end - begin)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
