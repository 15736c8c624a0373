"""Windows of a fixed number of bytes: names, anchors and runs of windows with one anchor.

A window's anchor is the place of its smallest `KEY`-byte string by hash (the first of equal ones).
Equal windows have equal anchors, wherever they stand. Consecutive windows that share an anchor
form a run, about one for every `(WINDOW - KEY) / 2` bytes, so that runs are few enough to shuffle
where windows are not.
"""

from __future__ import annotations

import numpy as np

WINDOW = 400
KEY = 64
#: Odd multipliers of the two polynomial hashes, modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values: np.ndarray) -> np.ndarray:
    """A scramble of 64-bit values that loses nothing."""
    values = (values ^ values >> np.uint64(30)) * MIX[0]
    values = (values ^ values >> np.uint64(27)) * MIX[1]
    return values ^ values >> np.uint64(31)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse, at least `length` of them."""
    if not _POWERS or len(_POWERS[0][0]) < length:
        size = 1 << max(18, int(length).bit_length())
        made = []
        for base in BASES:
            inverse = pow(base, -1, 1 << 64)
            pair = []
            for factor in (base, inverse):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                pair.append(np.multiply.accumulate(steps))
            made.append(tuple(pair))
        _POWERS[:] = made
    return _POWERS


class Hashes:
    """Hashes of any stretch of a byte buffer."""

    def __init__(self, raw: np.ndarray):
        self.tables = []
        for power, inverse in powers(len(raw) + 1):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
            self.tables.append((sums, inverse))

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Names of the stretches start .. end, by hash 0 or 1; their lengths count."""
        sums, inverse = self.tables[which]
        length = (end - start).astype(np.uint64) * MIX[which]
        return mixed((sums[end] - sums[start]) * inverse[start] + length)

    def of_all(self, length: int, which: int = 0) -> np.ndarray:
        """Names of the stretches of one length at every place."""
        sums, inverse = self.tables[which]
        count = len(sums) - length
        if count <= 0:
            return np.zeros(0, np.uint64)
        extra = np.uint64(length * int(MIX[which]) % (1 << 64))
        return mixed((sums[length:] - sums[:count]) * inverse[:count] + extra)


def smallest_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    count = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[:len(values)] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    return np.minimum(ahead[:count], behind[width - 1:width - 1 + count])


def anchor_runs(hashes: Hashes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows inside the documents between `bounds`: first and last window, anchor."""
    names = hashes.of_all(KEY)
    empty = np.zeros(0, np.int64)
    if len(names) < WINDOW - KEY + 1:
        return empty, empty, empty
    low = np.uint64((1 << int(len(names)).bit_length()) - 1)
    ranked = names & ~low | np.arange(len(names), dtype=np.uint64)
    anchor = (smallest_in_window(ranked, WINDOW - KEY + 1) & low).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:len(anchor)]
    inside = np.arange(WINDOW, WINDOW + len(anchor)) <= ends
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    return first, last, anchor[first]
