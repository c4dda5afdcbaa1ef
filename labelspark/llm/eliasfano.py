"""Monotone sequences in few bits, memory-mapped and searched with numpy.

The upper part of each value is a one in a bit vector, after as many zeros as the part says; the lower bits are
stored as they are. A count of ones before each block of 128 bits leads a query to its block.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np

_BLOCK = 16  # bytes
_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
# Place of the k-th one within a byte.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
_SLICE = 1 << 17


def mapped(arrays: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The arrays in one file of the task, read through the page cache; the file goes with its last map."""
    file = tempfile.TemporaryFile()
    places = []
    for a in arrays:
        file.write(b"\0" * (-file.tell() % 8))
        places.append(file.tell())
        file.write(a.tobytes())
    file.flush()
    found = [np.asarray(np.memmap(file, a.dtype, "r", at, a.shape)) if a.size else a for a, at in zip(arrays, places)]
    file.close()
    return found


class EliasFano:
    """A sequence of numbers that never fall, below 2**62."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.int64)
        self.size = len(values)
        self.last = int(values[-1]) if self.size else -1
        self.shift = max(0, ((self.last + 1) // max(self.size, 1)).bit_length() - 1)
        bits = np.zeros((self.size + (self.last >> self.shift) + 2 + 8 * _BLOCK) // (8 * _BLOCK) * 8 * _BLOCK, np.uint8)
        bits[(values >> self.shift) + np.arange(self.size)] = 1
        upper = np.packbits(bits, bitorder="little")
        ones = np.cumsum(bits.reshape(-1, 8 * _BLOCK).sum(1, dtype=np.int64))
        ones = np.append(0, ones[:-1])
        lower = np.zeros(2 * 8, np.uint8)
        if self.shift:
            low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(self.shift + 7) // 8]
            low = np.unpackbits(low, axis=1, bitorder="little")[:, :self.shift]
            lower = np.append(np.packbits(low.reshape(-1), bitorder="little"), lower)
        self.arrays = [upper, lower, ones, np.arange(len(ones)) * (8 * _BLOCK) - ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.int64)
        lower, at = self.arrays[1], i * self.shift
        byte, bit = at >> 3, (at & 7).astype(np.uint64)
        # Eight bytes from any byte on.
        word = np.ndarray(len(lower) - 7, "<u8", lower, strides=(1,))[byte] >> bit
        if self.shift > 57:
            word |= np.where(bit > 0, lower[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(bit, np.uint64(1))), np.uint64(0))
        return (word & np.uint64((1 << self.shift) - 1)).astype(np.int64)

    def _select(self, i: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the ``i``-th one, or zero, of the upper bits."""
        counts = self.arrays[3] if zeros else self.arrays[2]
        upper = self.arrays[0].view("<u8")
        found = np.empty(len(i), np.int64)
        for start in range(0, len(i), _SLICE):
            wanted = i[start:start + _SLICE]
            block = np.searchsorted(counts, wanted, side="right") - 1
            rest = wanted - counts[block]
            flip = np.uint64(0xFFFFFFFFFFFFFFFF if zeros else 0)
            half = block * 2
            word = upper[half] ^ flip
            ones = np.bitwise_count(word).astype(np.int64)
            second = rest >= ones
            rest = (rest - ones * second).astype(np.uint64)
            half += second
            word = upper[half] ^ flip
            # Ones up to the end of each byte, side by side; those bytes are passed that hold no more than are left.
            sums = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
            sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> np.uint64(2)) & np.uint64(0x3333333333333333))
            sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
            passed = np.bitwise_count(((rest * _BYTES | _TOPS) - sums) & _TOPS).astype(np.uint64) * np.uint64(8)
            passed = np.minimum(passed, np.uint64(56))
            rest -= ((sums << np.uint64(8)) >> passed) & np.uint64(255)
            byte = (word >> passed) & np.uint64(255)
            found[start:start + len(wanted)] = half * 64 + passed.astype(np.int64) + _PLACE[byte, rest]
        return found

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        return ((self._select(i, False) - i) << self.shift) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that is not below ``x``, and whether it equals ``x``; ``size`` where there is none."""
        place, equal = np.full(len(x), self.size, np.int64), np.zeros(len(x), bool)
        inside = np.flatnonzero((x <= self.last) & (x >= 0))
        place[x < 0] = 0
        value = x[inside]
        high, low = value >> self.shift, value & ((1 << self.shift) - 1)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - high + 1, 0)
        end = self._select(high, True) - high
        at, stop = first.copy(), end.copy()
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            middle = (at[open_] + stop[open_]) >> 1
            less = self._low(middle) < low[open_]
            at[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]
            open_ = open_[at[open_] < stop[open_]]
        in_bucket = np.flatnonzero(at < end)
        hit = np.zeros(len(at), bool)
        hit[in_bucket] = self._low(at[in_bucket]) == low[in_bucket]
        place[inside], equal[inside] = at, hit
        return place, equal
