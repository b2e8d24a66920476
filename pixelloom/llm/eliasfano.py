"""Elias-Fano sequences over flat buffers, with vectorised access.

A non-decreasing sequence of n numbers below u keeps the low log2(u / n) bits of each packed side by side and the high
bits in unary; ranks of the 64-bit words of the unary part, of ones and of zeros, are kept beside it. All reads work on arrays of positions or
values and touch only the bytes they need, so the buffer may be a memory map.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<qqqq")
_FIVES, _THREES, _NIBBLES, _BYTES, _TOPS = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))
#: Place of the k-th one of a byte at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for b in range(256) for k in range(8)], np.int64)


def encode(values: np.ndarray, universe: int) -> bytes:
    """values: non-decreasing uint64 below universe."""
    n = len(values)
    low = max(0, min(56, (universe // max(1, n)).bit_length() - 1))
    words = (n + (universe >> low) + 2) // 64 + 1
    lows, unary = [], np.zeros(words * 64, np.uint8)
    for a in range(0, n, 1 << 15):  # 32,768 values of any width fill whole bytes
        part = values[a : a + (1 << 15)]
        bits = (part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lows.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
        unary[(part >> np.uint64(low)).astype(np.int64) + np.arange(a, a + len(part))] = 1
    lows.append(b"\0" * 8)
    low_bytes = b"".join(lows)
    low_bytes += b"\0" * (-len(low_bytes) % 8)
    high = np.packbits(unary, bitorder="little").view("<u8")
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
    zeros = np.arange(words + 1, dtype=np.int64) * 64 - ones
    return _HEAD.pack(n, low, words, len(low_bytes)) + low_bytes + high.tobytes() + ones.astype("<i8").tobytes() + zeros.astype("<i8").tobytes()


class Sequence:
    def __init__(self, buffer, offset: int = 0):
        self.n, self.low, words, size = _HEAD.unpack_from(buffer, offset)
        at = offset + _HEAD.size
        raw = np.frombuffer(buffer, np.uint8, size, at)
        # an unaligned 64-bit read at every byte
        self.lows = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (size - 7,), (1,))
        self.high = np.frombuffer(buffer, "<u8", words, at + size)
        self.ones = np.frombuffer(buffer, "<i8", words + 1, at + size + 8 * words)
        self.zeros = np.frombuffer(buffer, "<i8", words + 1, at + size + 16 * words + 8)
        self.end = at + size + 24 * words + 16
        self.mask = np.uint64((1 << self.low) - 1)

    def _select(self, ranks: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Bit positions of the ones (or, flipped, zeros) of these ranks."""
        at = np.searchsorted(counts, ranks, "right") - 1
        word = self.high[at]
        if flip:
            word = ~word
        left = (ranks - counts[at]).astype(np.uint64)
        # running sums of ones by byte, side by side in a word; how many of them are at most the rank says the byte
        sums = word - ((word >> np.uint64(1)) & _FIVES)
        sums = (sums & _THREES) + ((sums >> np.uint64(2)) & _THREES)
        sums = ((sums + (sums >> np.uint64(4))) & _NIBBLES) * _BYTES
        byte = np.bitwise_count(((left * _BYTES | _TOPS) - (sums & ~_TOPS)) & _TOPS).astype(np.uint64) * np.uint64(8)
        byte = np.minimum(byte, np.uint64(56))
        left -= (sums << np.uint64(8)) >> byte & np.uint64(255)
        pos = byte.astype(np.int64) + _IN_BYTE[((word >> byte & np.uint64(255)) * np.uint64(8) + np.minimum(left, np.uint64(7))).astype(np.int64)]
        return at * 64 + pos

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        return (self.lows[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions i (0 <= i < n), as uint64."""
        i = np.asarray(i, np.int64)
        high = self._select(i, self.ones, False) - i
        return (high.astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def rank(self, values: np.ndarray) -> np.ndarray:
        """How many elements are at most each of these values (uint64)."""
        values = np.asarray(values, np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        over = high > last
        high = np.minimum(high, last)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) - np.maximum(high - 1, 0), 0)
        end = np.minimum(self._select(high, self.zeros, True) - high, self.n)
        lows = values & self.mask
        lo, hi = np.minimum(first, end), end
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return np.where(over, self.n, lo)
            mid = (lo[open_] + hi[open_]) >> 1
            up = self._low(mid) <= lows[open_]
            lo[open_] = np.where(up, mid + 1, lo[open_])
            hi[open_] = np.where(up, hi[open_], mid)
