"""Elias-Fano coding of a non-decreasing sequence of unsigned whole numbers.

Each value is split into low bits, stored as they are, and a high part, stored in unary in one bit string: value i sets
the bit at ``high + i``. ``select(i)`` finds that bit from the nearest sampled position, so no table of 64-bit offsets
is kept. n values below u take about ``n * (2 + log2(u / n))`` bits.
"""

from __future__ import annotations

import struct

import numpy as np

# Every so many values the position of its unary bit is kept, as 32 bits.
SAMPLE = 256
_HEAD = "<QBQQQ"


class EliasFano:
    """The coded sequence; ``encode`` makes one, ``to_bytes`` and ``from_bytes`` store it."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """Code an array; raises ValueError if it decreases somewhere."""
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n == 0:
            empty = np.zeros(0, dtype=np.uint8)
            return cls(0, 0, empty, empty, np.zeros(0, dtype=np.uint32))
        if np.any(values[1:] < values[:-1]):
            raise ValueError("Elias-Fano coding needs a non-decreasing sequence")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        chunk = bytes(self.low[at >> 3:(at + self.low_bits + 7) >> 3])
        return (int.from_bytes(chunk, "little") >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value number ``i``, from the sampled positions and at most a few bytes of the unary string per value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        current = int(self.high[byte]) >> (place & 7) << (place & 7)
        while left >= current.bit_count():
            left -= current.bit_count()
            byte += 1
            current = int(self.high[byte])
        for _ in range(left):
            current &= current - 1
        place = byte * 8 + (current & -current).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def select_range(self, first: int, last: int) -> np.ndarray:
        """Values number ``first`` up to ``last``: select of the first one, then the unary string up to the next sample."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, dtype=np.uint64)
        place = int(self.samples[first // SAMPLE])
        following = (last - 1) // SAMPLE + 1
        stop = int(self.samples[following]) if following < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[place >> 3:(stop + 7) >> 3], bitorder="little")
        bits[:place & 7] = 0
        skip = first % SAMPLE
        places = np.flatnonzero(bits)[skip:skip + last - first] + (place >> 3 << 3)
        out = (places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = first * self.low_bits
            packed = np.unpackbits(self.low[at >> 3:(last * self.low_bits + 7) >> 3], bitorder="little")
            low = packed[at & 7:(at & 7) + (last - first) * self.low_bits].reshape(last - first, self.low_bits)
            for b in range(self.low_bits):
                out |= low[:, b].astype(np.uint64) << np.uint64(b)
        return out

    def values(self) -> np.ndarray:
        """All values at once."""
        if self.n == 0:
            return np.zeros(0, dtype=np.uint64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
            for b in range(self.low_bits):
                out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack(_HEAD, self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at ``at`` and the place after it; raises ValueError if the bytes end too early."""
        n, low_bits, low, high, samples = struct.unpack_from(_HEAD, data, at)
        at += struct.calcsize(_HEAD)
        end = at + low + high + 4 * samples
        if end > len(data):
            raise ValueError("the coded sequence is cut off")
        return cls(n, low_bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
                   np.frombuffer(data, "<u4", samples, at + low + high)), end
