"""Elias-Fano lists: a growing sequence of integers in about 2 + log2(last / size) bits each, with select.

Value i has ``bits`` low bits, packed one after another; its upper part is written in unary: bit ``upper + i`` of a bit
row is one. The place of every 64th one is kept, so that ``select(i)`` reads a few bytes only.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 64


class EliasFano:
    __slots__ = ("bits", "low", "n", "samples", "upper")

    def __init__(self, values: np.ndarray) -> None:
        values = np.asarray(values, dtype=np.int64)
        self.n = len(values)
        last = int(values[-1]) if self.n else 0
        self.bits = max(0, (last // max(1, self.n)).bit_length() - 1)
        ones = (values >> self.bits) + np.arange(self.n)
        row = np.zeros(int(ones[-1]) + 1 if self.n else 0, dtype=np.uint8)
        row[ones] = 1
        self.upper = np.packbits(row, bitorder="little")
        self.samples = ones[::SAMPLE].astype(np.int64)
        shifts = np.arange(self.bits)
        self.low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")

    def select(self, i: int) -> int:
        """Value ``i``, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        left += int(self.upper[byte] & ((1 << at % 8) - 1)).bit_count()
        while True:
            found = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 32], bitorder="little"))
            if left < len(found):
                high = byte * 8 + int(found[left]) - i
                break
            left, byte = left - len(found), byte + 32
        a, b = i * self.bits, (i + 1) * self.bits
        part = int.from_bytes(self.low[a // 8 : -(-b // 8)].tobytes(), "little")
        return high << self.bits | part >> a % 8 & ((1 << self.bits) - 1)

    def __len__(self) -> int:
        return self.n
