"""Elias-Fano sequences: n ascending numbers below a bound in about
2 + log2(bound / n) bits each, with select.

A number's low bits are packed side by side.  Its high part is a one in a bit
vector at place (number >> low) + its rank; every 64th one's place is sampled
in 32 bits, so select reads a few bytes of the vector.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
HEAD = "<QQQQ"  # numbers, low bits, bytes of low part, bytes of high part


def encode(values: np.ndarray) -> bytes:
    """Bytes of an ascending sequence of non-negative integers (uint64)."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if n and (v[1:] < v[:-1]).any():
        raise ValueError("numbers must ascend")
    low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
    high = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
    if len(bits) >= 1 << 32:
        raise ValueError("too many numbers for 32-bit samples")
    bits[high] = 1
    shifts = np.arange(low, dtype=np.uint64)
    packed = b"".join(np.packbits(((v[i:i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()
                      for i in range(0, n, 65536)) if low else b""  # 65536 x low bits: whole bytes
    ones = np.packbits(bits, bitorder="little").tobytes()
    samples = high[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(HEAD, n, low, len(packed), len(ones)) + packed + ones + samples


class Sequence:
    """Reader over the bytes of `encode` (an array of uint8, mapped or not)."""

    def __init__(self, data: np.ndarray):
        self.n, self.low, n_low, n_high = struct.unpack_from(HEAD, data)
        a = struct.calcsize(HEAD)
        self.packed = data[a:a + n_low]
        self.high = data[a + n_low:a + n_low + n_high]
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(bytes(data[a + n_low + n_high:a + n_low + n_high + 4 * n_samples]), "<u4")
        self.size = a + n_low + n_high + 4 * n_samples

    def select(self, i: int) -> int:
        """Number i."""
        return int(self.slice(i, i + 1)[0])

    def slice(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j, read from the sample at or before i."""
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.uint64)
        first = i // SAMPLE
        start = int(self.samples[first])
        stop_sample = -(-j // SAMPLE)
        stop = int(self.samples[stop_sample]) if stop_sample < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8:stop // 8 + 1], bitorder="little")
        bits[:start % 8] = 0
        places = np.flatnonzero(bits)[i - first * SAMPLE:j - first * SAMPLE] + start // 8 * 8
        out = (places - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            a = i * self.low
            raw = np.unpackbits(self.packed[a // 8:(j * self.low + 7) // 8], bitorder="little")
            raw = raw[a % 8:a % 8 + (j - i) * self.low].reshape(j - i, self.low)
            for k in range(self.low):
                out |= raw[:, k].astype(np.uint64) << np.uint64(k)
        return out
