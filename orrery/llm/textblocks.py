"""Byte-level text arithmetic on Arrow string columns.

Everything here works on the raw UTF-8 buffer of a batch: words are located with one
table lookup per byte, and any substring gets a 64-bit hash from prefix sums, so no
Python string is created per word.  Blocks are bounded in bytes; one document is never
split, so a document longer than the bound forms a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Two primes under 2**31 and a base of each: products of two residues fit into 64 bits.
_PRIMES = (2147483647, 2147483629)
_BASES = (1664525, 69069069)
#: So many terms of one byte times one residue add up without overflow.
_RUN = 1 << 23

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing: digits, a-z, and every non-ASCII byte.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """For each prime BASE**i and BASE**-i modulo the prime, for i in 0..n; they fit into 32 bits."""
    global _powers
    if not _powers or len(_powers[0]) <= n:
        n, made = max(n + (n >> 2), 1 << 16), []
        for prime, base in zip(_PRIMES, _BASES):
            for factor in (base, pow(base, -1, prime)):
                table = np.ones(1, dtype=np.uint64)
                while len(table) <= n:  # doubling
                    table = np.concatenate([table, table * np.uint64(pow(factor, len(table), prime)) % np.uint64(prime)])
                made.append(table[: n + 1].astype(np.uint32))
        _powers = made
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Substring hashes of one byte buffer: two polynomials, each modulo a prime, in one 64-bit value.

    Two different substrings of n bytes agree with a chance of about (n / 2**31)**2, whatever they hold.
    """

    def __init__(self, data: np.ndarray):
        tables = _power_tables(len(data))
        self.down = tables[1::2]
        self.sums = [self._running(data, up, np.uint64(prime)) for up, prime in zip(tables[::2], _PRIMES)]

    @staticmethod
    def _running(data: np.ndarray, up: np.ndarray, prime: np.uint64) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        for lo in range(0, len(data), _RUN):
            part = slice(lo + 1, min(lo + _RUN, len(data)) + 1)
            np.cumsum((data[lo : lo + _RUN].astype(np.uint64) + np.uint64(1)) * up[lo : min(lo + _RUN, len(data))], out=out[part])
            if lo:
                out[part] = (out[part] + out[lo]) % prime
            if lo + _RUN < len(data):
                out[part] %= prime
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end], equal for equal bytes wherever they stand."""
        found = []
        for sums, down, prime in zip(self.sums, self.down, map(np.uint64, _PRIMES)):
            found.append((sums[end] + prime - sums[start]) % prime * down[start] % prime)
        return mix64((found[0] | found[1] << np.uint64(32)) + (end - start).astype(np.uint64) * _MUL)


class Block:
    """Rows lo..hi of a batch: `data` (bytes), `offset` (row starts, with the end)."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offset: np.ndarray):
        self.lo, self.hi, self.data, self.offset = lo, hi, data, offset

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def words(self, lower: bool = True, table: np.ndarray = WORD) -> Words:
        return Words(self, LOWER[self.data] if lower else self.data, table)


class Words:
    """Maximal runs of table bytes, never across rows.

    start, end: byte positions; row: index inside the block; first: index of the first
    word of each row, with the total at the end.
    """

    def __init__(self, block: Block, data: np.ndarray, table: np.ndarray):
        self.block, self.data = block, data
        inside = table[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[block.offset] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, block.offset)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(block.rows), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Hashes(self.data).of(self.start, self.end)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of every run of n words; a row of fewer words, but not none, gives one run of all its words."""
        if not len(hashes):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        roll = np.zeros(len(hashes), dtype=np.uint64)
        size = np.minimum(self.count, n)[self.row]
        for k in range(n):
            here = hashes[np.minimum(np.arange(len(hashes)) + k, len(hashes) - 1)]
            roll = np.where(k < size, mix64(roll + here + np.uint64(k + 1)), roll)
        left = self.first[1:][self.row] - np.arange(len(hashes))  # words from here to the row's end
        keep = left >= size
        return roll[keep], self.row[keep]


def trim() -> None:
    """Give memory that arrays held back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run over batches, with a trim at the task's end; idle workers stay small."""

    def trimmed(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offset = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + limit, side="right")) - 1)
        yield Block(lo, hi, data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo])
        lo = hi
