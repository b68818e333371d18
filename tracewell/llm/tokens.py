"""Whole-batch tokenisation in numpy: words of Arrow text columns as 64-bit hashes.

A word is a run of bytes that are not separators.  ``SPACE`` separates at the
six ASCII white-space bytes only, so its words are ``[^\\x20\\x09-\\x0D]+``;
``PUNCT`` separates at every ASCII byte that is no letter or digit.  Hashes
depend on the word's bytes alone, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240101)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # 5 modulo 8: powers repeat late
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes that are hashed at a time; bounds the memory of the helper arrays.
BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + U64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``hashes``, byte ``starts`` and ``ends``, and each row's range ``at[i]:at[i+1]``."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False, hashed: bool = True):
        self.raw, self.rows = text_bytes(column)
        word = ~separators[self.raw]
        edge = word.copy()
        inner = word[1:] & word[:-1]
        edge[1:] &= ~inner
        last = word.copy()
        last[:-1] &= ~inner
        cuts = self.rows[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(word))]
        edge[cuts] = word[cuts]
        last[cuts - 1] = word[cuts - 1]
        self.starts, self.ends = np.flatnonzero(edge), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, self.rows)
        self.hashes = self._hash(_BYTE_LOWER if lower else _BYTE) if hashed else None

    def _hash(self, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        done = 0
        while done < len(out):
            begin = int(self.starts[done])
            upto = max(done + 1, int(np.searchsorted(self.ends, begin + BLOCK, "right")))
            end = int(self.ends[upto - 1])
            n = end - begin
            up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_BASE, n), _powers(_INVERSE, n))
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(table[self.raw[begin:end]] * up[:n], out=total[1:])
            s, e = self.starts[done:upto] - begin, self.ends[done:upto] - begin
            out[done:upto] = mix((total[e] - total[s]) * down[s], 1)
            done = upto
        return out

    def word_rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position on; the last n - 1 positions of a row are not grams of it."""
        h = self.hashes
        if len(h) < n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = out * U64(_BASE) + h[i : len(h) - n + 1 + i]
        return mix(out, n)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, a longer row alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if len(batch) == 0:
            continue
        wide = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
        ends = np.frombuffer(wide.buffers()[1], np.int64, len(wide) + 1, wide.offset * 8)
        begin = 0
        while begin < len(batch):
            upto = max(begin + 1, int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1)
            yield batch.slice(begin, upto - begin)
            begin = upto
