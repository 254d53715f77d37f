"""Words, their hashes and the hashes of word sequences, for whole Arrow columns at once.

A text is its UTF-8 bytes.  A 256-entry table maps every byte, separators to a space, so
that cutting words and lower-casing A-Z never changes positions and never touches the
bytes of non-ASCII letters.  Hashes have 64 bits and depend on the words alone, never on
the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
# Texts of one Arrow batch are handled in slices of about so many bytes; a longer text is a
# slice of its own.
SLICE_BYTES = 1 << 21


def byte_table(lower: bool, letters_only: bool = False) -> np.ndarray:
    """Where each byte goes; ``letters_only`` takes all ASCII but letters and digits as separators."""
    table = np.arange(256, dtype=np.uint8)
    for byte in range(128):
        if byte in SPACES or (letters_only and not chr(byte).isalnum()):
            table[byte] = 32
        elif lower and 65 <= byte <= 90:
            table[byte] = byte + 32
    return table


AS_IS = byte_table(lower=False)
LOWER = byte_table(lower=True)
LOWER_ALNUM = byte_table(lower=True, letters_only=True)

_BYTE = np.uint64(0x9E3779B97F4A7C13)
_WORD = np.uint64(0xD1342543DE82EF9B)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of a split-mix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BYTE), _Powers(_WORD)


def _sums(values: np.ndarray, powers: _Powers) -> np.ndarray:
    up, _ = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def _ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A hash of each ``[start, end)`` that does not depend on where the range stands."""
    _, down = powers.to(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of consecutive texts: text ``d`` has words ``first[d]`` to ``first[d + 1]``."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __post_init__(self):
        self.hashes = np.empty(len(self.starts), np.uint64)
        # By parts of the bytes, so that a very long text needs memory per word, not per byte.
        done = 0
        while done < len(self.starts):
            low = self.starts[done]
            stop = max(done + 1, int(np.searchsorted(self.ends, low + SLICE_BYTES, "right")))
            own = slice(done, stop)
            sums = _sums(_LETTERS[self.data[low : self.ends[stop - 1]]], _byte_powers)
            self.hashes[own] = _ranges(sums, self.starts[own] - low, self.ends[own] - low, _byte_powers)
            done = stop
        self._sums = _sums(self.hashes, _word_powers)

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def sequences(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word sequence ``[start, end)``."""
        return _ranges(self._sums, starts, ends, _word_powers)

    def grams(self, k: int) -> np.ndarray:
        """The hash of the ``k`` words from each word on; those that leave their text are no use."""
        starts = np.arange(max(0, len(self.hashes) - k + 1))
        return self.sequences(starts, starts + k)

    def gram_ranges(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end position of the ``k``-word sequences that lie within each text."""
        return self.first[:-1], np.maximum(self.first[:-1], self.first[1:] - k + 1)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column, a null as an empty text, and the offsets of its texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def cut(texts: pa.Array, table: np.ndarray) -> Iterator[Words]:
    """The words of a text column, in slices; ``row`` is the slice's first text."""
    data, offsets = text_buffers(texts)
    for row, end in slices(offsets):
        part = table[data[offsets[row] : offsets[end]]]
        bounds = offsets[row : end + 1] - offsets[row]
        word = np.zeros(len(part) + 1, bool)
        word[:-1] = part != 32
        fresh = np.ones(len(part) + 1, bool)
        fresh[1:] = ~word[:-1]
        fresh[bounds] = True
        starts = np.flatnonzero(word & fresh)
        stops = np.ones(len(part) + 1, bool)
        stops[:-1] = ~word[:-1]
        stops[bounds] = True
        # A word ends at the first separator or text bound after its start.
        ends = np.flatnonzero(stops)
        ends = ends[np.searchsorted(ends, starts, "right")] if len(starts) else starts
        yield Words(row, part, starts, ends, np.searchsorted(starts, bounds))


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
