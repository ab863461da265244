"""Words of many texts at once, as arrays: the shared groundwork of the text operators.

A batch of texts comes from Spark as one Arrow buffer of UTF-8 bytes. Everything here works
on such buffers in pieces of a few megabytes, so memory does not follow the batch. Word
hashes are 64 bits wide and depend on the word's bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2_000_000

_rng = np.random.default_rng(20260101)
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes outside words, for the two definitions of a word in use.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


@dataclass
class Piece:
    """Some neighbouring documents of a batch.

    ``rows`` are their positions in the batch; ``first`` has len(rows) + 1 entries, the
    first word of each document; ``starts`` and ``ends`` are byte offsets of words in ``data``.
    """

    rows: range
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word."""
        lengths = self.ends - self.starts
        if not len(lengths):
            return np.zeros(0, np.uint64)
        heads = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        letters = self.data[np.repeat(self.starts, lengths) + inside]
        terms = _BYTE_CODES[letters] * powers(int(lengths.max()))[inside]
        return mix(np.add.reduceat(terms, heads) + lengths.astype(np.uint64))

    def docs(self) -> np.ndarray:
        """Document (position in the piece) of each word."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is as long as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset:]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def pieces(texts: pa.Array, outside: np.ndarray = SPACES, lower: bool = False, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a batch into pieces of about ``size`` bytes; a document is never cut."""
    if not len(texts):
        return
    data, offsets = buffers(texts)
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), len(offsets) - 1)
        part = data[offsets[at]: offsets[to]]
        if lower:
            part = LOWER[part]
        bounds = offsets[at: to + 1] - offsets[at]
        word = ~outside[part]
        n = len(part)
        begin, end = word.copy(), word.copy()
        if n:
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            # Neighbouring documents touch: a word ends with its document.
            cut = bounds[:-1][bounds[:-1] < n]
            begin[cut] = word[cut]
            cut = bounds[1:][bounds[1:] > 0] - 1
            end[cut] = word[cut]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Piece(range(at, to), part, bounds, starts, ends, np.searchsorted(starts, bounds))
        at = to


def window_sums(codes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` codes; len(codes) - width + 1 values.

    Polynomials modulo 2**64 with an odd base, by differences of one running sum.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * weights, out=sums[1:])
    # Dividing by the base's power is multiplying by the power of its inverse.
    return mix((sums[width:] - sums[:n]) * _inverse_powers(n))


_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        grown = np.full(max(n, 2 * len(_inverse)), pow(int(_BASE), -1, 2**64), np.uint64)
        grown[0] = 1
        _inverse = np.multiply.accumulate(grown)
    return _inverse[:n]


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow lists of longs out of flat values and len + 1 bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the codes from begin up to end, for many spans."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=sums[1:])
    inverse = _inverse_powers(len(codes) + 1)
    return mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbouring values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions lie in a run of ``width`` that begins at one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:n]) > 0
