"""Texts of Arrow batches as flat byte arrays: slices, words, shingles and their hashes.

Everything is numpy over the bytes of many texts at once. Work arrays hold one slice
of about ``limit`` bytes (or one text, if that is longer), not a whole partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = int(0x9E3779B97F4A7C15) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=U64)
_BYTE_FOLDED = _BYTE[_FOLDED]
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


class Slice(NamedTuple):
    """Rows ``first`` to ``first + len(offs) - 1`` of a batch: their bytes and where each begins."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offs) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 19) -> Iterator[Slice]:
    """Cut a text or binary column into slices of at most ``limit`` bytes (one row at least). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield Slice(at, flat[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of ``values[i] * base**i`` before each place, to hash any range of values."""
    up, _ = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from ``begin`` to ``end``, the same wherever they stand."""
    _, down = powers(len(sums))
    return (sums[end] - sums[begin]) * down[begin]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes of UTF-8 with the capitals of ASCII and Latin-1 made small."""
    out = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return out + np.uint8(32) * (after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))


class Words(NamedTuple):
    """Words of a slice: bytes ``begin`` to ``end``, hash, and the first word of each row."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offs: np.ndarray


#: Bytes that are neither letters nor digits of ASCII nor part of a longer UTF-8 character.
NOT_ALPHANUMERIC = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


def bounds(s: Slice, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of bytes that are not ``breaks``, by default white space, begin and end."""
    n = len(s.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = breaks[s.data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    full = s.offs[1:] > s.offs[:-1]
    before[s.offs[:-1][full]] = True
    after[s.offs[1:][full] - 1] = True
    inside = ~space
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def words(s: Slice, fold: bool = True, breaks: np.ndarray = _SPACE) -> Words:
    """Runs of bytes that are not ``breaks``, by default white space; ``fold`` ignores the case of A-Z."""
    begin, end = bounds(s, breaks)
    if not len(s.data):
        return Words(begin, end, begin.view(U64), np.zeros(s.rows + 1, np.int64))
    sums = prefix_sums((_BYTE_FOLDED if fold else _BYTE)[s.data])
    hashes = mix(range_hash(sums, begin, end) + (end - begin).astype(U64))
    return Words(begin, end, hashes, np.searchsorted(begin, s.offs))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the first of each row.

    A row with fewer words, but not none, has its whole sequence as its one shingle.
    """
    n = len(w.hash)
    counts = np.diff(w.offs)
    each = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offs = np.zeros(len(w.offs), np.int64)
    np.cumsum(each, out=offs[1:])
    out = np.empty(offs[-1], U64)
    if not n:
        return out, offs
    whole = np.zeros(max(0, n - size + 1), U64)
    for k in range(size):
        whole = whole * U64(_BASE) + w.hash[k : n - size + 1 + k] if n >= size else whole
    whole = mix(whole)
    place = np.arange(offs[-1]) - np.repeat(offs[:-1], each) + np.repeat(w.offs[:-1], each)
    long = np.repeat(counts >= size, each)
    out[long] = whole[place[long]]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        own = w.hash[w.offs[row] : w.offs[row + 1]]
        value = np.zeros(1, U64)
        for x in own:
            value = value * U64(_BASE) + x
        out[offs[row]] = mix(value + U64(len(own)))[0]
    return out, offs


def batches(frame_batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.Table]:
    """Gather batches into tables of about ``limit`` bytes of ``column`` each."""
    held, size = [], 0
    for batch in frame_batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
