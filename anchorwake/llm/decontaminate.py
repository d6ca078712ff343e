"""Benchmark passages in documents, also changed ones, by edit distance over words.

Words are runs of letters and digits, the case of Latin letters ignored. A document contains an item if some
stretch of it turns into the item with at most ``rate`` times its words edits.

*Embedding.* A walk over a sequence writes the word it stands on and then, as a random bit
of (repetition, step, word) says, moves on or stays. Two walks over sequences at small edit
distance fall into step again, so edit distance becomes Hamming distance (CGK).

*Search.* Each repetition samples the words written at a few steps of the walk. Item
windows from the rarer half of an item's words (rare in the benchmark) to its end are
entered under the sampled words; windows from every word of a document, of the length of
an item's window, are looked up. Sampled steps are compared one after the other, so most
document windows end after the first.

*Pieces.* An item that is changed by ``e`` edits at most keeps one of any ``e + 1`` pieces of it as it was. Items of
fewer than ``sure`` words, which walks may leave too early, are looked up by all of these pieces, so none is missed;
longer ones by one piece of rare words, so no exact copy is missed.

*Verification.* Places that were found are checked by the exact edit distance of the whole
item to the best stretch around them.

The benchmark is sent to all tasks in blocks of items whose size is checked; documents are
not shuffled. Items of fewer than ``short`` words need an exact match. Misses are possible
for changed items of ``sure`` words or more only; their rate is measured in the tests.

Defined results: null and empty texts contain nothing, items without words are in no
document; items without an id count like others and give a null ``item_id``; repeated rows each give their rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorwake.llm.texts import NOT_ALPHANUMERIC, U64, Slice, Words, lowered, mix, slices, words

RATE = 0.2
SHORT = 8
SURE = 32  # items of fewer words are found for certain, also changed ones
_PIECE = 5  # words of the piece by which a longer item is looked up
REPETITIONS = 8
_STEPS = (5, 10, 15)  # each repetition samples step 0 and one near each of these
_PLACE_BITS = 20
_BLOCK = 16 << 20  # bytes of items that are sent to the tasks at once


class Item(NamedTuple):
    item_id: int | None
    words: np.ndarray

    def edits(self, rate: float) -> int:
        return 0 if len(self.words) < SHORT else int(rate * len(self.words))


def sampled_steps(repetition: int, seed: int = 4) -> list[int]:
    rng = np.random.default_rng([seed, repetition])
    return [0, *(s + int(rng.integers(-2, 3)) for s in _STEPS)]


def words_of(s: Slice) -> Words:
    return words(Slice(s.first, lowered(s.data), s.offs), fold=False, breaks=NOT_ALPHANUMERIC)


class Index:
    """Sampled words of all item windows, by repetition."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = RATE):
        ids = [i for i, _ in items]
        texts = pa.array([t for _, t in items], pa.large_string())
        self.rate, self.items = rate, []
        for s in slices(texts):
            w = words_of(s)
            self.items += [Item(ids[s.first + k], w.hash[w.offs[k] : w.offs[k + 1]]) for k in range(s.rows) if w.offs[k] < w.offs[k + 1]]
        long = [i for i, x in enumerate(self.items) if len(x.words) >= SHORT]
        self.exact = [i for i, x in enumerate(self.items) if len(x.words) < SHORT]
        self.first = np.zeros(1 << _PLACE_BITS, bool)
        self.tables, self.pieces = [], []
        if long:
            flat = np.concatenate([self.items[i].words for i in long])
            size = np.array([len(self.items[i].words) for i in long])
            owner, begin = np.repeat(np.array(long), size), np.cumsum(size) - size
            at = self._starts(flat, size)
            self.first[_slot(flat[at])] = True
            last = np.repeat(begin + size, size)[at]
            offset = at - np.repeat(begin, size)[at]
            self.tables = [self._table(r, flat, at, last, owner[at], offset) for r in range(REPETITIONS)]
            self.pieces = self._pieces(flat, begin, long)
        self.exact_keys: dict[int, dict[int, list[int]]] = {}
        for i in self.exact:
            self.exact_keys.setdefault(len(self.items[i].words), {}).setdefault(_sequence(self.items[i].words), []).append(i)

    @staticmethod
    def _starts(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the words of each item that are not more frequent than its median word."""
        _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        frequent, out, begin = times[back], [], 0
        for n in size:
            own = frequent[begin : begin + n]
            out.append(begin + np.flatnonzero(own <= np.median(own)))
            begin += n
        return np.concatenate(out)

    def _pieces(self, flat: np.ndarray, begin: np.ndarray, long: list[int]) -> list[tuple]:
        """By size: marks of the pieces of items, and the pieces in order with their items and places in these."""
        _, back, times = np.unique(flat, return_inverse=True, return_counts=True)
        sums = np.concatenate([[0], np.cumsum(times[back])])
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, first in zip(long, begin.tolist(), strict=True):
            n = len(self.items[i].words)
            if n < SURE:
                edges = np.linspace(0, n, min(self.items[i].edits(self.rate), n - 1) + 2).astype(np.int64).tolist()
            else:
                at = np.arange(first, first + n - _PIECE + 1)
                rare = int((sums[at + _PIECE] - sums[at]).argmin())
                edges = [rare, rare + _PIECE]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                found.setdefault(b - a, []).append((first + a, i, a))
        out = []
        for size, rows in found.items():
            place, owner, offset = np.array(rows, np.int64).T
            key = _runs(flat, place, size)
            marks = np.zeros(1 << _PLACE_BITS, bool)
            marks[_slot(key)] = True
            order = np.argsort(key, kind="stable")
            out.append((size, marks, key[order], owner[order], offset[order]))
        return out

    @staticmethod
    def _table(repetition: int, flat, at, last, owner, offset) -> tuple:
        """Marks of the keys after each sampled step, and the item windows under the key of the last."""
        marks = []
        for key, kept in walk(repetition, flat, at, last):
            marks.append(np.zeros(1 << _PLACE_BITS, bool))
            marks[-1][_slot(key[kept])] = True
        order = np.argsort(key[kept], kind="stable")
        return marks, key[kept][order], owner[kept][order], offset[kept][order]


def _slot(word: np.ndarray) -> np.ndarray:
    return (word >> U64(64 - _PLACE_BITS)).astype(np.int64)


def _sequence(word: np.ndarray) -> int:
    value = np.zeros(1, U64)
    for x in word:
        value = mix(value + x)
    return int(value[0])


def _runs(flat: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each place."""
    value = np.zeros(len(place), U64)
    for k in range(size):
        value = mix(value + flat[place + k])
    return value


def walk(repetition: int, flat: np.ndarray, at: np.ndarray, last: np.ndarray, known: list | None = None):
    """Walk from the places ``at`` of ``flat``; a walk that comes to ``last`` is over.

    Yields after each sampled step the key of the words sampled so far, and which walks
    are still on. ``known`` ends walks whose key is not marked for the step.
    """
    bits = mix(flat + U64(repetition + 1))  # a word's bits for all steps of this repetition
    key, kept, here = np.zeros(len(at), U64), np.arange(len(at)), at
    steps, number = sampled_steps(repetition), 0
    for step in range(steps[-1] + 1):
        if step == steps[number]:
            on = here < last[kept]
            kept, here = kept[on], here[on]
            value = mix(key[kept] * U64(3) + flat[here])
            if known is not None and number:  # the caller has looked at the first word
                on = known[number][_slot(value)]
                kept, here, value = kept[on], here[on], value[on]
            key[kept] = value
            yield key, kept
            number += 1
        here = np.minimum(here + ((bits[here] >> U64(step)) & U64(1)).astype(np.int64), len(flat) - 1)


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits that turn a stretch of ``text`` into ``item``, and its begin and end; the first of equal ones."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    column = np.arange(n + 1)
    for k, word in enumerate(item):
        # Costs and begins go together in one value; edits count first, then late begins (shorter stretches).
        both = cost * (n + 2) + (n + 1 - begin)
        up = both + (n + 2)
        up[1:] = np.minimum(up[1:], both[:-1] + (text != word) * (n + 2))
        if k == 0:
            up[0] = (n + 2) + n + 1
        both = np.minimum.accumulate(up - column * (n + 2)) + column * (n + 2)
        cost, begin = both // (n + 2), n + 1 - both % (n + 2)
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


def found_in(index: Index, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
    """Rows ``row, item, begin word, end word, edits`` of the texts of a slice: the best stretch of each item."""
    flat, rows = w.hash, len(w.offs) - 1
    row_of = np.repeat(np.arange(rows), np.diff(w.offs))
    hits: dict[tuple[int, int], set[int]] = {}
    if len(flat) and index.tables:
        start = np.flatnonzero(index.first[_slot(flat)])
        last = w.offs[row_of[start] + 1]
        for repetition, (known, keys, owners, places) in enumerate(index.tables):
            for key, kept in walk(repetition, flat, start, last, known):
                pass
            low, high = np.searchsorted(keys, key[kept], "left"), np.searchsorted(keys, key[kept], "right")
            for k, a, b in zip(kept, low, high, strict=True):
                for entry in range(a, b):
                    at = int(start[k] - places[entry])
                    hits.setdefault((int(row_of[start[k]]), int(owners[entry])), set()).add(at)
    for size, marks, keys, owners, places in index.pieces:
        start = np.arange(len(flat) - size + 1) if len(flat) >= size else np.zeros(0, np.int64)
        start = start[start + size <= w.offs[row_of[start] + 1]]
        value = _runs(flat, start, size)
        on = marks[_slot(value)]
        start, value = start[on], value[on]
        low, high = np.searchsorted(keys, value, "left"), np.searchsorted(keys, value, "right")
        for at, a, b in zip(start.tolist(), low.tolist(), high.tolist(), strict=True):
            for entry in range(a, b):
                hits.setdefault((int(row_of[at]), int(owners[entry])), set()).add(at - int(places[entry]))
    for (row, i), places in hits.items():
        item = index.items[i]
        allowed = item.edits(index.rate)
        best, checked = None, -1
        for at in sorted(places):
            low, high = at - allowed, at + len(item.words) + allowed
            if high <= checked:
                continue
            # Neighbouring places differ little, so one stretch holds the windows of several.
            high += allowed
            checked = high
            low, high = max(low, int(w.offs[row])), min(high, int(w.offs[row + 1]))
            if np.isin(item.words, flat[low:high]).sum() < len(item.words) - allowed:
                continue  # every other word costs an edit
            edits, begin, end = best_stretch(item.words, flat[low:high])
            if edits <= allowed and (best is None or edits < best[2]):
                best = (low + begin, low + end, edits)
        if best:
            yield row, i, *best
    for size, keys in index.exact_keys.items():
        if len(flat) < size:
            continue
        value = np.zeros(len(flat) - size + 1, U64)
        for k in range(size):
            value = mix(value + flat[k : len(flat) - size + 1 + k])
        seen = set()
        for at in np.flatnonzero(np.isin(value, np.fromiter(keys, U64, len(keys)))):
            row = int(row_of[at])
            if at + size <= w.offs[row + 1]:
                for i in keys[int(value[at])]:
                    if (row, i) not in seen:
                        seen.add((row, i))
                        yield row, i, int(at), int(at) + size, 0


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """The items, in blocks of about ``limit`` bytes at most."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // limit)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = _BLOCK) -> DataFrame:
    """One row per document row and item that it contains.

    ``doc_id, item_id, begin, end`` (bytes of the text), ``edits`` and ``item_words``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, begin long, end long, edits int, item_words int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, block):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, rate))
        out = out.unionByName(rows.mapInArrow(_matches(index), schema))
    return out


def _matches(index):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in slices(part.column(1)):
                w = words_of(s)
                found = list(found_in(index.value, w))
                if found:
                    row, i, begin, end, edits = (np.array(c) for c in zip(*found, strict=True))
                    items = index.value.items
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(s.first + row)),
                            pa.array([items[k].item_id for k in i], pa.int64()),
                            pa.array(w.begin[begin] - s.offs[row], pa.int64()),
                            pa.array(w.end[end - 1] - s.offs[row], pa.int64()),
                            pa.array(edits, pa.int32()),
                            pa.array([len(items[k].words) for k in i], pa.int32()),
                        ],
                        ["doc_id", "item_id", "begin", "end", "edits", "item_words"],
                    )

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = _BLOCK) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns, without a shuffle."""
    place = docs.columns.index("text")
    for items in _blocks(benchmark, block):
        index = docs.sparkSession.sparkContext.broadcast(Index(items, rate))

        def run(parts: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for part in parts:
                clean = np.ones(part.num_rows, bool)
                for s in slices(part.column(place)):
                    for row, *_ in found_in(index.value, words_of(s)):
                        clean[s.first + row] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
