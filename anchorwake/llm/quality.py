"""Quality scores by a factorisation machine.

A text is a sparse vector: hashed words (share of the text's words, square root),
statistics of its structure, each cut into steps, and its length as metadata. The machine
gives every feature a weight and a vector of low rank; the interaction of all pairs comes
in linear time from the square of the sum less the sum of the squares.

It is trained with Adam on a bounded sample of labelled rows (``sample`` rows at most,
chosen by hash); all rows are scored on their whole texts.

Defined results: null and empty texts are scored by their (empty) structure; without
labelled rows every score is 0.5; rows with several labels learn from each; rows are
neither dropped nor merged; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorwake.llm.texts import U64, Slice, slices, words

WORD_BITS = 14
RANK = 8
_STEPS = 16
_STATS = 14
_SIZE = (1 << WORD_BITS) + _STATS * _STEPS + 1
_SCHEMA = "doc_id long, held_out boolean, score double"


class Machine(NamedTuple):
    bias: float
    weights: np.ndarray
    factors: np.ndarray


class Sparse(NamedTuple):
    """Rows as flat places and values, and where each row begins."""

    places: np.ndarray
    values: np.ndarray
    offs: np.ndarray


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def statistics(s: Slice) -> tuple[np.ndarray, list]:
    """Structure of every text as shares between 0 and 1, and its words."""
    w, data, n = words(s), s.data, np.diff(s.offs).astype(float)
    total = np.maximum(n, 1)
    count = np.diff(w.offs).astype(float)
    several = np.maximum(count, 1)
    chars = _sums((data & 0xC0) != 0x80, s.offs)
    letters = _sums(((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128), s.offs)
    digits = _sums((data >= 48) & (data <= 57), s.offs)
    capitals = _sums((data >= 65) & (data <= 90), s.offs)
    breaks = _sums(data == 10, s.offs)
    stops = _sums((data == 46) | (data == 44), s.offs)
    marks = _sums((data > 32) & (data < 127), s.offs) - _sums((data > 32) & (data < 127) & (((data | 32) >= 97) & ((data | 32) <= 122)), s.offs) - digits - stops
    wide = _sums(data >= 128, s.offs)
    ends = np.zeros(len(w.hash), bool)
    if len(data):
        last = data[np.maximum(w.end - 1, 0)]
        ends = ~((((last | 32) >= 97) & ((last | 32) <= 122)) | (last >= 128) | ((last >= 48) & (last <= 57)) | (last == 46) | (last == 44))
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.offs[:-1][w.offs[:-1] < len(same)]] = False
    bags, distinct, top = [], np.zeros(s.rows), np.zeros(s.rows)
    for row in range(s.rows):
        found, times = np.unique(w.hash[w.offs[row] : w.offs[row + 1]], return_counts=True)
        bags.append((found, times))
        distinct[row], top[row] = len(found), times.max(initial=0)
    long = _sums(w.end - w.begin > 24, w.offs)
    stats = np.stack(
        [
            np.log1p(n) / 16, np.log1p(count) / 14, np.minimum(1, chars / several / 16), letters / total,
            digits / total * 4, capitals / total * 2, np.minimum(1, breaks / several * 4), np.minimum(1, stops / several * 2),
            marks / total * 4, wide / total * 2, _sums(ends, w.offs) / several, _sums(same, w.offs) / several,
            distinct / several, top / several + 0 * long,
        ],
        axis=1,
    )
    stats[:, 6] = np.maximum(stats[:, 6], np.minimum(1, long / several))
    return np.clip(stats, 0, 1), bags


def features(s: Slice) -> Sparse:
    """The sparse vectors of a slice."""
    stats, bags = statistics(s)
    places, values, offs = [], [], [0]
    base = 1 << WORD_BITS
    for row, (found, times) in enumerate(bags):
        at = (found >> U64(64 - WORD_BITS)).astype(np.int64)
        share = np.sqrt(times / max(1, times.sum())) * 0.5
        step = stats[row] * (_STEPS - 1)
        low = np.minimum(step.astype(int), _STEPS - 2)
        k = base + np.arange(_STATS) * _STEPS + low
        places += [at, k, k + 1, [_SIZE - 1]]
        values += [share, 1 - (step - low), step - low, [1.0]]
        offs.append(offs[-1] + len(at) + 2 * _STATS + 1)
    return Sparse(np.concatenate(places).astype(np.int64), np.concatenate(values).astype(np.float32), np.array(offs))


def margins(machine: Machine, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
    """Value of the machine for every row, and the sums of the factors that its gradient needs."""
    at = x.offs[:-1]
    scaled = machine.factors[x.places] * x.values[:, None]
    total = np.add.reduceat(scaled, at, axis=0)
    squares = np.add.reduceat(scaled * scaled, at, axis=0)
    linear = np.add.reduceat(machine.weights[x.places] * x.values, at)
    return machine.bias + linear + 0.5 * (total * total - squares).sum(1), total


def fit(x: Sparse, label: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, seed: int = 6) -> Machine:
    """Logistic loss, Adam on the features of each batch, weights drawn to zero."""
    if not len(label):
        return Machine(0.0, np.zeros(_SIZE, np.float32), np.zeros((_SIZE, RANK), np.float32))
    rng = np.random.default_rng(seed)
    share = np.clip(label.mean(), 0.01, 0.99)
    table = np.concatenate([np.zeros((_SIZE, 1)), rng.normal(0, 0.05, (_SIZE, RANK))], axis=1).astype(np.float32)
    bias = float(np.log(share / (1 - share)))
    first, second, step = np.zeros_like(table), np.zeros_like(table), 0
    for epoch in range(epochs):
        order = rng.permutation(len(label))
        for k in range(0, len(label), batch):
            rows = order[k : k + batch]
            size = x.offs[rows + 1] - x.offs[rows]
            offs = np.concatenate([[0], np.cumsum(size)])
            pick = np.repeat(x.offs[rows] - offs[:-1], size) + np.arange(offs[-1])
            part = Sparse(x.places[pick], x.values[pick], offs)
            value, total = margins(Machine(bias, table[:, 0], table[:, 1:]), part)
            error = (1 / (1 + np.exp(-value)) - label[rows]) / len(rows)
            each = np.repeat(error, size)[:, None] * part.values[:, None]
            inner = np.repeat(total, size, axis=0) - table[part.places, 1:] * part.values[:, None]
            found, back = np.unique(part.places, return_inverse=True)
            slope = np.stack([np.bincount(back, c) for c in np.concatenate([each, each * inner], axis=1).T], axis=1)
            slope += 1e-4 * table[found]
            step += 1
            first[found] = 0.9 * first[found] + 0.1 * slope
            second[found] = 0.99 * second[found] + 0.01 * slope * slope
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            table[found] -= pace * first[found] / (np.sqrt(second[found]) + 1e-8)
            bias -= rate * float(error.sum())
    return Machine(bias, table[:, 0].copy(), table[:, 1:].copy())


def scores(machine: Machine, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for s in slices(column):
        value, _ = margins(machine, features(s))
        out[s.first : s.first + s.rows] = 1 / (1 + np.exp(-value))
    return out


def remainder(doc_id: str, modulus: int) -> Column:
    """The fold of a document; one without an id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 6000) -> Machine:
    """Fit on at most ``sample`` labelled rows for which ``usable`` holds."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # The sample is found on ids alone and is bounded, so it can be sent to all tasks.
    chosen = known.where(usable).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # An id may be repeated in any number of rows; one of them is kept before they come to the driver.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality")
    rows = rows.agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.quality, r.text or ""))
    parts = [features(s) for s in slices(pa.array([r.text for r in rows], pa.large_string()))]
    if not parts:
        return fit(Sparse(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)), np.zeros(0))
    base = np.concatenate([[0], np.cumsum([p.offs[-1] for p in parts])])
    offs = np.concatenate([[0], *[p.offs[1:] + b for p, b in zip(parts, base, strict=False)]]).astype(np.int64)
    x = Sparse(np.concatenate([p.places for p in parts]), np.concatenate([p.values for p in parts]), offs)
    return fit(x, np.array([float(r.quality > 0) for r in rows]))


def quality_scores(docs: DataFrame, labels: DataFrame, usable: Column, held_out: Column, threshold: float = 0.3, sample: int = 6000) -> DataFrame:
    """Learn from the ``usable`` labelled rows, score all: ``doc_id, held_out, score, predicted``."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, usable, sample))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(scores(machine.value, part.column(2)))], ["doc_id", "held_out", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, _SCHEMA).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = 0.3, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns, without a shuffle."""
    machine = docs.sparkSession.sparkContext.broadcast(train(docs, labels, usable, sample))
    place = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part.filter(pa.array(scores(machine.value, part.column(place)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
