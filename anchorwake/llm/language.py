"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams (blended spectrum, n = 2 to 4) that are
present in both, divided by the geometric mean of the numbers present in each. A bounded
sample of labelled texts is taken per language; some of them are the landmarks of a
Nyström map, and one-versus-rest kernel ridge regression is solved on the mapped sample.

A score is linear in the presence vector of a text, so landmarks, whitening and ridge
weights fold into one weight per n-gram and language, and a batch of texts is scored by
the product of its sparse presence matrix with that table. Every whole text is read.

Defined results: ``und`` with score 0 for null texts and texts without a letter; without
any labelled text all are ``und``; rows are never dropped, repeated rows give repeated
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorwake.llm.texts import U64, Slice, lowered, slices

ORDERS = (2, 3, 4)
BITS = 16  # n-grams are hashed into 2**BITS places
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 1 << 20


class LanguageModel(NamedTuple):
    """``weights``: one row per n-gram place, one column per language; ``bias`` per language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray


def presence(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams present in each text, as flat places and the first of each text."""
    rows, n = s.rows, len(s.data)
    marked = np.zeros((rows, 1 << BITS), bool)
    flat = marked.ravel()
    row_base = np.repeat(np.arange(rows, dtype=np.int64) << BITS, np.diff(s.offs))
    left = np.repeat(s.offs[1:], np.diff(s.offs)) - np.arange(n)  # bytes to the end of the text
    value, data = np.zeros(n, U64), lowered(s.data)
    for k in range(max(ORDERS)):
        value[: max(0, n - k)] |= data[k:].astype(U64) << U64(8 * k)
        if k + 1 in ORDERS:
            fits = left > k
            place = ((value[fits] + U64(k + 1)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)
            flat[row_base[fits] + place.astype(np.int64)] = True
    found = np.flatnonzero(flat)
    offs = np.searchsorted(found, np.arange(rows + 1, dtype=np.int64) << BITS)
    return found & ((1 << BITS) - 1), offs


def _rows_of(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for s in slices(pa.array(texts, pa.large_string()), 1 << 17):
        places, offs = presence(s)
        out += [places[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
    return out


def fit(texts: list[str], labels: list[str], landmarks: int = 256, ridge: float = 1e-2) -> LanguageModel:
    """Solve one-versus-rest kernel ridge regression over Nyström features."""
    languages = sorted(set(labels))
    size = 1 << BITS
    if not languages:
        return LanguageModel([], np.zeros((size, 0), np.float32), np.zeros(0))
    present = _rows_of(texts)
    chosen = np.linspace(0, len(texts) - 1, min(landmarks, len(texts))).astype(int)
    marks = np.zeros((size, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        marks[present[i], j] = 1 / np.sqrt(max(1, len(present[i])))
    kernel = np.stack([marks[p].sum(0) / np.sqrt(max(1, len(p))) for p in present]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > values.max() * 1e-6
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    mapped = kernel @ whiten
    middle = mapped.mean(0)
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    # Every language weighs the same, however many texts it has.
    weight = 1 / np.array([labels.count(x) for x in labels])
    level = (target * weight[:, None]).sum(0) / weight.sum()
    inner = mapped - middle
    gram = (inner * weight[:, None]).T @ inner + ridge * weight.sum() / len(texts) * np.eye(inner.shape[1])
    solved = np.linalg.solve(gram, (inner * weight[:, None]).T @ (target - level))
    return LanguageModel(languages, (marks @ (whiten @ solved)).astype(np.float32), level - middle @ solved)


def predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text: a softmax over the regressions, scaled to tell votes apart."""
    names, scores = [], np.zeros(len(column))
    for s in slices(column, _CHUNK):
        # At most 64 texts at a time, as the presence table has a row for each.
        for a in range(0, s.rows, 64):
            b = min(s.rows, a + 64)
            part = Slice(s.first + a, s.data[s.offs[a] : s.offs[b]], s.offs[a : b + 1] - s.offs[a])
            places, offs = presence(part)
            sums = np.zeros((part.rows, len(model.languages)))
            full = offs[1:] > offs[:-1]
            if len(places):
                sums[full] = np.add.reduceat(model.weights[places], offs[:-1][full], axis=0)
            votes = sums / np.sqrt(np.maximum(1, np.diff(offs)))[:, None] + model.bias
            shares = np.exp(2 * (votes - votes.max(1, initial=-1e9, keepdims=True)))
            shares /= np.maximum(shares.sum(1, keepdims=True), 1e-300)
            for i in range(part.rows):
                text = column[part.first + i].as_py()
                if not model.languages or not text or not _LETTER.search(text):
                    names.append("und")
                else:
                    best = int(votes[i].argmax())
                    names.append(model.languages[best])
                    scores[part.first + i] = min(1.0, shares[i, best])
    return names, scores


def remainder(doc_id: str, modulus: int) -> Column:
    """The fold of a document; one without an id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def train(docs: DataFrame, usable: Column, per_language: int = 300, languages: int = 200) -> LanguageModel:
    """Fit on at most ``per_language`` labelled texts of each of the ``languages`` most frequent languages.

    The sample is taken by the hash of the id, so that it is the same on every run, and
    found without reading the texts; only its texts come to the driver.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    # About twice the wanted number of each language by their hashes, then exactly that many.
    place = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    near = rows.select("lang", "doc_id").join(F.broadcast(top), "lang").where(place * F.col("count") < (2 * per_language << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = near.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= per_language)
    ids = ids.select("lang", "doc_id").distinct()
    # At most per_language * languages rows, as one is kept of each id.
    sample = rows.join(F.broadcast(ids), ["lang", "doc_id"], "left_semi").groupBy("doc_id", "lang")
    sample = sample.agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    sample = sorted(sample, key=lambda r: (r.doc_id, r.lang, r.text))
    return fit([r.text for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, usable: Column, held_out: Column, **sample) -> DataFrame:
    """Learn from the ``usable`` rows of ``docs`` and predict all: ``doc_id, held_out, lang_pred, score``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, usable, **sample))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names, scores = predict(model.value, part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
