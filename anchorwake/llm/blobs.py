"""Shuffles of many small records as columns of packed arrays.

A task deals its records into buckets and sends one row per bucket, whose binary columns
hold the values of all its records. Spark partitions, shuffles and retries these rows like
any others; a record takes the bytes of its values, and neither a row header nor a
conversion each. A bucket is a partition of the shuffle and is read by one task, so their
number follows the size of the input and every bucket stays small. There are never more
rows than records.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorwake.llm.texts import U64, mix

SCHEMA = "bucket int, data binary"
_PER_PARTITION = 32 << 20  # bytes of text behind one partition

#: Records of one kind: a number for it, the bucket of each, and their columns of 64-bit values.
Section = tuple[int, np.ndarray, tuple[np.ndarray, ...]]


def partitions(docs: DataFrame, text: str = "text") -> int:
    """Partitions for records derived from ``docs``: the session's number, or more for large texts."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / _PER_PARTITION))


def by_key(kind: int, key: np.ndarray, parts: int, *columns: np.ndarray) -> Section:
    """A section whose records with the same ``key`` go to the same bucket."""
    bucket = ((mix(key.view(U64) + U64(99)) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
    return kind, bucket, columns


def deal(parts: int, data: list[Section], **more: list[Section]) -> Iterator[pa.RecordBatch]:
    """One row per bucket: its records of the sections in ``data``, and of those in further columns.

    Bytes of equal weight stand together: the upper ones of small numbers are zeros, which
    the compression of the shuffle takes away.
    """
    columns = {"data": data, **more}
    packed = {name: [b""] * parts for name in columns}
    for name, sections in columns.items():
        for kind, bucket, values in sections:
            if not len(bucket):
                continue
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(parts + 1))
            held = [np.ascontiguousarray(v[order].view(np.int64)) for v in values]
            for i in np.flatnonzero(np.diff(ends)):
                head = np.array([kind, len(held), ends[i + 1] - ends[i]], np.int64).tobytes()
                packed[name][i] += head + b"".join(v[ends[i] : ends[i + 1]].view(np.uint8).reshape(-1, 8).T.tobytes() for v in held)
    full = [i for i in range(parts) if any(packed[name][i] for name in columns)]
    if full:
        arrays = [pa.array([packed[name][i] or None for i in full], pa.binary()) for name in columns]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *arrays], ["bucket", *columns])


def exchanged(df: DataFrame, parts: int) -> DataFrame:
    """The rows of each bucket as one partition; of one binary column."""
    return df.repartitionById(parts, "bucket")


class Records:
    """The records of one bucket, by kind."""

    def __init__(self):
        self._held: dict[int, list[list[np.ndarray]]] = {}

    def add(self, data: pa.Buffer) -> None:
        at = 0
        while at < data.size:
            kind, columns, n = np.frombuffer(data, np.int64, 3, at)
            at += 24
            values = []
            for _ in range(columns):
                values.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel())
                at += 8 * int(n)
            self._held.setdefault(int(kind), []).append(values)

    def of(self, kind: int, columns: int) -> list[np.ndarray]:
        """The columns of a kind."""
        held = self._held.get(kind)
        if not held:
            return [np.zeros(0, np.int64)] * columns
        return [np.concatenate([values[i] for values in held]) for i in range(columns)]


def buckets(parts: Iterator[pa.RecordBatch]) -> Iterator[Records]:
    """The records of a partition: one bucket, or none."""
    records, found = Records(), False
    for part in parts:
        for data in part.column(1):
            if data.is_valid:
                found = True
                records.add(data.as_buffer())
    if found:
        yield records


def per_key(keys: np.ndarray, columns: list[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """One row per key: ``id`` and the values of its records, column after column, as bytes."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.append(first[1:], len(keys))
    stacked = np.stack([c[order] for c in columns])
    rows = [np.ascontiguousarray(stacked[:, a:b]).tobytes() for a, b in zip(first, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(keys[first], pa.int64()), pa.array(rows, pa.binary())], ["id", name])
