"""Exact deduplication of whole texts by Grace hashing.

Texts are equal when they are identical after each run of white space has become one
space. Map side: every task puts its texts in an open-addressing table that compares
complete contents, so a text leaves a task once, however many copies it has there. The
shuffle by hash is the first partitioning. In a task, records go on to spill files by
further bits of the hash, and again, until a bucket fits a table; a bucket that no hash
can split holds few distinct texts and is read through in a stream.

Rows get their group by a join on the hash of the text, whose right side has one row per
distinct text; a group with a third of all rows is only a skewed join of short rows,
which adaptive execution splits.

Defined results: null counts as empty; of rows with the same text and the same smallest
id (repeated rows) one stays; rows without an id come last; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorwake.llm.keys import free

#: Runs that are not yet one space.
_RUNS = re.compile(rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")
_FAN_OUT = 16
_LAST_LEVEL = 12  # levels of four bits of the second half of the hash
_NO_ID = (1 << 63) - 1


def normalised(text: bytes) -> bytes:
    return _RUNS.sub(b" ", text)


class ContentTable:
    """Open addressing with linear probing; a slot holds the number of an entry.

    Equal means equal contents: the stored hash only saves comparisons.
    """

    def __init__(self):
        self._slots = [-1] * 1024
        self.entries: list[list] = []  # [hash, content, smallest id, rows]
        self.size = 0

    def add(self, digest: bytes, content: bytes, doc_id: int, rows: int) -> None:
        slots, entries = self._slots, self.entries
        mask = len(slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (k := slots[at]) >= 0:
            entry = entries[k]
            if entry[0] == digest and entry[1] == content:
                entry[2] = min(entry[2], doc_id)
                entry[3] += rows
                return
            at = (at + 1) & mask
        slots[at] = len(entries)
        entries.append([digest, content, doc_id, rows])
        self.size += len(content)
        if 2 * len(entries) > len(slots):
            self._grow()

    def _grow(self) -> None:
        mask = 2 * len(self._slots) - 1
        self._slots = [-1] * (mask + 1)
        for k, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][:8], "little") & mask
            while self._slots[at] >= 0:
                at = (at + 1) & mask
            self._slots[at] = k

    def take(self) -> list[list]:
        entries = self.entries
        self.__init__()
        return entries


_SPILLED = pa.schema([("sha", pa.binary()), ("content", pa.large_binary()), ("doc_id", pa.int64()), ("n", pa.int64())])


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int, int]]:
    return zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


class _Bucket:
    """Records of one bucket in a scratch file of the task, which is gone once closed."""

    def __init__(self):
        self._file = tempfile.TemporaryFile()
        self._writer = pa.ipc.new_stream(self._file, _SPILLED)
        self._held: list = []
        self._size = 0
        self.size = 0

    def add(self, row) -> None:
        self._held.append(row)
        self._size += len(row[1]) + 64
        if self._size > 1 << 20:
            self._write()

    def _write(self) -> None:
        if self._held:
            self._writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self._held, strict=True), _SPILLED, strict=True)], schema=_SPILLED))
        self.size += self._size
        self._held, self._size = [], 0

    def read(self) -> Iterator[tuple]:
        self._write()
        self._writer.close()
        self._file.seek(0)
        for batch in pa.ipc.open_stream(self._file):
            yield from _rows_of(batch)
        self._file.close()


def grace_groups(rows: Iterator[tuple], memory: int, level: int = 0) -> Iterator[list]:
    """Distinct contents of ``(hash, content, id, rows)`` records with smallest id and number of rows.

    The first ``memory`` bytes of distinct contents stay in a table. Records that are
    not among them when it is full go to spill files, which are partitioned again.
    """
    table, buckets = ContentTable(), None
    known: set[bytes] = set()
    for row in rows:
        if buckets is not None and row[0] not in known:
            # Byte 8 onwards: the shuffle and the table use the first eight.
            nibble = row[0][8 + level // 2] >> (4 * (level % 2)) & (_FAN_OUT - 1)
            buckets[nibble].add(row)
            continue
        table.add(*row)
        if table.size > memory and buckets is None and level < _LAST_LEVEL:
            known = {e[0] for e in table.entries}
            buckets = [_Bucket() for _ in range(_FAN_OUT)]
    yield from table.take()
    del table
    for bucket in buckets or ():
        yield from grace_groups(bucket.read(), memory, level + 1)


def _texts_of(memory: int):
    """Distinct contents of a task, each once per ``memory`` bytes of them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for part in parts:
            ids = part.column(0).to_pylist()
            for doc_id, text in zip(ids, part.column(1), strict=True):
                content = normalised(text.as_buffer().to_pybytes() if text.is_valid else b"")
                table.add(hashlib.sha256(content).digest(), content, _NO_ID if doc_id is None else doc_id, 1)
            if table.size > memory:
                yield from _as_batches(table.take())
        yield from _as_batches(table.take())

    return run


def _as_batches(entries: list[list], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for entry in entries:
        held.append(entry)
        size += len(entry[1])
        if size > limit:
            yield _as_batch(held)
            held, size = [], 0
    if held:
        yield _as_batch(held)


def _as_batch(entries: list[list]) -> pa.RecordBatch:
    sha, content, ids, rows = zip(*entries, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(sha, pa.binary()), pa.array(content, pa.binary()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())],
        ["sha", "content", "doc_id", "n"],
    )


def _grouped(memory: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = []
        rows = (row for part in parts for row in _rows_of(part))
        for sha, _, doc_id, n in grace_groups(rows, memory):
            seen.append((sha, doc_id, n))
            if len(seen) == 20_000:
                yield _as_keys(seen)
                seen = []
        if seen:
            yield _as_keys(seen)

    return run


def _as_keys(rows: list) -> pa.RecordBatch:
    sha, ids, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(sha, pa.binary()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["sha", "keep_id", "group_size"])


def exact_groups(docs: DataFrame, memory: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct text: ``sha`` (binary), ``keep_id``, ``group_size``.

    ``memory`` is the size in bytes of the contents that a task holds at a time.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    texts = rows.mapInArrow(_texts_of(memory // 4), "sha binary, content binary, doc_id long, n long")
    return texts.repartition("sha").mapInArrow(_grouped(memory), "sha binary, keep_id long, group_size long")


def _hash_of(text: str) -> Column:
    plain = F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), _RUNS.pattern.decode(), " ")
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def exact_dedup(docs: DataFrame, memory: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Group equal texts: ``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _hash_of(text).alias("sha"))
    # Repeated rows of one id are numbered, so that one of them stays.
    turn = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("doc_id"))
    joined = rows.withColumn("turn", turn).join(exact_groups(docs, memory, doc_id, text), "sha")
    own = F.coalesce("doc_id", F.lit(_NO_ID))
    return joined.select(
        "doc_id",
        F.when(F.col("keep_id") != _NO_ID, F.col("keep_id")).alias("keep_id"),
        "group_size",
        ((own == F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, memory: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are.

    Of equal texts the row with the smallest id stays, whatever its other columns hold; of
    several rows with that id and text any one does. Rows are met again by ``doc_id`` and text.
    """
    own, sha = free(docs, "_own", "_sha")
    kept = exact_dedup(docs, memory).where("kept")
    kept = kept.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(own), F.unhex("text_sha256").alias(sha))
    hashed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(sha, _hash_of("text"))
    return hashed.join(kept.hint("merge"), [own, sha], "left_semi").dropDuplicates([own, sha]).select(*docs.columns)
