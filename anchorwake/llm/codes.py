"""Vector codes: every vector as one codebook entry per part, by member-resident Lloyd.

A vector of whole numbers is cut into equal parts, and each part position has a codebook
of its own. The members of an entry, that is the parts assigned to it, live with their
owner: a (position, entry, salt), salts dividing the members of an entry that many parts
choose. An owner holds its members as packed chunks. In a round it sums what is resident,
the sums of the salts meet in one small aggregate, and with the new entries every owner
looks at its own members again. Those that stay are kept where they are by a map without a
shuffle; only those that change entry go through the next one, to their new owner.

All arithmetic is on integers, so no result depends on the order of rows or tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorwake.llm.store import discard, stored
from anchorwake.llm.texts import U64, mix

PARTS = 16
ENTRIES = 64
SCALE = 256
ROUNDS = 2
#: Members of one owner on average, if all parts of a position chose the same entry.
_PER_OWNER = 1 << 17
_PARTITION = 32 << 20  # bytes of members behind one partition of a shuffle
#: Values below this keep squared distances and their sums over a part within 64 bits.
LARGEST = 1 << 27
#: Rows of the table of labels up to which it is broadcast.
_LABELS = 100_000
_CHUNK = 1 << 17  # vectors dealt out at a time

_MEMBERS = "position int, entry int, salt int, members binary, moved boolean"


def quantised(vectors: DataFrame, value: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, label, row, values``: the vectors without null or non-finite components, as whole numbers.

    ``row`` tells rows of one id apart. The table is stored, as every round reads it.
    """
    # Rows with another number of components than most cannot be compared with them.
    x = F.col(f"`{value}`")
    finite = vectors.where(
        x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    ).where(F.size(x) > 0)
    sizes = finite.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    usual = sizes["n"] if sizes else PARTS
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    kept = finite.where(F.size(x) == usual).select(
        "vec_id", "label", F.monotonically_increasing_id().alias("row"), whole.alias("values")
    )
    return stored(kept)


def first_entries(kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """``[part, entry, component]``: the parts of the vectors with the smallest ids. Equal ids: the smaller vector."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "values").limit(entries).select("values").collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    table = np.array([r[0] for r in rows], np.int64)
    if table.shape[1] % parts:
        raise ValueError(f"{table.shape[1]} components cannot be cut into {parts} equal parts")
    return np.ascontiguousarray(table.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x`` (the lower one of equals), and its squared distance."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if largest >= LARGEST:
        raise ValueError(f"a component of {largest} after scaling is beyond the supported {LARGEST}")
    index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    exact = largest * largest * 4 * entries.shape[1] < 1 << 52  # then doubles hold every step
    step = 1 << 14 if exact else max(1, (1 << 20) // entries.size)
    norms = (entries.astype(float) ** 2).sum(1)
    for at in range(0, len(x), step):
        some = x[at : at + step]
        if exact:
            own = some.astype(float)
            d = norms - 2 * (own @ entries.T.astype(float)) + (own**2).sum(1)[:, None]
        else:
            d = ((some[:, None, :] - entries[None]) ** 2).sum(2)
        best = d.argmin(1)
        index[at : at + step] = best
        error[at : at + step] = d[np.arange(len(some)), best]
    return index, error


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _chunks(position: int, entry: np.ndarray, salt: np.ndarray, rows: np.ndarray, x: np.ndarray, moved: bool) -> Iterator[tuple]:
    """One chunk of members for each owner: row numbers, then the parts."""
    owner = entry * (int(salt.max(initial=0)) + 1) + salt
    order = np.argsort(owner, kind="stable")
    ends = np.flatnonzero(np.diff(owner[order], append=-1)) + 1
    for a, b in zip([0, *ends[:-1]], ends, strict=True) if len(order) else ():
        own = order[a:b]
        packed = rows[own].astype(np.int64).tobytes() + np.ascontiguousarray(x[own]).astype(np.int64).tobytes()
        yield position, int(entry[own[0]]), int(salt[own[0]]), packed, moved


def _members(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(packed, np.int64)
    n = len(values) // (width + 1)
    return values[:n], values[n:].reshape(n, width)


def _batch(chunks: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    columns = zip(*chunks, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["position", "entry", "salt", "members", "moved"])


def place(kept: DataFrame, books: np.ndarray, salts: int, partitions: int) -> DataFrame:
    """The first residents: every part with the owner of its nearest entry."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _gathered(batches):
            salt = ((mix(rows.view(U64)) >> U64(32)) * U64(salts) >> U64(32)).astype(np.int64)
            for position, entries in enumerate(books):
                own = x[:, position * books.shape[2] : (position + 1) * books.shape[2]]
                chunks = list(_chunks(position, nearest(own, entries)[0], salt, rows, own, True))
                if chunks:
                    yield _batch(chunks)

    return _arrived(kept.select("row", "values").mapInArrow(deal, _MEMBERS), partitions)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, many at a time, so that chunks are large."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((np.asarray(batch.column(0)).astype(np.int64), _matrix(batch.column(1)).astype(np.int64)))
            n += batch.num_rows
        if n >= _CHUNK:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _arrived(moving: DataFrame, partitions: int) -> DataFrame:
    """Chunks with their owners, stored where the next round reads them."""
    return stored(moving.repartition(partitions, "position", "entry", "salt").withColumn("moved", F.lit(False)))


def updated(residents: list[DataFrame], books: np.ndarray) -> np.ndarray:
    """The entries as the rounded-down means of their resident members; entries without members stay.

    Owners send one row of sums for each chunk; the result has a row for each component of an entry.
    """
    width = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_members(m.as_py(), width)[1] for m in batch.column(2)]
            counts = pa.array([len(x) for x in found], pa.int64())
            total = pa.array([x.sum(0).tolist() for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, total], ["position", "entry", "n", "total"])

    each = [r.select("position", "entry", "members").mapInArrow(sums, "position int, entry int, n long, total array<long>") for r in residents]
    rows = (
        reduce(DataFrame.unionByName, each)
        .select("position", "entry", "n", F.posexplode("total").alias("i", "x"))
        .groupBy("position", "entry", "i")
        .agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        .collect()  # at most as many as the codebooks have numbers
    )
    books = books.copy()
    for r in rows:
        books[r.position, r.entry, r.i] = r.x // r.n
    return books


def reassigned(residents: list[DataFrame], books: np.ndarray, partitions: int) -> list[DataFrame]:
    """The residents under new entries: who stays is written where they are, only who moves is shuffled."""
    width = books.shape[2]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = []
            for position, entry, salt, members, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, x = _members(members, width)
                to, _ = nearest(x, books[position])
                for moved in (False, True):
                    own = np.flatnonzero((to != entry) == moved)
                    chunks += _chunks(position, to[own], np.full(len(own), salt), rows[own], x[own], moved)
            if chunks:
                yield _batch(chunks)

    state = stored(reduce(DataFrame.unionByName, residents).mapInArrow(look, _MEMBERS))
    for table in residents:
        discard(table)
    return [state, _arrived(state.where("moved"), partitions)]


def codebooks(kept: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """``[part, entry, component]`` after ``rounds`` of Lloyd over all vectors of ``quantised``."""
    books = first_entries(kept, entries, parts)
    n = kept.count()
    if not n or not rounds:
        return books
    salts = math.ceil(n / _PER_OWNER)
    size = n * parts * (books.shape[2] + 1) * 8
    partitions = max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / _PARTITION))
    residents = [place(kept, books, salts, partitions)]
    for last in range(rounds - 1, -1, -1):
        books = updated(residents, books)
        if last:
            here = reassigned(residents, books, partitions)
            residents = [here[0].where("NOT moved"), here[1]]
            residents[0]._stored_at = here[0]._stored_at
    for table in residents:
        discard(table)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``. The last assignment moves nobody, so it runs where the vectors are."""
    width = books.shape[2]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2)).astype(np.int64)
            found = np.empty((len(x), len(books)), np.int64)
            error = np.zeros(len(x), np.int64)
            for position, entries in enumerate(books):
                found[:, position], distance = nearest(x[:, position * width : (position + 1) * width], entries)
                error += distance
            digits = max(2, len(f"{books.shape[1] - 1:x}"))
            code = pa.array(["".join(f"{i:0{digits}x}" for i in row) for row in found.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    return kept.select("vec_id", "label", "values").mapInArrow(codes, schema)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks by part, entry and component, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, value: str = "embedding", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every vector that is kept.

    ``vectors`` has ``vec_id``, ``label`` and the column ``value``; others are ignored. Rows
    whose vector is null, empty or holds a null or non-finite component are left out, as
    are rows with another number of components than most have. Repeated ids, also missing
    ones, are rows of their own; missing ids are the largest. With fewer vectors than
    ``entries`` the codebooks are so much smaller. An empty table gives an empty result.
    Raises if the components cannot be cut into ``parts`` or exceed 2**27 after scaling.
    """
    kept = quantised(vectors, value, scale)
    books = codebooks(kept, entries, parts, rounds)
    coded = stored(encode(kept, books))
    discard(kept)
    totals = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    few = totals.count() <= _LABELS
    sums = totals.withColumnRenamed("label", "_of")
    # Beyond that size the join is left to Spark, which splits the partitions of a frequent label.
    joined = coded.join(F.broadcast(sums) if few else sums, coded["label"].eqNullSafe(sums["_of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
