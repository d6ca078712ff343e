"""Best-fit packing of documents into sequences of fixed length, with conflicts.

A document takes a token for every ``chars_per_token`` characters (code points) and one
that ends it. What exceeds a sequence is cut off in pieces that fill sequences of their
own; the rest is packed. Rests are dealt into blocks of bounded size by hash, so that a
source with a third of all documents is spread over all blocks, and every block is packed
by one task, largest first.

Open bins are ordered by the room they have left. Each carries a bitmap of the sources and
one of the duplicate clusters in it. The search begins at the smallest room that holds the
piece and goes on to the next larger one until a bin has neither its source nor its
cluster; only if there is none is a bin opened. Bins with the same room and the same
sources are held together, so that a frequent source skips them at once.

Defined results: null and empty texts take the one end token; a null source is a source;
rows are never dropped, repeated rows are pieces of one duplicate cluster; other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "bin_id long, doc_id long, piece int, begin long, end long, n_tokens int, source string, cluster long"


class Bins:
    """Open bins of one block, by room left and by the sources they hold."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.opened = 0
        self._rooms = 0  # bit r: there is a bin with room r
        self._by_room: dict[int, dict[int, list]] = {}

    def place(self, size: int, source: int, cluster: int) -> int:
        """Number of the tightest bin without ``source`` and ``cluster`` (bitmaps of one bit or none)."""
        rooms = self._rooms >> size
        room = size
        while rooms:
            skip = (rooms & -rooms).bit_length() - 1
            room += skip
            groups = self._by_room[room]
            for sources, bins in groups.items():
                if sources & source:
                    continue
                for k in range(len(bins) - 1, -1, -1):
                    if not bins[k][1] & cluster:
                        number, clusters = bins[k]
                        bins[k] = bins[-1]
                        bins.pop()
                        if not bins:
                            del groups[sources]
                            if not groups:
                                del self._by_room[room]
                                self._rooms &= ~(1 << room)
                        self._put(room - size, number, sources | source, clusters | cluster)
                        return number
            rooms >>= skip + 1
            room += 1
        number = self.opened
        self.opened += 1
        self._put(self.capacity - size, number, source, cluster)
        return number

    def whole(self) -> int:
        """Number of a bin that is filled at once."""
        self.opened += 1
        return self.opened - 1

    def _put(self, room: int, number: int, sources: int, clusters: int) -> None:
        if room:
            self._by_room.setdefault(room, {}).setdefault(sources, []).append((number, clusters))
            self._rooms |= 1 << room


def _pack_block(block: int, rows: list[tuple], capacity: int, per_token: int) -> Iterator[tuple]:
    bins = Bins(capacity)
    several = [c for c, n in Counter(r[3] for r in rows).items() if n > 1]
    bit_of = {c: 1 << k for k, c in enumerate(several)}
    sources: dict = {}
    for doc_id, source, chars, cluster in rows:
        tokens = -(-chars // per_token) + 1
        full, rest = divmod(tokens, capacity)
        for piece in range(full):
            end = min(chars, (piece + 1) * capacity * per_token)
            yield (block << 32) | bins.whole(), doc_id, piece, piece * capacity * per_token, end, capacity, source, cluster
        if rest:
            bit = sources.setdefault(source, 1 << len(sources))
            number = bins.place(rest, bit, bit_of.get(cluster, 0))
            yield (block << 32) | number, doc_id, full, min(chars, full * capacity * per_token), chars, rest, source, cluster


def _packed(capacity: int, per_token: int):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block and size; a block is bounded, and so is what is held."""
        held, block, out = [], None, []
        for row in _then_end(parts):
            if row is None or row[0] != block:
                for made in _pack_block(block, held, capacity, per_token) if held else ():
                    out.append(made)
                    if len(out) == 10_000:
                        yield _batch(out)
                        out = []
                block, held = (row[0] if row else None), []
            if row:
                held.append(row[1:])
        if out:
            yield _batch(out)

    def _then_end(parts):
        for part in parts:
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)
        yield None

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def duplicate_cluster(text: str = "text") -> Column:
    """The cluster of texts that are equal but for case and white space."""
    return F.xxhash64(F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))


def pack(docs: DataFrame, capacity: int = 2048, chars_per_token: int = 4, cluster: Column | None = None, block: int = 20_000) -> DataFrame:
    """Pieces of all documents and their bins: see ``SCHEMA``.

    ``begin`` and ``end`` are characters of the text. No bin holds more than ``capacity``
    tokens, two pieces of one source or two of one duplicate cluster. ``cluster`` is a
    column with the duplicate cluster (by default equal texts), ``block`` the number of
    documents that are packed together on average.
    """
    blocks = max(1, -(-docs.count() // block))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"),
        (duplicate_cluster() if cluster is None else cluster).cast("long").alias("cluster"),
    )
    # Equal rows without an id are dealt by their place, or all of them would share a block.
    own = F.coalesce("doc_id", F.monotonically_increasing_id())
    dealt = rows.select(F.pmod(F.xxhash64(own, "source", "chars", "cluster"), F.lit(blocks)).alias("block"), "*")
    rest = F.pmod(F.ceil(F.col("chars") / chars_per_token) + 1, F.lit(capacity))
    sent = dealt.repartition("block").sortWithinPartitions("block", rest.desc(), "doc_id", "source", "cluster")
    return sent.mapInArrow(_packed(capacity, chars_per_token), SCHEMA)
