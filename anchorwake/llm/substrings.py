"""Removal of repeated byte strings by prefix-free parsing.

A trigger is a place whose next 16 bytes have a hash below a bound, so it depends on the
content alone. The triggers cut every text into phrases, each of which runs from one
trigger to the end of the next; no phrase is a prefix of another. The distinct phrases are
the dictionary, a text's sequence of phrases is its parse.

Whether the ``width`` bytes at a place also start elsewhere is a question about neighbours
in corpus order, the order of all suffixes. In it a suffix is a suffix of a dictionary
phrase followed by a suffix of the parse. Suffixes need to be told apart up to ``width``
bytes only, and no result depends on which of two different ones comes first, so both
suffix arrays are kept as buckets of suffixes equal up to that depth, found by shuffles on
hashes instead of by one global sort:

1. *Dictionary.* Phrases that occur once cannot lie in a repeated string. The others go on.
2. *Suffixes of the parse.* Where a place's phrase, the one before it and those that follow
   up to ``width`` bytes occur together elsewhere, all strings that start in the phrase
   before are settled at once.
3. *Dictionary suffixes before the parse.* What is left lies at the edges of repeated
   passages. Each of its strings is compared by its own hash (with 16 bytes of its content
   beside), against each other and against one example of every settled bucket that
   shares the phrase.

Records travel in packed columns (see ``blobs``). A value that a task holds very often is
known to be repeated, so the task sends it once and its places elsewhere: the records of a
very common phrase are bounded by the number of tasks. Strings with less than two triggers
are compared as in step 3 after the filter of step 1.

Defined results: null counts as empty; texts shorter than ``width`` keep all; rows with
the same id (or none) are documents of their own, found again by a hash of id and text,
and equal ones are copies of each other; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorwake.llm.blobs import SCHEMA, buckets, by_key, deal, exchanged, partitions, per_key
from anchorwake.llm.store import stored
from anchorwake.llm.texts import U64, Slice, batches, mix, prefix_sums, range_hash, signed, slices

WORD = 16  # bytes that decide on a trigger
SPACING = 26  # mean distance of triggers
_CHUNK = 12 << 20  # bytes of text that a task counts together
_OFTEN = 64  # records of one value that a task sends one by one
_NO_BOUND, _ONE = -1, -2  # of a string to compare: no phrase after it is known to be unique; it has no phrase


def _windows(data: np.ndarray) -> np.ndarray:
    """A hash of the bytes at each place that decide on a trigger."""
    n = max(0, len(data) - WORD + 1)
    if not n:
        return np.zeros(0, U64)
    halves = np.ndarray((n + 8,), "<u8", np.ascontiguousarray(data), strides=(1,)) * U64(0x9E3779B97F4A7C15)
    return mix(halves[:n] ^ ((halves[8:] >> U64(29)) * U64(0xD6E8FEB86659FD93) + halves[8:]))


class Parse:
    """Triggers and phrases of a slice; ``width`` is the length of the strings to compare."""

    def __init__(self, s: Slice, width: int, spacing: int):
        self.s, self.width, self.span = s, width, width - WORD
        self.hashes = _windows(s.data)
        self.sums = prefix_sums(self.hashes)
        at = np.flatnonzero(self.hashes < U64((1 << 64) // spacing - 1))
        row = np.searchsorted(s.offs, at, "right") - 1
        inside = at + WORD <= s.offs[row + 1]
        self.at, self.row = at[inside], row[inside]

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, row, and place and length (in one value) of every phrase that fits in a string."""
        at, row = self.at, self.row
        if len(at) < 2:
            none = np.zeros(0, np.int64)
            return none.view(U64), none, none
        gap = at[1:] - at[:-1]
        fits = np.flatnonzero((row[1:] == row[:-1]) & (gap <= self.span))
        begin, gap, row = at[:-1][fits], gap[fits], row[:-1][fits]
        value = mix(range_hash(self.sums, begin, begin + gap + 1) + gap.astype(U64))
        return value, row, (begin - self.s.offs[row]) << 8 | gap

    def bare(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the strings with less than two triggers, and their rows."""
        n = len(self.s.data) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = np.zeros(len(self.s.data) + 1, np.int32)
        seen[self.at + 1] = 1
        np.cumsum(seen, out=seen)
        last = self.span + 1
        few = seen[last : last + n] - seen[:n] < 2
        for begin, end in zip(self.s.offs[:-1], self.s.offs[1:], strict=True):
            few[max(begin, end - self.width + 1) : end] = False
        at = np.flatnonzero(few)
        return at, np.searchsorted(self.s.offs, at, "right") - 1

    def strings(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and check value of the strings at these places."""
        ends = self.hashes[at + self.span]
        return mix(range_hash(self.sums, at, at + self.span + 1)), self.hashes[at] ^ ((ends << U64(1)) | (ends >> U64(63)))

    def asked(self, row: np.ndarray, place: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the strings that are entered at these triggers (see ``_NO_BOUND``)."""
        offs, at = self.s.offs, self.at
        here = offs[row] + place
        low, high = here.copy(), here.copy()
        k = np.flatnonzero(bound != _ONE)
        if len(k):
            j = np.searchsorted(at, here[k])
            before = np.where((j > 0) & (self.row[j - 1] == row[k]), at[j - 1] + 1, offs[row[k]])
            low[k] = np.maximum(before, at[j + 1] - self.span)
        k = np.flatnonzero(bound >= 0)
        if len(k):
            # The phrase after ``bound`` occurs once, so no repeated string holds all of it.
            end = offs[row[k]] + bound[k]
            j = np.minimum(np.searchsorted(at, end) + 1, len(at) - 1)
            whole = (at[j] > end) & (self.row[j] == row[k]) & (at[j] - end <= self.span)
            high[k] = np.where(whole, np.minimum(high[k], at[j] - self.span - 1), high[k])
        return low, np.minimum(high, offs[row + 1] - self.width)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, whether a row of that order is the first of its group, and sizes of the groups of all."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    return order, new, np.repeat(size, size)


def _spread(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix(ids.view(U64) + mix(place.view(U64)))


def _phrase_records(width: int, spacing: int, parts: int):
    """Phrases and bare strings of all texts, dealt by hash: ``0`` hash, id, place; ``1`` hash of one that is frequent
    here; ``2`` hash, id, place of its records, dealt by place."""

    def phrases(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, "text", _CHUNK):
            keys, ids, places = [], [], []
            for batch in table.to_batches():
                own = batch.column(0).to_numpy(zero_copy_only=False)
                for s in slices(batch.column(1)):
                    if len(s.data) < width:
                        continue
                    parse = Parse(s, width, spacing)
                    value, row, place = parse.phrases()
                    bare, bare_row = parse.bare()
                    keys += [value, parse.strings(bare)[0] if len(bare) else bare.view(U64)]
                    ids += [own[s.first + row], own[s.first + bare_row]]
                    places += [place, (bare - s.offs[bare_row]) << 8]
            if not keys:
                continue
            k, i, at = np.concatenate(keys), np.concatenate(ids).astype(np.int64), np.concatenate(places)
            order, new, size = _grouped(k)
            few, often = order[size <= _OFTEN], order[size > _OFTEN]
            mark = k[order[new & (size > _OFTEN)]]
            yield from deal(
                parts,
                [
                    by_key(0, k[few], parts, k[few], i[few], at[few]),
                    by_key(1, mark, parts, mark),
                    by_key(2, _spread(i[often], at[often]), parts, k[often], i[often], at[often]),
                ],
            )

    return phrases


def _repeated_phrases(parts: int):
    """The records whose value occurs more than once, dealt by id: ``0`` id, place, hash."""

    def repeated_phrases(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets(rows):
            k, ids, at = records.of(0, 3)
            (marks,) = records.of(1, 1)
            order, _, size = _grouped(k)
            kept = order[size > 1]
            alone = order[size == 1]
            kept = np.concatenate([kept, alone[np.isin(k[alone], marks)]])
            more = records.of(2, 3)
            k, ids, at = (np.concatenate([x[kept], y]) for x, y in zip((k, ids, at), more, strict=True))
            yield from deal(parts, [by_key(0, ids, parts, ids, at, k)])

    return repeated_phrases


def _bucket_records(width: int, parts: int):
    """Places by the parse suffix they are entered at, dealt by its hash.

    ``0``: bucket of parse suffixes, phrase at its entry, id, and place with the number of strings before it;
    ``1``: id, place, bound of strings to be compared one by one, dealt by id, and ``4`` the phrases of their
    entries; ``2``: as 0, an example of a bucket that is frequent here; ``3``: id and place of its others.
    """
    span = width - WORD

    def parse_suffixes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets(rows):
            ids, at, h = records.of(0, 3)
            order = np.lexsort((at, ids))
            ids, h, place, length = ids[order], h[order], at[order] >> 8, at[order] & 255
            bare = length == 0
            n = int(bare.sum())
            alone = by_key(1, ids[bare], parts, ids[bare], place[bare], np.full(n, _ONE, np.int64))
            ids, h, place, length = (x[~bare] for x in (ids, h, place, length))
            if not len(ids):
                yield from deal(parts, [alone])
                continue
            end, k = place + length, np.arange(len(ids))
            follows = np.zeros(len(ids), bool)
            follows[1:] = (ids[1:] == ids[:-1]) & (end[:-1] == place[1:])
            run_of = np.cumsum(~follows)
            last = np.append(np.flatnonzero(~follows)[1:] - 1, len(ids) - 1)[run_of - 1]
            # The phrase that ends the strings entered here, if it is in the run of repeated ones.
            to = np.searchsorted((run_of << 33) + end, (run_of << 33) + place + span)
            settled = follows & (to <= last)
            sums = prefix_sums(mix(h.view(U64)))
            in_ = k[settled]
            e = mix(range_hash(sums, in_ - 1, to[in_] + 1) + (to[in_] - in_).astype(U64))
            before = place[in_] - np.maximum(place[in_ - 1] + 1, end[in_] - span)
            own, value, a = ids[in_], place[in_] << 8 | before, h[in_]
            order, new, size = _grouped(e)
            few = order[size <= _OFTEN]
            often = size > _OFTEN
            mark, rest = order[new & often], order[~new & often]
            out = k[~settled]
            entries = np.unique(h[out])
            yield from deal(
                parts,
                [
                    alone,
                    by_key(0, e[few], parts, e[few], a[few], own[few], value[few]),
                    by_key(1, ids[out], parts, ids[out], place[out], end[last[out]]),
                    by_key(2, e[mark], parts, e[mark], a[mark], own[mark], value[mark]),
                    by_key(3, _spread(own[rest], value[rest]), parts, own[rest], value[rest]),
                    by_key(4, entries, parts, entries),
                ],
            )

    return parse_suffixes


def _settled(parts: int):
    """``data``: ``0`` id, place of settled strings, dealt by id; ``asked``: ``1`` id, place, bound to compare, dealt by
    id; ``entries``: ``2`` phrase, id, place of an example of each settled bucket and ``3`` phrases of strings to
    compare, dealt by phrase."""

    def settled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets(rows):
            e, a, ids, value = (np.concatenate(x) for x in zip(records.of(2, 4), records.of(0, 4), strict=True))
            sure = np.zeros(len(e), np.int64)
            sure[: len(records.of(2, 1)[0])] = 1
            # The frequent ones first in their groups.
            order = np.lexsort((1 - sure, e))
            new = np.ones(len(e), bool)
            new[1:] = e[order][1:] != e[order][:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(e)))
            held = np.repeat((size > 1) | (sure[order][first] > 0), size) if len(e) else np.zeros(0, bool)
            done, example, open_ = order[held], order[held & new], order[~held]
            more = records.of(3, 2)
            i, v = np.concatenate([ids[done], more[0]]), np.concatenate([value[done], more[1]])
            old = records.of(1, 3)
            q = np.concatenate([ids[open_], old[0]])
            p = np.concatenate([value[open_] >> 8, old[1]])
            r = np.concatenate([np.full(len(open_), _NO_BOUND, np.int64), old[2]])
            entries = np.unique(np.concatenate([a[open_], records.of(4, 1)[0]]))
            yield from deal(
                parts,
                [by_key(0, i, parts, i, v)],
                asked=[by_key(1, q, parts, q, p, r)],
                entries=[by_key(2, a[example], parts, a[example], ids[example], value[example] >> 8), by_key(3, entries, parts, entries)],
            )

    return settled


def _examples(parts: int):
    """Examples of settled buckets that share a phrase with strings to compare, as such: ``1`` id, place, bound."""

    def examples(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets(rows):
            a, ids, place = records.of(2, 3)
            met = np.isin(a, records.of(3, 1)[0])
            yield from deal(parts, [by_key(1, ids[met], parts, ids[met], place[met], np.full(int(met.sum()), _NO_BOUND, np.int64))])

    return examples


def _questions(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: ``id`` and the places and bounds to compare."""
    for records in buckets(rows):
        ids, place, bound = records.of(1, 3)
        yield from per_key(ids, [place, bound], "asked")


def _string_records(width: int, spacing: int, parts: int):
    """Strings to compare, dealt by hash: ``0`` hash, check, id, place; ``1`` hash, check of one that is frequent here;
    ``2`` id, place of its records, dealt by place."""

    def strings(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, "text", _CHUNK):
            found: list[tuple] = []
            for batch in table.to_batches():
                own = batch.column(0).to_numpy(zero_copy_only=False)
                asked = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in batch.column(2)]
                for s in slices(batch.column(1)):
                    if len(s.data) < width:
                        continue
                    mine = asked[s.first : s.first + s.rows]
                    row = np.repeat(np.arange(s.rows), [x.shape[1] for x in mine])
                    place, bound = np.concatenate(mine, axis=1)
                    parse = Parse(s, width, spacing)
                    low, high = parse.asked(row, place, bound)
                    many = np.maximum(0, high - low + 1)
                    at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    owner = np.repeat(row, many)
                    if len(at):
                        found.append((*parse.strings(at), own[s.first + owner], at - s.offs[owner]))
            if not found:
                continue
            k, c, ids, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order, new, size = _grouped(c, k)
            few, often = order[size <= _OFTEN], order[size > _OFTEN]
            mark = order[new & (size > _OFTEN)]
            yield from deal(
                parts,
                [
                    by_key(0, k[few], parts, k[few], c[few], ids[few], at[few]),
                    by_key(1, k[mark], parts, k[mark], c[mark]),
                    by_key(2, _spread(ids[often], at[often]), parts, ids[often], at[often]),
                ],
            )

    return strings


def _repeated_strings(parts: int):
    """Places of the strings that occur more than once, dealt by id: ``0`` id, place."""

    def repeated_strings(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets(rows):
            k, c, ids, at = records.of(0, 4)
            marks = records.of(1, 2)  # count twice, as they stand for several
            k, c = np.concatenate([k, marks[0], marks[0]]), np.concatenate([c, marks[1], marks[1]])
            order, _, size = _grouped(c, k)
            kept = order[(size > 1) & (order < len(ids))]
            i, p = np.concatenate([ids[kept], records.of(2, 2)[0]]), np.concatenate([at[kept], records.of(2, 2)[1]])
            yield from deal(parts, [by_key(0, i, parts, i, p << 8)])

    return repeated_strings


def _spans(width: int):
    """One row per document: ``id`` and begins and ends of the runs to remove."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets(rows):
            ids, value = records.of(0, 2)
            if len(ids):
                begin, end = (value >> 8) - (value & 255), (value >> 8) + width
                order = np.lexsort((begin, ids))
                ids, begin, end = ids[order], begin[order], end[order]
                # Runs of all documents at once: every document has a range of its own.
                base = np.cumsum(np.append(0, ids[1:] != ids[:-1])) << 40
                begin, end = merged(base + begin, base + end)
                owner = ids[np.searchsorted(base, (begin >> 40) << 40)]
                low = (1 << 40) - 1
                yield from per_key(owner, [begin & low, end & low], "spans")

    return run


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, sorted by their begins, as maximal runs."""
    end = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    return begin[first], end[np.append(first[1:], len(begin)) - 1]


def _cleaned(width: int, keep_text: bool):
    """Rows with what is left of each text; a text of ``copies`` rows goes if it has the width."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            out = []
            for text, spans, copies in zip(part.column(1), part.column(2), part.column(3).to_pylist(), strict=True):
                data = text.as_buffer() if text.is_valid else b""
                n = len(data)
                if copies > 1 and n >= width:
                    begin, end = np.array([0]), np.array([n])
                elif spans.is_valid:
                    begin, end = np.frombuffer(spans.as_buffer(), np.int64).reshape(2, -1)
                else:
                    begin = end = np.zeros(0, np.int64)
                view = memoryview(data)
                kept = b"".join(view[a:b] for a, b in zip(np.append(0, end), np.append(begin, n), strict=True))
                out.append((n, int((end - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept)[: len(names) - 1])
            columns = zip(*out, strict=True) if out else [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names)

    return run


def _column(settled: DataFrame, name: str) -> DataFrame:
    return settled.where(F.col(name).isNotNull()).select("bucket", F.col(name).alias("data"))


def remove_repeated(docs: DataFrame, width: int = 200, keep_text: bool = False, spacing: int = SPACING) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts anywhere else.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row, and ``kept``, the
    remaining bytes, if ``keep_text``. ``width`` is at most 200, as lengths are packed in bytes.
    """
    if not 2 * WORD <= width <= 200:
        raise ValueError(f"width must be between {2 * WORD} and 200")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Ids that are all different are shorter keys than hashes; the results are the same.
    twice = rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if twice:
        rows = rows.withColumn("id", F.xxhash64("doc_id", "text"))
        texts = rows.select("id", "text").dropDuplicates(["id"])
    else:
        # Both joins with the texts below have the same input, so they share one shuffle. The other
        # sides grow with the input, so they are not broadcast at any size.
        rows = texts = rows.withColumnRenamed("doc_id", "id").where("id IS NOT NULL")
    parts = partitions(rows)

    phrases = exchanged(texts.mapInArrow(_phrase_records(width, spacing, parts), SCHEMA), parts)
    repeated = exchanged(phrases.mapInArrow(_repeated_phrases(parts), SCHEMA), parts)
    entered = exchanged(repeated.mapInArrow(_bucket_records(width, parts), SCHEMA), parts)
    settled = stored(entered.mapInArrow(_settled(parts), SCHEMA + ", asked binary, entries binary"))

    examples = exchanged(_column(settled, "entries"), parts).mapInArrow(_examples(parts), SCHEMA)
    questions = exchanged(_column(settled, "asked").unionByName(examples), parts).mapInArrow(_questions, "id long, asked binary")
    strings = texts.join(questions.hint("merge"), "id").select("id", "text", "asked").mapInArrow(_string_records(width, spacing, parts), SCHEMA)
    alike = exchanged(strings, parts).mapInArrow(_repeated_strings(parts), SCHEMA)
    spans = exchanged(_column(settled, "data").unionByName(alike), parts).mapInArrow(_spans(width), "id long, spans binary")

    if twice:
        copies = rows.groupBy("id").agg(F.count("*").alias("copies"))
        met = rows.join(spans.hint("merge"), "id", "left").join(copies, "id").select("doc_id", "text", "spans", "copies")
    else:
        met = rows.join(spans.hint("merge"), "id", "left").select(F.col("id").alias("doc_id"), "text", "spans", F.lit(1).cast("long").alias("copies"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return met.mapInArrow(_cleaned(width, keep_text), schema)
