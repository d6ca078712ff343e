"""Ranked lexical search: the best documents of every query, by MaxScore with bounds on pairs of terms.

The index is made of shards, each with the postings of a few MB of text. For a block of
queries a shard's impact lists are derived: for every query term the documents that hold it
with what the term adds to their score, and, for pairs of terms of one query, the largest
sum that a document holding both reaches. Where few documents hold both, the list of
those documents is kept as well.

A query then reads a shard as follows. Its terms are paired, so that a pair adds at most
the largest of its joint maximum and the maxima of either term alone, which is often much
less than the sum of the two maxima. Pairs are taken in the order of these bounds; the
first of them that together stay below the score needed need not be scanned for new
documents, and what is known of a document plus the bounds of the pairs not yet looked at
decides whether it is followed any further. A pair's list answers for both terms at once,
and a document that is not in it has at most the larger maximum to gain.

The score needed is at first the k-th best of some shards, then rises with what a task
has found. It never exceeds the k-th best of all, so no result is lost, and tasks return
little more than the results themselves. Scores are whole numbers.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from anchorwake.llm.store import discard, stored
from anchorwake.llm.texts import NOT_ALPHANUMERIC, Slice, slices, words

K = 20
_SHARD = 2 << 20  # bytes of text of a shard, or one text if that is longer
_BLOCK = 1 << 19  # terms of the queries that one pass over the index answers
_SEEDS = 1 / 32  # share of the shards that give the first scores needed
_SPREAD = 64  # first rankings of one query's results
_ONE = 1_000_000_000


# ------------------------------------------------------------------ index


def _index_schema(doc_id: T.DataType) -> T.StructType:
    lists = {"ids": doc_id, "lengths": T.LongType(), "terms": T.LongType(), "held": T.IntegerType(), "docs": T.IntegerType(), "times": T.IntegerType()}
    return T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in lists.items()])


def term_counts(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each row of a slice: term, row and number of times, by term; and all terms of each row.

    Terms are runs of ASCII letters, digits and all other characters beyond ASCII, known by a 64-bit hash.
    """
    w = words(s, breaks=NOT_ALPHANUMERIC)
    lengths = np.diff(w.offs)
    rows = np.repeat(np.arange(s.rows), lengths)
    order = np.argsort(w.hash, kind="stable")  # rows of a term stay in order
    terms, rows = w.hash[order].view(np.int64), rows[order]
    new = np.append(True, (terms[1:] != terms[:-1]) | (rows[1:] != rows[:-1])) if len(terms) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return terms[first], rows[first], np.diff(first, append=len(terms)), lengths


def index_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """The index, stored: a row per shard, with the documents of at least one term in the order of their ids.

    ``ids, lengths`` of the documents, ``terms, held`` and, one after the other, the postings ``docs, times``
    of the terms. A file holds one shard: a task that reads several gathers them in one Arrow batch.
    """
    schema = _index_schema(docs.schema["doc_id"].dataType)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            ids = batch.column(0)
            for s in slices(batch.column(1)):
                shard.add(ids.slice(s.first, s.rows), s)
                if shard.size >= _SHARD:
                    yield from shard.rows(schema)
                    shard = _Shard()
        yield from shard.rows(schema)

    return stored(docs.select("doc_id", F.col(f"`{text}`").alias("text")).mapInArrow(build, schema), rows_per_file=1)


class _Shard:
    """A shard while it is gathered."""

    def __init__(self):
        self.size, self._ids, self._lengths, self._parts, self._docs = 0, [], [], [], 0

    def add(self, ids: pa.Array, s: Slice) -> None:
        terms, rows, times, lengths = term_counts(s)
        self._parts.append((terms, rows + self._docs, times))
        self._ids.append(ids)
        self._lengths.append(lengths)
        self._docs += s.rows
        self.size += len(s.data)

    def rows(self, schema: T.StructType) -> Iterator[pa.RecordBatch]:
        if not self._docs or not any(length.any() for length in self._lengths):
            return
        lengths, ids = np.concatenate(self._lengths), pa.concat_arrays(self._ids)
        order = np.asarray(pc.array_sort_indices(ids, null_placement="at_end"))
        order = order[lengths[order] > 0]
        number = np.full(len(lengths), -1)
        number[order] = np.arange(len(order))
        terms, docs, times = (np.concatenate(c) for c in zip(*self._parts, strict=True))
        by = np.lexsort((number[docs], terms))
        terms, docs, times = terms[by], number[docs[by]], times[by]
        first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        columns = [ids.take(pa.array(order)), lengths[order], terms[first], np.diff(first, append=len(terms)), docs, times]
        yield _one_row(columns, schema)


def _one_row(columns: list, schema: T.StructType) -> pa.RecordBatch:
    arrays = []
    for field, values in zip(schema.fields, columns, strict=True):
        kind = to_arrow_type(field.dataType.elementType)
        values = values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(arrays, schema.names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a table of lists: the first column as Arrow values, the others as arrays."""
    for batch in batches:
        for i in range(batch.num_rows):
            lists = [c[i].values for c in batch.columns]
            yield lists[0], *(np.asarray(x) for x in lists[1:])


# ------------------------------------------------------------------ queries


class Corpus(NamedTuple):
    """Documents with a term, and all their terms with repeats."""

    docs: int
    terms: int


def corpus_counts(index: DataFrame) -> Corpus:
    n, terms = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
    return Corpus(n or 0, terms or 0)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """``query, item, terms, repeats``: one row per query, stored; queries without a term are left out."""
    kind = queries.schema[key].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("repeats", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                terms, rows, times, lengths = term_counts(s)
                full = np.flatnonzero(lengths)
                own = [np.flatnonzero(rows == row) for row in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, s.rows).take(pa.array(full)),
                        pa.array([terms[i] for i in own], pa.list_(pa.int64())),
                        pa.array([times[i] for i in own], pa.list_(pa.int64())),
                    ],
                    schema.names,
                )

    found = queries.select(F.col(f"`{key}`").alias("item"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, schema)
    return stored(found.withColumn("query", F.monotonically_increasing_id()))


def frequencies(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``term, df``: the documents that hold each term of the queries."""
    wanted = queries.select(F.explode("terms").alias("term")).distinct()
    held = index.select(F.inline(F.arrays_zip("terms", "held"))).withColumnRenamed("terms", "term")
    return held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))


class Query(NamedTuple):
    """A query: its number and id, its terms as (term, weight times repeats), and pairs of places among them."""

    number: int
    item: Any
    terms: list[tuple[int, int]]
    pairs: list[tuple[int, int]]


def _query(row, corpus: Corpus) -> Query:
    terms = []
    for term, df, repeats in row.found:
        weight = math.floor(1000 * math.log((2 * corpus.docs + 2) / (2 * df + 1)))
        if weight > 0:
            terms.append((term, weight, repeats))
    # Terms of like weight make the best pairs: at most the smaller maximum can be saved.
    terms.sort(key=lambda t: (-t[1] * t[2], t[0]))
    pairs = [(i, i + 1) for i in range(0, len(terms) - 1, 2)]
    return Query(row.query, row.item, [(t, w * r) for t, w, r in terms], pairs)


def _blocks(queries: DataFrame, df: DataFrame, corpus: Corpus) -> Iterator[list[Query]]:
    """The queries with the weights of their terms, in blocks of bounded size; one block at a time is on the driver."""
    each = queries.select("query", "item", F.inline(F.arrays_zip("terms", "repeats"))).withColumnRenamed("terms", "term")
    found = (
        each.join(df, "term")
        .groupBy("query")
        .agg(F.any_value("item").alias("item"), F.sort_array(F.collect_list(F.struct("term", "df", "repeats"))).alias("found"))
    )
    found = stored(found)
    block, size = [], 0
    for row in found.toLocalIterator():
        block.append(_query(row, corpus))
        size += len(row.found)
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block
    discard(found)


# ------------------------------------------------------------------ impact lists


def _impact_schema(doc_id: T.DataType) -> T.StructType:
    lists = {
        "ids": doc_id, "terms": T.IntegerType(), "ends": T.IntegerType(), "docs": T.IntegerType(), "impacts": T.LongType(),
        "pairs": T.IntegerType(), "joint": T.LongType(), "pair_ends": T.IntegerType(), "pair_docs": T.IntegerType(), "pair_impacts": T.LongType(),
    }
    return T.StructType([T.StructField(n, T.ArrayType(t)) for n, t in lists.items()])


class Lists(NamedTuple):
    """What the queries of a block need: weighted terms and pairs of them, each once."""

    terms: list[tuple[int, int]]  # term, weight times repeats
    pairs: list[tuple[int, int]]  # places among terms
    term_of: list[list[int]]  # by query: places of its terms
    pair_of: list[list[int]]  # by query: places of its pairs

    @classmethod
    def of(cls, block: list[Query]) -> Lists:
        terms: dict = {}
        pairs: dict = {}
        term_of, pair_of = [], []
        for q in block:
            own = [terms.setdefault(t, len(terms)) for t in q.terms]
            term_of.append(own)
            pair_of.append([pairs.setdefault((own[a], own[b]), len(pairs)) for a, b in q.pairs])
        return cls(list(terms), list(pairs), term_of, pair_of)


def impact_lists(index: DataFrame, lists: Lists, corpus: Corpus) -> DataFrame:
    """The shards' impact lists for the terms and pairs of a block of queries, stored."""
    schema = _impact_schema(index.schema["ids"].dataType.elementType)
    hashes = np.array([t for t, _ in lists.terms], np.int64)
    weights = np.array([w for _, w in lists.terms], np.int64)

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lengths, terms, held, docs, times in _rows(batches):
            m = _norms(lengths, corpus)
            at = np.searchsorted(terms, hashes)
            here = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == hashes)
            begin = np.append(0, np.cumsum(held))
            shares = (_ONE * times.astype(np.int64)) // (1000 * times.astype(np.int64) + 12 * m[docs])
            of = {}
            for t in here.tolist():
                own = slice(begin[at[t]], begin[at[t] + 1])
                of[t] = docs[own], shares[own] * weights[t]
            if not of:
                continue
            joint, kept = _pairs(of, lists.pairs, len(lengths))
            none = (np.zeros(0, np.int32), np.zeros(0, np.int64))
            met = [kept.get(p, none) for p in joint]
            yield _one_row(
                [
                    ids, here, np.cumsum([len(d) for d, _ in of.values()]),
                    np.concatenate([d for d, _ in of.values()]), np.concatenate([i for _, i in of.values()]),
                    # A pair whose list is not kept ends at -1.
                    list(joint), list(joint.values()),
                    [end if p in kept else -1 for p, end in zip(joint, np.cumsum([len(d) for d, _ in met]), strict=True)],
                    np.concatenate([none[0], *(d for d, _ in met)]), np.concatenate([none[1], *(i for _, i in met)]),
                ],
                schema,
            )

    return stored(index.mapInArrow(derive, schema), rows_per_file=1)


def _norms(lengths: np.ndarray, corpus: Corpus) -> np.ndarray:
    if int(lengths.max()) * 25 * corpus.docs < 1 << 63:
        return 75 + (25 * lengths * corpus.docs) // corpus.terms
    return np.array([75 + 25 * int(n) * corpus.docs // corpus.terms for n in lengths], np.int64)


def _pairs(of: dict, pairs: list[tuple[int, int]], n: int) -> tuple[dict, dict]:
    """The largest joint impact of each pair of terms that are both in the shard, and the short lists of both."""
    joint, kept = {}, {}
    place = np.full(n, -1)
    for p, (a, b) in enumerate(pairs):
        if a in of and b in of:
            (one, x), (two, y) = of[a], of[b]
            place[one] = np.arange(len(one))
            met = place[two]
            both = np.flatnonzero(met >= 0)
            place[one] = -1
            total = x[met[both]] + y[both]
            joint[p] = int(total.max(initial=0))
            if 4 * len(both) <= len(one) + len(two):
                kept[p] = two[both], total
    return joint, kept


# ------------------------------------------------------------------ search


class Unit(NamedTuple):
    """Terms that are bound together: one or two lists, the most they add, the most one of them adds alone, and who holds both."""

    bound: int
    alone: int
    lists: list[tuple[np.ndarray, np.ndarray]]
    both: tuple[np.ndarray, np.ndarray] | None


def units(terms: list[int], pairs: list[tuple[int, int, int]], of: dict, joint: dict, kept: dict) -> list[Unit]:
    """The lists of a query that the shard has, paired, by ascending bound."""
    out, free = [], set(terms)
    for p, a, b in pairs:
        if p in joint:
            alone = max(int(of[a][1].max()), int(of[b][1].max()))
            out.append(Unit(max(joint[p], alone), alone, [of[a], of[b]], kept.get(p)))
            free -= {a, b}
    for t in free:
        if t in of:
            most = int(of[t][1].max())
            out.append(Unit(most, most, [of[t]], None))
    return sorted(out, key=lambda u: u.bound)


def best(query: list[Unit], n: int, k: int, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard and their scores: all that can be among the ``k`` best and reach ``needed``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    needed = max(needed, 1)
    up_to = np.cumsum([u.bound for u in query])
    if not len(up_to) or up_to[-1] < needed:
        return none
    first = int(np.searchsorted(up_to, needed))  # units before it do not suffice by themselves
    score = np.zeros(n, np.int64)
    for u in query[first:]:
        for docs, impacts in u.lists:
            score[docs] += impacts
    found = np.flatnonzero(score)
    for i in range(first - 1, -1, -1):
        if len(found) >= k:
            needed = max(needed, int(np.partition(score[found], -k)[-k]))
        found = found[score[found] + up_to[i] >= needed]
        if not len(found):
            return none
        u, rest = query[i], int(up_to[i - 1]) if i else 0
        ask = found
        if u.both is not None:
            docs, impacts = u.both
            at = _places(docs, found)
            ask = found[at < 0]
            score[found[at >= 0]] += impacts[at[at >= 0]]
            # Who is not in the list gains from one term at most.
            ask = ask[score[ask] + (u.alone + rest) >= needed]
            found = np.sort(np.concatenate([found[at >= 0], ask]))
        for docs, impacts in u.lists:
            at = _places(docs, ask)
            score[ask[at >= 0]] += impacts[at[at >= 0]]
    found = found[score[found] >= needed]
    # Documents are numbered in the order of their ids, so equal scores keep that order.
    found = found[np.argsort(-score[found], kind="stable")][:k]
    return found, score[found]


def _places(docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted document stands in a sorted list, or -1."""
    if not len(docs):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, at, -1)


def _search(impacts: DataFrame, block: list[Query], lists: Lists, k: int, needed: dict[int, int]) -> DataFrame:
    """``query, doc_id, score``: the candidates of every task, at most ``k`` per query."""
    kind = impacts.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    plan = [
        (q.number, terms, [(p, *lists.pairs[p]) for p in pairs])
        for q, terms, pairs in zip(block, lists.term_of, lists.pair_of, strict=True)
    ]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        for ids, terms, ends, docs, impact, pairs, joint, pair_ends, pair_docs, pair_impacts in _rows(batches):
            starts = np.append(0, ends[:-1])
            of = {t: (docs[a:b], impact[a:b]) for t, a, b in zip(terms.tolist(), starts, ends, strict=True)}
            most = dict(zip(pairs.tolist(), joint.tolist(), strict=True))
            kept, begin = {}, 0
            for p, end in zip(pairs.tolist(), pair_ends.tolist(), strict=True):
                if end >= 0:
                    kept[p] = pair_docs[begin:end], pair_impacts[begin:end]
                    begin = end
            for number, own, paired in plan:
                so_far = held[number]
                least = max(needed.get(number, 0), so_far[-1][0] if len(so_far) >= k else 0)
                found, scores = best(units(own, paired, of, most, kept), len(ids), k, least)
                if len(found):
                    so_far += zip(scores.tolist(), ids.take(pa.array(found)).to_pylist(), strict=True)
                    so_far.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
                    del so_far[k:]
        rows = [(number, doc, score) for number, some in held.items() for score, doc in some]
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], schema.names)

    return impacts.mapInArrow(look, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query, with ``rank``; slices of the documents are ranked first."""
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    piece = F.pmod(F.xxhash64("doc_id", "score"), F.lit(_SPREAD))
    first = found.withColumn("_piece", piece).withColumn("rank", F.row_number().over(Window.partitionBy("query", "_piece").orderBy(*by)))
    return first.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*by))).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = K, key: str = "item_id", text: str = "text") -> DataFrame:
    """``<key>, rank, doc_id, score``: the ``k`` best documents of every row of ``queries`` in a stored index.

    Ranks count from 1; of equal scores the smaller document id comes first, a missing one last.
    Rows of one id are queries of their own; documents of one id are documents of their own.
    A query without a term, or none of whose terms is in the index, has no row.
    Other columns are ignored.
    """
    spark = index.sparkSession
    doc_id, item = index.schema["ids"].dataType.elementType, queries.schema[key].dataType
    empty = T.StructType([T.StructField(key, item), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_id), T.StructField("score", T.LongType())])
    corpus = corpus_counts(index)
    if not corpus.docs:
        return spark.createDataFrame([], empty)
    asked = query_terms(queries, key, text)
    df = stored(frequencies(index, asked))
    results = []
    for block in _blocks(asked, df, corpus):
        lists = Lists.of(block)
        impacts = impact_lists(index, lists, corpus)
        seeds = _ranked(_search(impacts.sample(_SEEDS, 11), block, lists, k, {}), k).where(F.col("rank") == k)
        needed = {r.query: r.score for r in seeds.select("query", "score").collect()}  # one number per query of the block
        results.append(stored(_ranked(_search(impacts, block, lists, k, needed), k)))
        discard(impacts)
    if not results:
        return spark.createDataFrame([], empty)
    named = reduce(DataFrame.unionByName, results).join(asked.select("query", F.col("item").alias(key)), "query")
    found = stored(named.select(key, "rank", "doc_id", "score"))
    for table in (asked, df, *results):
        discard(table)
    return found


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score``: ``search`` over an index of ``docs`` (``doc_id, text``) for ``item_id, text``.

    Null and empty texts hold no term: such documents count nowhere and such items have no row.
    """
    index = index_terms(docs)
    found = search(index, queries, k)
    discard(index)
    return found
