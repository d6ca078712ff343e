"""Exact Jaccard join of the word n-gram sets of documents, and its components.

1. *Sets.* A text becomes the set of hashes of its n-grams. Equal sets have equal
   fingerprints and are joined as one.
2. *Candidates, without loss.* Sets of a size class are cut by hash into more parts than
   two sets that link can differ in, so that some of the parts are the same in both; a
   signature is the hash of one part. Parts that hold only n-grams of which a sample shows
   that many documents have them are left out where that loses nothing. Large clusters are
   divided further by the prefixes of their sets in an order that has rare n-grams first. A task links the sets that share a signature in it
   and sends one of them on, so a signature has one row per task, however common it is.
3. *Signature trees.* The sets of a candidate cluster meet in one group, or a large cluster
   in pairs of blocks. A group numbers its tokens and builds a tree whose nodes hold the
   OR of their sets' token bitmaps and the range of their sizes. A dual traversal leaves out
   pairs of nodes whose largest possible overlap is too small, and pairs that are already
   one component; bitmaps of leaves give the exact overlap. No block is unbounded, and
   blocks that are one component are not compared with each other.
4. *Components* of the links, and of the copies behind each set.

Token and set hashes have 64 and 128 bits. Defined results: a text of fewer words than
``size`` has its whole sequence as its one n-gram; null, empty and blank texts have the
empty set and stand alone; rows with the same id form one node and give one row each;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorwake.llm.blobs import SCHEMA, buckets, by_key, deal, exchanged, partitions
from anchorwake.llm.components import components
from anchorwake.llm.keys import free, keyed
from anchorwake.llm.store import discard, stored
from anchorwake.llm.texts import U64, batches, mix, shingles, slices, words

_CHUNK = 8 << 20  # bytes of text whose signatures a task gathers before it sends them on
_RATIO = 1.5  # of the sizes of a size class
_OFTEN = 64  # records of one n-gram that a task sends one by one
_SHARE = 16  # one of so many documents shows which n-grams are common


def text_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of every text."""
    for s in slices(column):
        grams, offs = shingles(words(s), size)
        for a, b in zip(offs[:-1], offs[1:], strict=True):
            yield np.unique(grams[a:b])


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    one, two = mix(grams).sum(dtype=U64), mix(grams ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64)
    return int(np.int64(one.view(np.int64))), int(np.int64(two.view(np.int64)))


class Threshold:
    """Link when ``over * intersection >= num * union`` (for example 100 and 90)."""

    def __init__(self, num: int = 90, over: int = 100):
        self.num, self.over = num, over

    def links(self, common: int, one: int, two: int) -> bool:
        return self.over * common >= self.num * (one + two - common)

    def differences(self, together: int) -> int:
        """Most tokens by which two linked sets of these sizes together differ."""
        return together * (self.over - self.num) // (self.over + self.num)

    def smallest(self, size: int) -> int:
        """Smallest size of a set that links with one of this size."""
        return -(-size * self.num // self.over)

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """Size classes of a set: its own, and the larger ones that it can link into.

        Each with the number of its parts and the most tokens by which a set of this size
        differs from one it links with there.
        """
        level = int(math.log(size) / math.log(_RATIO) + 1e-9)
        out = []
        top = int(math.log(size * self.over / self.num) / math.log(_RATIO) + 1e-9)
        for k in range(level, max(top, level + 1) + 1):
            low, high = math.ceil(_RATIO**k - 1e-9), max(size, math.ceil(_RATIO ** (k + 1) - 1e-9) - 1)
            differ = self.differences(2 * high)
            if differ and (k == level or size >= self.smallest(low)):  # else only equal sets link
                own = self.differences(size + min(high, size * self.over // self.num))
                out.append((k, differ + 1 + 1 + -(-(differ + 1) // 10), own))
        return out


def signatures(grams: np.ndarray, threshold: Threshold, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the parts of a set, of which two sets that link share one at least.

    ``common`` are sorted hashes of n-grams that many sets have. Parts of such n-grams alone
    say little, and need no signature if there are more other parts than two linked sets
    can differ in: one of the others is then the same in both. So any ``common`` is lossless.
    """
    out = []
    if not len(grams):
        return np.zeros(0, U64)
    rare = np.ones(len(grams), bool)
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] != grams
    spread, values = mix(grams + U64(77)), mix(grams ^ U64(0x3C3C3C3C3C3C3C3C))
    for level, parts, differ in threshold.classes(len(grams)):
        part = ((spread >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        full = np.flatnonzero(counts)
        begin = np.concatenate([[0], np.cumsum(counts)])[full]
        sums = np.zeros(parts, U64)
        sums[full] = np.add.reduceat(values[order], begin)
        sums = mix(sums + mix(np.arange(parts, dtype=U64) + U64(level << 32)))
        # If two linked sets had no full part in common, all of them would differ. Parts of
        # common n-grams, and empty ones, need a signature only where that can be.
        telling = np.flatnonzero(np.bincount(part[rare], minlength=parts))
        out.append(sums[telling] if len(telling) > differ else sums[full] if len(full) > differ else sums)
    return np.concatenate(out) if out else np.zeros(0, U64)


def _described(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [(len(g), *fingerprint(g)) for g in text_sets(part.column(1), size)]
            n, one, two = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(one), pa.array(two)], ["doc_id", "n", "f1", "f2"])

    return run


def _candidates(size: int, threshold: Threshold, parts: int, common):
    """Kinds ``0`` signature and set, one of each signature of a task, dealt by signature; ``1`` sets linked here."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, "text", _CHUNK):
            known: set[int] = set()
            keys, owners = [], []
            for column in table.column("text").chunks:
                for grams in text_sets(column, size):
                    own = fingerprint(grams)[0]
                    if own not in known:
                        known.add(own)
                        found = signatures(grams, threshold, common.value)
                        keys.append(found)
                        owners.append(np.full(len(found), own, np.int64))
            if keys:
                k, a, pairs = _stars(np.concatenate(keys), np.concatenate(owners))
                yield from deal(parts, [by_key(0, k, parts, k, a), by_key(1, pairs[0] ^ pairs[1], parts, *pairs)])

    return run


def _stars(k: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each signature with the smallest of its sets, and the links of that set with the others."""
    order = np.lexsort((a, k))
    k, a = k[order], a[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    head = a[np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))]
    more = ~first & (a != head)
    return k[first], a[first], np.unique(np.stack([head[more], a[more]]), axis=1)


def _links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for records in buckets(rows):
        _, _, pairs = _stars(*records.of(0, 2))
        a, b = (np.concatenate(x) for x in zip(pairs, records.of(1, 2), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


class SignatureTree:
    """Sets in the order of their sizes and smallest tokens, in nodes of up to ``fan`` below ``fan``."""

    def __init__(self, sets: list[np.ndarray], fan: int = 8):
        self.sizes = [len(s) for s in sets]
        # A token of one set alone is in no overlap and gets no bit.
        _, places, times = np.unique(np.concatenate([*sets, np.zeros(0, U64)]), return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        self.bits: list[int] = []
        at = 0
        for n in self.sizes:
            own = places[at : at + n]
            marks = np.zeros(int(shared.sum()), np.uint8)
            marks[number[own[shared[own]]]] = 1
            self.bits.append(int.from_bytes(np.packbits(marks).tobytes(), "little"))
            at += n
        order = sorted(range(len(sets)), key=lambda i: (int(mix(sets[i]).min()) if len(sets[i]) else 0, self.sizes[i], i))
        # A node: bitmap, smallest size, largest size, members, children.
        level = [(self.bits[i], self.sizes[i], self.sizes[i], [i], []) for i in order]
        while len(level) > 1:
            level = [self._above(level[k : k + fan]) for k in range(0, len(level), fan)]
        self.root = level[0] if level else None

    @staticmethod
    def _above(nodes: list) -> tuple:
        bits = 0
        for node in nodes:
            bits |= node[0]
        return bits, min(n[1] for n in nodes), max(n[2] for n in nodes), [i for n in nodes for i in n[3]], nodes

    def join(self, threshold: Threshold, forest: _Forest) -> list[tuple[int, int]]:
        """Links that connect all linked sets."""
        found: list[tuple[int, int]] = []
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            x, y = stack.pop()
            # The largest overlap any two sets below can have, against the smallest that links.
            if threshold.num * max(x[1], y[1]) > threshold.over * min(x[2], y[2]):
                continue
            common = min((x[0] & y[0]).bit_count(), x[2], y[2])
            if (threshold.over + threshold.num) * common < threshold.num * (x[1] + y[1]):
                continue
            if x[4] or y[4]:
                root = forest.find(x[3][0])
                if all(forest.find(i) == root for i in x[3]) and all(forest.find(i) == root for i in y[3]):
                    continue
                if x is y:
                    below = x[4]
                    stack += [(below[i], below[j]) for i in range(len(below)) for j in range(i, len(below))]
                elif x[4] and (not y[4] or len(x[3]) >= len(y[3])):
                    stack += [(c, y) for c in x[4]]
                else:
                    stack += [(x, c) for c in y[4]]
                continue
            i, j = x[3][0], y[3][0]
            if i != j and forest.find(i) != forest.find(j) and threshold.links(common, self.sizes[i], self.sizes[j]):
                forest.join(i, j)
                found.append((i, j))
        return found


def _grams_of(size: int, places: list[str]):
    """The sets of texts as bytes, beside the columns ``places``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index
            found = list(text_sets(part.column(at("text")), size))
            # Another text under the same id is not the one that is meant.
            meant = zip(part.column(at("f1")).to_pylist(), part.column(at("f2")).to_pylist(), strict=True)
            same = pa.array([fingerprint(g) == f for g, f in zip(found, meant, strict=True)], pa.bool_())
            grams = pa.array([g.tobytes() for g in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(at(c)) for c in places), grams], [*places, "grams"]).filter(same)

    return run


def _joined(threshold: Threshold):
    """Links within the sets of each group; sets of one known component are not compared with each other."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for part in parts:
            rows = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("cluster", "i", "j", "doc", "known", "grams")), strict=True)
            for cluster, i, j, doc, known, grams in rows:
                if (cluster, i, j) != group:
                    yield from linked(held)
                    group, held = (cluster, i, j), []
                held.append((doc, known, np.frombuffer(grams, U64)))
        yield from linked(held)

    def linked(held: list) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        forest, first = _Forest(len(held)), {}
        for k, (_, known, _) in enumerate(held):
            forest.join(k, first.setdefault(known, k))
        found = SignatureTree([g for *_, g in held]).join(threshold, forest)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, size: int = 3, threshold: Threshold | None = None, block: int = 400) -> DataFrame:
    """``doc_id, n_shingles, component_id, set_id`` for every row of ``docs``.

    ``set_id`` is the smallest id with the same set; sets with different ``set_id`` and the
    same ``component_id`` are linked by a chain. ``block`` is the number of sets that meet at
    once: a larger cluster is cut into blocks (see ``_links_within``).
    """
    threshold = threshold or Threshold()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = stored(rows.mapInArrow(_described(size), "doc_id long, n long, f1 long, f2 long"))
    sets = described.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("set_id"))
    parts = partitions(rows)
    near = _clusters(rows, size, threshold, parts)
    links = _links_within(rows, sets.join(near, sets.f1 == near.node).select(F.col("set_id").alias("doc"), "f1", "f2", F.col("component").alias("cluster")), size, threshold, block, parts)
    whole = components(links).select(F.col("node").alias("set_id"), "component")
    named = sets.join(whole, "set_id", "left").select("f1", "f2", "set_id", F.coalesce("component", "set_id").alias("component_id"))
    met = described.join(named, ["f1", "f2"], "left")
    return met.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("set_id")).otherwise(F.col("doc_id")).alias("set_id"),
    )


def keep_one(docs: DataFrame, size: int = 5, threshold: Threshold | None = None, block: int = 400) -> DataFrame:
    """The rows of ``docs`` without those linked with a smaller id, all columns as they are; rows without an id stay.

    Rows that share an id are told apart: each is judged by its own text, and of a group that
    only such rows form one stays.
    """
    (key,) = free(docs, "_key")
    rows, odd = keyed(docs.where("doc_id IS NOT NULL"), key)
    texts = rows.select(F.col(key).alias("doc_id"), "text")
    dropped = jaccard_components(texts, size, threshold or Threshold(80, 100), block).where("component_id < doc_id").select(F.col("doc_id").alias(key)).distinct()
    if odd is None:  # every id names one row, so it will do
        dropped = dropped.withColumnRenamed(key, "doc_id")
        return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    kept = rows.join(dropped.hint("merge"), key, "left_anti").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id IS NULL"))


def _common_grams(rows: DataFrame, size: int, sample: int = 2000, most: int = 1_000_000) -> np.ndarray:
    """N-grams that several documents of a sample have, at most ``most`` of them, sorted.

    The sample grows with the table: of one of a fixed size, n-grams of hundreds of documents are missed in a large
    table, and these connect its sets to one cluster.
    """
    share = max(1, min(_SHARE, rows.count() // sample))
    texts = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).where("doc_id IS NOT NULL").select("text").distinct()
    grams = stored(texts.mapInArrow(_each_gram(size), "gram long").groupBy("gram").count().where("count > 1"))
    # The most frequent ones: only how many are that frequent comes to the driver before.
    frequent = grams.groupBy(F.least("count", F.lit(1 << 12)).alias("count")).agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect()
    least, n = (1 << 12) + 1, 0
    for r in frequent:
        n += r.n
        if n > most:
            break
        least = r["count"]
    found = grams.where(F.col("count") >= least).select("gram").toArrow()["gram"].to_numpy()
    discard(grams)
    return np.sort(found.view(U64))


def _each_gram(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for grams in text_sets(part.column(0), size):
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    return run


def _clusters(rows: DataFrame, size: int, threshold: Threshold, parts: int) -> DataFrame:
    """``node, component``: sets (first half of the fingerprint) that signatures connect."""
    common = rows.sparkSession.sparkContext.broadcast(_common_grams(rows, size))
    found = rows.where(F.col("text").isNotNull()).select("text").mapInArrow(_candidates(size, threshold, parts, common), SCHEMA)
    return components(exchanged(found, parts).mapInArrow(_links, "a long, b long"))


def _links_within(rows: DataFrame, members: DataFrame, size: int, threshold: Threshold, block: int, parts: int) -> DataFrame:
    """Links ``a, b`` that connect all linked sets of each cluster."""
    counts = members.groupBy("cluster").agg(F.count("*").alias("m")).where("m > 1")
    own = F.pmod(F.xxhash64("doc"), "blocks").cast("int")
    dealt = members.join(counts, "cluster").withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("own", own)
    # Both sides grow with the input, so neither is broadcast at any size. The texts are met
    # once; both rounds read the sets.
    texts = rows.join(dealt.drop("m").hint("merge"), F.col("doc_id") == F.col("doc")).drop("doc_id")
    columns = "doc long, cluster long, blocks int, own int"
    sets = stored(texts.mapInArrow(_grams_of(size, [c.split()[0] for c in columns.split(", ")]), f"{columns}, grams binary"))
    large = sets.where("blocks > 1")
    if not large.limit(1).count():
        return _links_of_sets(sets, threshold, block)
    # A large cluster mostly is many small ones that shared passages connect.
    finer = _finer(large, threshold, parts)
    counts = finer.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    finer = finer.join(counts, "component").select(F.col("node").alias("doc"), F.col("component").alias("cluster"), "blocks").withColumn("own", own)
    again = large.select("doc", "grams").join(finer.hint("merge"), "doc").select("doc", "cluster", "blocks", "own", "grams")
    return _links_of_sets(stored(sets.where("blocks = 1").unionByName(again)), threshold, block)


def _finer(large: DataFrame, threshold: Threshold, parts: int) -> DataFrame:
    """``node, component``: sets of large clusters connected by the prefixes of their n-grams, without loss.

    N-grams of one set alone come first in the order of all n-grams. Two sets that link
    share one of the first ``n - least overlap + 1``, so sets with that many of their own
    link with nothing, and few n-grams of the others have to be compared.
    """
    met = exchanged(large.select("doc", "grams").mapInArrow(_gram_records(parts), SCHEMA), parts)
    shared = exchanged(met.mapInArrow(_shared_grams(parts), SCHEMA), parts)
    prefixes = exchanged(shared.mapInArrow(_prefixes(threshold, parts), SCHEMA), parts)
    return components(prefixes.mapInArrow(_links, "a long, b long"))


def _gram_records(parts: int):
    """``0`` n-gram, set, size of the set; ``1`` an n-gram that is frequent here; ``2`` its records, dealt by set."""

    def gram_records(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, "grams", _CHUNK):
            sets = [np.frombuffer(g.as_buffer(), U64) for g in table.column("grams")]
            size = np.array([len(g) for g in sets])
            k, n = np.concatenate([*sets, np.zeros(0, U64)]), np.repeat(size, size)
            doc = np.repeat(table.column("doc").to_numpy(), size)
            _, back, times = np.unique(k, return_inverse=True, return_counts=True)
            often = times[back] > _OFTEN
            marks = np.unique(k[often])
            yield from deal(
                parts,
                [
                    by_key(0, k[~often], parts, k[~often], doc[~often], n[~often]),
                    by_key(1, marks, parts, marks),
                    by_key(2, doc[often], parts, k[often], doc[often], n[often]),
                ],
            )

    return gram_records


def _shared_grams(parts: int):
    """The records of n-grams that several sets have, dealt by set."""

    def shared_grams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets(rows):
            k, doc, n = records.of(0, 3)
            _, back, times = np.unique(k, return_inverse=True, return_counts=True)
            kept = (times[back] > 1) | np.isin(k, records.of(1, 1)[0])
            k, doc, n = (np.concatenate([x[kept], y]) for x, y in zip((k, doc, n), records.of(2, 3), strict=True))
            yield from deal(parts, [by_key(0, doc, parts, k, doc, n)])

    return shared_grams


def _prefixes(threshold: Threshold, parts: int):
    """Shared n-grams in the prefix of each set, as ``_candidates`` has signatures."""

    def prefixes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in buckets(rows):
            k, doc, n = records.of(0, 3)
            order = np.lexsort((mix(k.view(U64)), doc))
            k, doc, n = k[order], doc[order], n[order]
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
            shared = np.diff(np.append(first, len(doc)))
            place = np.arange(len(doc)) - np.repeat(first, shared)
            least = -(-n * threshold.num // threshold.over)
            inside = place < np.repeat(shared, shared) - least + 1
            k, a, pairs = _stars(k[inside], doc[inside])
            yield from deal(parts, [by_key(0, k, parts, k, a), by_key(1, pairs[0] ^ pairs[1], parts, *pairs)])

    return prefixes


def _links_of_sets(sets: DataFrame, threshold: Threshold, block: int) -> DataFrame:
    """Links of the sets of each cluster, which has ``blocks``, of which a set is in its ``own``.

    A cluster of several blocks meets in two rounds: every block by itself and with the
    first one, and then the sets that are not yet in the cluster's main component with all
    blocks. A cluster of near copies is mostly done after the first round, whose cost grows
    with its size and not with the square of it.
    """

    everyone, zero = F.sequence(F.lit(0), F.col("blocks") - 1), F.lit(0)
    first = F.when(F.col("own") == 0, F.transform(everyone, lambda x: F.struct(zero.alias("i"), x.alias("j"))))
    first = first.otherwise(F.array(F.struct(zero.alias("i"), F.col("own").alias("j")), F.struct(F.col("own").alias("i"), F.col("own").alias("j"))))
    found = stored(_met(sets.withColumns({"places": first, "known": F.col("doc")}), threshold))

    large = sets.where("blocks > 1").drop("grams")
    if not large.limit(1).count():
        return found
    known = components(found).select(F.col("node").alias("doc"), "component")
    large = large.join(known, "doc", "left").withColumn("known", F.coalesce("component", "doc")).drop("component")
    sizes = large.groupBy("cluster", "known").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("known", F.struct("n", "known")).alias("main"))
    large = stored(large.join(main, "cluster"))
    apart = large.where("known <> main").groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("more"))
    if not apart.limit(1).count():
        return found
    large = large.join(apart, "cluster")
    mine = F.transform(F.sequence(F.lit(0), F.col("more") - 1), lambda x: F.struct(x.alias("i"), F.col("own").alias("j")))
    turn = F.pmod(F.xxhash64("doc", F.lit(1)), "more").cast("int")
    asked = F.transform(everyone, lambda x: F.struct(turn.alias("i"), x.alias("j")))
    places = F.when(F.col("known") == F.col("main"), mine).otherwise(F.array_union(mine, asked))
    second = large.select("doc", "known", places.alias("places"))
    again = sets.where("blocks > 1").select("doc", "cluster", "grams").join(second.hint("merge"), "doc")
    return found.unionByName(_met(again, threshold))


def _met(sets: DataFrame, threshold: Threshold) -> DataFrame:
    """Links of the sets that meet in a place, ``(cluster, i, j)``."""
    placed = sets.select("cluster", F.explode("places").alias("place"), "doc", "known", "grams")
    placed = placed.select("cluster", "place.i", "place.j", "doc", "known", "grams")
    sent = placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc")
    return sent.mapInArrow(_joined(threshold), "a long, b long")
