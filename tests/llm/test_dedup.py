"""Exact dedup, Jaccard join, repeated bytes and shared passages against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from anchorwake.llm import components, exact, jaccard, passages, substrings
from anchorwake.llm.ship import ship

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark):
    return plain.odd_documents(), plain.frame(spark, plain.odd_documents())


def _empty(spark):
    return spark.createDataFrame([], plain.SCHEMA)


def _exact(rows):
    texts = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t, *_ in rows]
    groups: dict = {}
    for d, t in texts:
        groups.setdefault(t, []).append(d)
    out, turn = [], set()
    for d, t in texts:
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        kept = d == keep and (t, d) not in turn
        turn.add((t, d))
        out.append((d, keep, len(groups[t]), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=plain.sort_key)


@pytest.mark.parametrize("memory", [64 << 20, 2000])
def test_exact_dedup_is_the_plain_grouping(odd, memory):
    rows, docs = odd
    found = [tuple(r) for r in exact.exact_dedup(docs, memory).collect()]
    assert sorted(found, key=plain.sort_key) == _exact(rows)


def test_exact_dedup_keeps_one_row_of_each_text(odd, spark):
    rows, docs = odd
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows})
    assert exact.exact_dedup(_empty(spark)).collect() == []
    assert exact.keep_first(_empty(spark)).collect() == []


def test_grace_partitioning_with_records_that_no_hash_can_split():
    same = (b"\x01" * 32, b"text" * 100, 5, 1)
    others = [(hashlib.sha256(bytes([i])).digest(), bytes([i]) * 300, i, 1) for i in range(200)]
    found = list(exact.grace_groups(iter([*others, same, *others, same, (*same[:2], 2, 3)]), 1000))
    assert len(found) == 201
    assert [same[0], same[1], 2, 5] in found
    assert sum(x[3] for x in found) == 405


def test_table_compares_contents_of_equal_hashes():
    table = exact.ContentTable()
    for i in range(3000):
        table.add(b"\x00" * 32, b"%d" % (i % 7), i, 1)
    assert sorted((e[1], e[2]) for e in table.entries) == [(b"%d" % i, i) for i in range(7)]


@pytest.mark.parametrize(("size", "num", "block"), [(3, 90, 600), (3, 90, 2), (5, 80, 600), (2, 50, 3)])
def test_jaccard_components_are_those_of_all_pairs(spark, size, num, block):
    rows = plain.documents(3)
    texts = {r[0]: r[1] for r in rows}
    found = jaccard.jaccard_components(plain.frame(spark, rows), size, jaccard.Threshold(num), block).collect()
    assert {r.doc_id: r.component_id for r in found} == plain.components(texts, size, num)
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(plain.grams(t, size)) for i, t in texts.items()}


def test_jaccard_of_odd_rows(odd, spark):
    rows, docs = odd
    found = jaccard.jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles) for r in found), key=plain.sort_key) == sorted(((d, len(plain.grams(t, 3))) for d, t, *_ in rows), key=plain.sort_key)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id IS NULL").count() == 2
    assert jaccard.jaccard_components(_empty(spark)).collect() == []


@pytest.mark.parametrize(("num", "size"), [(90, 12), (90, 200), (80, 6), (80, 40), (50, 30)])
def test_linked_sets_share_a_signature(num, size):
    rng, other, threshold = np.random.default_rng(size), np.random.default_rng(1), jaccard.Threshold(num)
    linked = 0
    for _ in range(300):
        one = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        gone, new = rng.integers(0, size // 4 + 1), rng.integers(0, size // 4 + 1)
        two = np.unique(np.concatenate([one[gone:], rng.integers(0, 1 << 62, new, dtype=np.uint64)]))
        common = len(np.intersect1d(one, two))
        if threshold.links(common, len(one), len(two)) and len(np.setxor1d(one, two)):
            linked += 1
            for often in (None, one[: size // 3], np.sort(other.permutation(two)[: size // 2]), one, two):
                assert np.intersect1d(jaccard.signatures(one, threshold, often), jaccard.signatures(two, threshold, often)).size
    assert linked > 20


@pytest.mark.parametrize("num", [30, 50])
def test_sets_that_link_across_size_classes_share_a_signature(num):
    rng, threshold = np.random.default_rng(num), jaccard.Threshold(num)
    for size in range(6, 60):
        two = np.unique(rng.integers(0, 1 << 62, size, dtype=np.uint64))
        one = two[: threshold.smallest(size)]
        assert threshold.links(len(one), len(one), len(two))
        assert np.intersect1d(jaccard.signatures(one, threshold), jaccard.signatures(two, threshold)).size


def test_common_grams_of_a_large_table_are_those_of_a_share_of_it(spark):
    """A line of one document in 50 is common, also where a sample of fixed size does not hold it twice."""
    rng = random.Random(23)
    lines = [plain.prose(rng, 3, 10**6) for _ in range(2)]
    rows = [(i, f"{plain.prose(rng, 12, 10**6)} {lines[0] if i % 50 == 0 else ''} {lines[1] if i % 100 < 99 else ''}") for i in range(4000)]
    docs = ship(spark).createDataFrame([*rows, (None, rows[0][1]), (None, rows[0][1])], "doc_id long, text string")
    grams = [next(jaccard.text_sets(pa.array([line]), 3)) for line in lines]
    common = jaccard._common_grams(docs, 3, sample=20)
    assert all(np.isin(g, common).all() for g in grams) and len(common) < 40
    assert (np.diff(common.astype(object)) > 0).all()
    assert jaccard._common_grams(docs, 3, sample=20, most=1).tolist() == grams[1].tolist()
    assert len(jaccard._common_grams(docs, 3, sample=20, most=0)) == len(jaccard._common_grams(_empty(spark), 3)) == 0


def test_tree_finds_the_components_of_all_pairs():
    rng, threshold = random.Random(5), jaccard.Threshold(80)
    base = [rng.getrandbits(60) for _ in range(60)]
    sets = []
    for k in range(120):
        own = set(base if k % 3 else [rng.getrandbits(60) for _ in range(rng.randint(1, 60))])
        for _ in range(rng.randint(0, 8)):
            own.discard(rng.choice(base))
            own.add(rng.getrandbits(60))
        sets.append(np.array(sorted(own), np.uint64))
    up = list(range(len(sets)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if threshold.links(len(np.intersect1d(x, y)), len(x), len(y)):
                up[max(find(i), find(j))] = min(find(i), find(j))
    forest = jaccard._Forest(len(sets))
    jaccard.SignatureTree(sets).join(threshold, forest)
    assert [forest.find(i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    found = components.components(spark.createDataFrame([*chain, *star, (5, 5)], "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_links_take_few_tasks(spark):
    """However many partitions a shuffle has."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] * 2, "a long, b long").repartition(8).cache()
    links.count()
    for k, v in held.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("components", "")
    try:
        components.components(links)
        seen = spark.sparkContext.statusTracker()
        stages = {k for j in seen.getJobIdsForGroup("components") for k in seen.getJobInfo(j).stageIds}
        assert 0 < sum(i.numTasks for i in map(seen.getStageInfo, stages) if i) < 5 * 64
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)


def test_local_stars_connect_what_the_links_do():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 40, (2, 25))
        nodes, low = components.local_stars(a, b)
        joined = components_one_by_one(zip(a.tolist(), b.tolist(), strict=True))
        assert dict(zip(nodes.tolist(), low.tolist(), strict=True)) == {i: c for i, c in joined.items() if i != c}


def components_one_by_one(links):
    up = {}

    def root(i):
        up.setdefault(i, i)
        return i if up[i] == i else root(up[i])

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def _removed(docs, **options):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[n] for n in names) for r in substrings.remove_repeated(docs, **options).collect()), key=plain.sort_key)


@pytest.mark.parametrize(("width", "spacing"), [(200, 26), (64, 26), (200, 90), (40, 8)])
def test_repeated_bytes_are_those_counted_one_by_one(spark, width, spacing):
    rows = plain.documents(4, 25)
    expected = sorted(plain.without_repeated(rows, width), key=plain.sort_key)
    assert _removed(plain.frame(spark, rows), width=width, spacing=spacing) == expected


def test_repeated_bytes_of_odd_rows(odd, spark):
    rows, docs = odd
    assert _removed(docs) == sorted(plain.without_repeated(rows, 200), key=plain.sort_key)
    assert _removed(_empty(spark)) == []
    kept = substrings.remove_repeated(docs, keep_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept)


def test_edges_that_meet_a_settled_passage_elsewhere(spark):
    """A short part of a passage that is whole in two other documents."""
    rng = random.Random(8)
    long = plain.prose(rng, 400, 10**6)
    rows = [(i, f"{plain.prose(rng, 50, 10**6)} {t} {plain.prose(rng, 50, 10**6)}") for i, t in enumerate([long, long, long[700:910], long[300:620], long[:200]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _removed(docs) == sorted(plain.without_repeated(rows, 200))


def test_shared_passages_are_found_and_others_left_alone(spark):
    rows = plain.documents(6)
    texts = {r[0]: r[1] for r in rows}
    found = passages.near_passages(plain.frame(spark, rows)).collect()
    ids = {r.doc_id for r in found} | {r.match_id for r in found}
    assert plain.shared_runs(texts, 52) <= ids
    for r in found:
        one, two = (texts[d].encode()[a:b].decode() for d, a, b in ((r.match_id, r.match_begin, r.match_end), (r.doc_id, r.begin, r.end)))
        assert len(plain.words(one)) >= 50 and len(plain.words(two)) == r.n_words >= 50
        x, y = plain.grams(one, 5), plain.grams(two, 5)
        assert len(x & y) / len(x | y) == pytest.approx(r.similarity) and r.similarity >= 0.8


def test_recall_of_changed_passages(spark):
    rng = random.Random(11)
    rows, changed = [], 0
    for i in range(60):
        passage = plain.prose(rng, 120, 10**6).split(" ")
        copy = list(passage)
        for _ in range(2):
            copy[rng.randrange(120)] = f"new{rng.getrandbits(40)}"
        rows += [(2 * i, " ".join(passage)), (2 * i + 1, f"{plain.prose(rng, 40, 10**6)} {' '.join(copy)}")]
        changed += 1
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id // 2 for r in found if r.doc_id // 2 == r.match_id // 2}) >= 0.95 * changed


@pytest.mark.parametrize(("n", "at"), [(n, (w,)) for n in (50, 60, 80, 90) for w in (2, 7, n // 2, n - 8)] + [(150, (37, 75, 112)), (300, tuple(range(25, 300, 50)))])
def test_changed_passages_at_the_threshold_are_verified(n, at):
    """Passages with changed words in the middle or evenly spaced, between texts that have nothing in common."""
    rng = np.random.default_rng(n + len(at))
    passage, changed = (rng.integers(0, 1 << 62, n, dtype=np.uint64) for _ in range(2))
    copy = np.where(np.isin(np.arange(n), at), changed, passage)
    one, two = (np.concatenate([rng.integers(0, 1 << 62, k, dtype=np.uint64), p, rng.integers(0, 1 << 62, 30, dtype=np.uint64)]) for k, p in ((20, passage), (45, copy)))
    grams = [sum(passages.mix(w[k : len(w) - 4 + k] + np.uint64(k)) for k in range(5)) for w in (one, two)]
    found = passages.verified(*grams, 46, 0.8)
    assert len(found) == 1
    a, b, c, d, similar = found[0]
    x, y = set(grams[0][a:b].tolist()), set(grams[1][c:d].tolist())
    assert min(b - a, d - c) >= 46 and similar == len(x & y) / len(x | y) >= 0.8
    assert a <= 20 + 5 and b >= 20 + n - 4 - 5


def test_first_passages_are_sent_as_their_bytes():
    """Neither hashes nor places of words, which took 16 bytes a word."""
    rng, texts = random.Random(16), []
    for _ in range(3):
        texts.append(f" {plain.prose(rng, 400, 10**6)}\n é  {plain.prose(rng, 100, 10**6)} ")
    rows = [(0, 0, 450), (0, 3, 60), (1, 100, 300), (4, 90, 497)]
    doc = {0: texts[0], 1: texts[1], 4: texts[2]}
    columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [7] * 4, [0] * 4, [50] * 4]
    part = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([doc[r[0]] for r in rows])], ["d1", "a1", "b1", "d2", "a2", "b2", "text"])
    sent = pa.Table.from_batches(passages._first_side()(iter([part.slice(0, 3), part.slice(3)])))
    for (d, a, b), begin, passage in zip(rows, sent["from1"].to_pylist(), sent["passage"].to_pylist(), strict=True):
        data = doc[d].encode()
        assert data[begin : begin + len(passage)] == passage and passage.decode().split() == data.decode().split()[a : b + 4]
    assert sent.nbytes < sum(len(p) for p in sent["passage"].to_pylist()) + 64 * len(rows)


def test_passages_that_cannot_be_similar_are_not_cut(monkeypatch):
    """Half of a passage agrees: no run of the other side is looked for, though it was at seven costs."""
    rng, looked = np.random.default_rng(18), []
    passage = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    other = [rng.integers(0, 1 << 62, 40, dtype=np.uint64) for _ in range(3)]
    one = np.concatenate([passage[:30], rng.integers(0, 1 << 62, 6, dtype=np.uint64), passage[30:]])
    two = np.concatenate([other[0], passage[:30], rng.integers(0, 1 << 62, 16, dtype=np.uint64), passage[30:], other[1]])
    near = np.concatenate([other[0], passage[:30], rng.integers(0, 1 << 62, 2, dtype=np.uint64), passage[30:], other[1]])
    assert [r[:4] for r in passages.verified(one, near, 46, 0.8)] == [(0, 66, 40, 102)]
    parts = passages.dense_parts
    monkeypatch.setattr(passages, "dense_parts", lambda *x: looked.append(len(x[0])) or parts(*x))
    assert passages.verified(one, two, 46, 0.8) == []
    assert set(looked) <= {len(one), 30, 36} and len(looked) <= 8


def test_dense_parts_are_those_of_comparing_all_sums():
    rng = np.random.default_rng(19)
    for _ in range(300):
        n, cost = int(rng.integers(1, 60)), float(rng.choice([0.7, 1.3, 3.996, 32]))
        same = rng.random(n) < rng.choice([0.2, 0.5, 0.8, 0.95])
        sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -cost))])
        runs = [(a, b) for b in range(n + 1) for a in range(b) if sums[a] <= sums[b]]
        inside = {i for a, b in runs for i in range(a, b)}
        unions, longest = passages.dense_parts(same, cost)
        assert {i for a, b in unions for i in range(a, b)} == inside and all(b not in inside for _, b in unions)
        assert longest[1] - longest[0] == max((b - a for a, b in runs), default=0)
        assert not runs or longest in runs or longest in unions
        assert passages.dense_parts(same, cost, 10)[0] == [(a, b) for a, b in unions if b - a >= 10]


def test_passages_of_one_changed_word_are_found(spark):
    rng, rows = random.Random(12), []
    for i in range(80):
        passage = plain.prose(rng, 60 + i % 31, 10**6).split(" ")
        copy = [*passage[: len(passage) // 2], f"new{i}", *passage[len(passage) // 2 + 1 :]]
        rows += [(2 * i + k, f"{plain.prose(rng, 30, 10**6)} {' '.join(p)} {plain.prose(rng, 30, 10**6)}") for k, p in enumerate((passage, copy))]
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id // 2 for r in found if r.doc_id // 2 == r.match_id // 2}) >= 0.95 * 80


def test_a_line_repeated_in_long_documents_is_shared_to_its_end(spark):
    rng = random.Random(13)
    line = plain.prose(rng, 8, 10**6)
    rows = [(i, f"{plain.prose(rng, 60, 10**6)} {' '.join([line] * n)} {plain.prose(rng, 60, 10**6)}") for i, n in enumerate((2500, 2500, 1900))]
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shared = {i: max(r.n_words for r in found if r.doc_id == i) for i in (1, 2)}
    assert shared[1] >= 20000 and shared[2] >= 15200
    longest = max((r for r in found if r.doc_id == 1), key=lambda r: r.n_words)
    for text, a, b in ((rows[0][1], longest.match_begin, longest.match_end), (rows[1][1], longest.begin, longest.end)):
        assert line in text[a:b][:300] and len(text[a:b].split()) >= 20000


@pytest.mark.parametrize(("lines", "size"), [(2, 30), (3, 20)])
def test_passages_whose_lines_stand_in_smaller_documents_are_found(spark, lines, size):
    rng, rows = random.Random(3), []

    def around(text):
        return f"{plain.prose(rng, 40, 10**6)} {text} {plain.prose(rng, 40, 10**6)}"

    for i in range(40):
        parts = [plain.prose(rng, size, 10**6) for _ in range(lines)]
        rows += [(lines * i + k, around(line)) for k, line in enumerate(parts)]
        rows += [(10_000 + 10 * i + k, around(" ".join(parts))) for k in range(2)]
    found = passages.near_passages(ship(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.match_id for r in found} | {r.doc_id for r in found} <= {d for d, _ in rows if d >= 10_000}
    assert len({r.doc_id // 10 for r in found if r.doc_id // 10 == r.match_id // 10}) >= 38


def test_passages_of_which_the_first_documents_hold_a_part_are_found(spark):
    """Two texts that share 80 words, after documents with 40 of them, which is too few to be a passage."""
    rng, rows = random.Random(4), []

    def around(text):
        return f"{plain.prose(rng, 40, 10**6)} {text} {plain.prose(rng, 40, 10**6)}"

    for i in range(40):
        parts = [plain.prose(rng, 40, 10**6) for _ in range(2)]
        rows += [(2 * i + k, around(line)) for k, line in enumerate(parts)]
        rows += [(10_000 + 10 * i + k, around(" ".join(parts))) for k in range(2)]
    found = passages.near_passages(ship(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.doc_id // 10 for r in found if r.doc_id // 10 == r.match_id // 10 >= 1000}) >= 39


def test_every_two_different_near_copies_are_found(spark):
    rng, rows = random.Random(14), []
    for i in range(15):
        passage = plain.prose(rng, 160, 10**6).split(" ")
        for k in range(6):
            copy = list(passage)
            copy[20 * k + 15] = f"new{k}"
            rows.append((10 * i + k, f"{plain.prose(rng, 30, 10**6)} {' '.join(copy)} {plain.prose(rng, 30, 10**6)}"))
    found = passages.near_passages(ship(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.match_id, r.doc_id) for r in found}
    assert all(a // 10 == b // 10 for a, b in pairs)
    assert len(pairs) >= 0.98 * 15 * 15


def test_every_two_of_many_near_copies_are_found(spark):
    """Letters of one form with another word each: more of them than meet whatever is around a minimum, beside a line that many texts have."""
    rng, rows = random.Random(15), []
    form, line = plain.prose(rng, 76, 10**6).split(" "), plain.prose(rng, 18, 10**6)
    for k in range(60):
        copy = [*form[:37], f"new{k}", *form[38:]]
        rows.append((k, f"{plain.prose(rng, 30, 10**6)} {' '.join(copy)} {plain.prose(rng, 60, 10**6)} {line} {plain.prose(rng, 60, 10**6)}"))
        rows.append((100 + k, f"{plain.prose(rng, 60, 10**6)} {line} {plain.prose(rng, 60, 10**6)}"))
    found = passages.near_passages(ship(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.match_id, r.doc_id) for r in found}
    assert all(a < b < 60 for a, b in pairs) and len(pairs) >= 0.98 * 60 * 59 / 2


def _alike(around, length, enough):
    """Pairs of rows that share ``enough`` on both sides; those that share one stretch alone are ``copies``."""
    pairs, copies = set(), set()
    held = [set(x[x > 0].tolist()) for x in around]
    for i, j in itertools.combinations(range(len(around)), 2):
        common = [sum(v in held[y] for v in around[x].tolist()) for x, y in ((i, j), (j, i))]
        if min(common) >= enough:
            same = ((around[i] == around[j]) & (around[i] > 0)).tolist()
            run = len(list(itertools.takewhile(bool, same[length - 1 :: -1]))) + len(list(itertools.takewhile(bool, same[length - 1 :]))) - 1
            (copies if run >= length and max(common) == run else pairs).add((i, j))
    return pairs, copies


@pytest.mark.parametrize("kind", ["near", "short", "line", "repeats"])
def test_windows_alike_are_those_of_comparing_all(kind, monkeypatch):
    monkeypatch.setattr(passages, "_ROWS", 16)
    monkeypatch.setattr(passages, "_AT_ONCE", 2000)
    rng, length = np.random.default_rng(22), 20
    width = 2 * length - 1
    base = rng.integers(1, 1 << 32, (3, width))
    if kind == "repeats":
        base = rng.choice(rng.integers(1, 1 << 32, 6), (3, width))
    rows = []
    for _ in range(120):
        row = base[rng.integers(3)].copy()
        for at in rng.integers(0, width, rng.integers(0, 4)):
            row[at : at + 3] = rng.integers(1, 1 << 32, len(row[at : at + 3]))
        if kind == "short":
            row[: rng.integers(0, length)] = 0
        if kind == "line":
            n = rng.integers(1, length - 1)
            row[: length - 1 - n], row[length + n :] = (rng.integers(1, 1 << 32, length - 1 - n) for _ in range(2))
        row[length - 1] = 7
        rows.append(row)
    around = np.array(rows).astype(np.uint32)
    found = [p for x, y in passages.alike(around, length, 0.8) for p in zip(x.tolist(), y.tolist(), strict=True)]
    pairs, copies = _alike(around, length, length // 2)
    assert pairs <= set(found) and (len(pairs) > 50 or kind == "short")
    first = set(found) - pairs
    assert all(any((around[i, t : t + length] == around[j, t : t + length]).all() for t in range(length)) for i, j in first)
    # Each copy meets the first with its stretch, so they are connected and need no pair each.
    at = {i: i for i in range(len(around))}
    for i, j in sorted(found):
        at = {k: min(at[i], at[j]) if v in (at[i], at[j]) else v for k, v in at.items()}
    assert all(at[i] == at[j] for i, j in copies)


def test_every_two_blocks_of_a_crowded_minimum_meet_once(monkeypatch):
    monkeypatch.setattr(passages, "_CROWD", 8)
    n = 100
    k, ids = np.full(n, 5), np.arange(n)
    pair, own, _, _, side, _ = passages._placed(k, ids, k, k, np.full(n, n), np.zeros((n, 1), np.int64))
    met = Counter()
    for p in np.unique(pair):
        held = list(zip(own[pair == p].tolist(), side[pair == p].tolist(), strict=True))
        assert len(held) < n / 2
        met.update(frozenset((a, b)) for (a, x), (b, y) in itertools.combinations(held, 2) if x != y or x == 2)
    assert met == Counter(frozenset(c) for c in itertools.combinations(range(n), 2))


def test_linked_texts_are_those_of_comparing_all(spark):
    """Every two texts that share 50 words are connected, and no text that shares none is named."""
    rng = random.Random(21)
    pool = [plain.prose(rng, rng.choice([25, 30, 55, 70]), 10**6) for _ in range(40)]
    texts = {}
    for i in range(200):
        parts = [rng.choice(pool) if rng.random() < 0.4 else plain.prose(rng, rng.randint(20, 60), 10**6) for _ in range(rng.randint(1, 5))]
        texts[i] = " ".join(parts)
    found = passages.near_passages(ship(spark).createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    at = {}
    for i, t in texts.items():
        w = plain.words(t)
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(i)
    linked = {(min(a, b), max(a, b)) for ids in at.values() for a in ids for b in ids if a != b}
    up = {i: i for i in texts}

    def root(i):
        return i if up[i] == i else root(up[i])

    for r in found:
        up[root(r.doc_id)] = root(r.match_id)
    lost = [pair for pair in linked if root(pair[0]) != root(pair[1])]
    assert len(linked) > 200 and len(lost) <= 0.01 * len(linked)
    named = {r.doc_id for r in found} | {r.match_id for r in found}
    shared = {i for pair in linked for i in pair}
    assert len(shared - named) <= 0.01 * len(shared)


def test_passages_of_odd_rows(odd, spark):
    _, docs = odd
    assert passages.near_passages(docs).count() > 0
    assert passages.near_passages(_empty(spark)).collect() == []
    texts = [plain.prose(random.Random(k), 70, 10**6) for k in range(5)]
    rows = [(1, texts[0]), (9, texts[1]), (9, texts[2]), (12, texts[3]), (12, texts[3]), (None, texts[4]), (None, texts[4]), (2, texts[0]), (13, texts[2]), (None, texts[0])]
    found = passages.near_passages(ship(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.match_id, r.doc_id) for r in found), key=plain.sort_key) == [(None, None), (1, None), (1, 2), (9, 13), (12, 12)]
    assert {(r.begin, r.end, r.similarity) for r in found} <= {(0, len(t), 1.0) for t in texts}


def test_compact_windows_cover_every_passage_once():
    rng = np.random.default_rng(3)
    offs = np.array([0, 100, 100, 115, 215])
    grams = rng.integers(0, 1 << 63, 215, dtype=np.uint64)
    value, row, place, left, right = passages.compact_windows(grams, offs, 0, 20)
    assert set(row) == {0, 3}
    for r in (0, 3):
        hashes = passages.mix(grams[offs[r] : offs[r + 1]] ^ passages.mix(np.array([1], np.uint64))) | np.uint64(1)
        for i in range(100):
            for j in range(i + 19, 100):
                covering = [k for k in np.flatnonzero(row == r) if place[k] - left[k] <= i <= place[k] <= j <= place[k] + right[k]]
                assert len(covering) == 1 and value[covering[0]] == hashes[i : j + 1].min()


def test_exact_dedup_against_its_statement(spark):
    import duckdb

    from anchorwake.llm import queries

    found = queries.QUERIES["op8_exact_dedup"](spark, "/root/testdata/sf0.01")
    with duckdb.connect() as database:
        database.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
        told = database.execute(queries.SQL["op8_exact_dedup"])
        names = [c[0] for c in told.description]
        expected = sorted(told.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == expected
    assert set(queries.SQL) < set(queries.QUERIES)


def test_stages_keep_the_values_of_all_columns(spark):
    """Also of columns whose names the operators use inside."""
    rng = random.Random(4)
    texts = [plain.prose(rng, 60, 10**6) for _ in range(6)]
    schema = "doc_id long, text string, _id long, _sha string, _own int, _key string, key int, turn int"
    rows = [(i, t, 700 + i, f"s{i}", i, f"k{i}", -i, i) for i, t in enumerate(texts)]
    docs = ship(spark).createDataFrame([*rows, (50, texts[0], 1, "x", 1, "x", 1, 1), (51, texts[1] + " more", 1, "x", 1, "x", 1, 1)], schema)
    for stage, dropped in ((exact.keep_first, {50}), (jaccard.keep_one, {50, 51})):
        kept = stage(docs)
        assert kept.schema == docs.schema
        assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id not in dropped)


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rng = random.Random(5)
    one, two, three = (plain.prose(rng, 60, 10**6) for _ in range(3))
    rows = [(1, one), (2, one + " more"), (2, two), (3, three), (3, three + " more"), (4, two), (None, one), (None, one)]
    kept = jaccard.keep_one(ship(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [(r.doc_id, r.text) for r in kept]
    assert (1, one) in texts and (2, one + " more") not in texts
    # Of a repeated id and a plain one the plain one stays; of two rows of one id one does.
    assert (4, two) in texts and (2, two) not in texts
    assert sum(i == 3 for i, _ in texts) == 1 and sum(i is None for i, _ in texts) == 2 and len(texts) == 5


def test_tables_on_the_way_are_deleted(spark):
    from pathlib import Path as Folder

    from anchorwake.llm import store

    docs = ship(spark).createDataFrame([(i, f"text of {i // 2} words and more of them") for i in range(10)], "doc_id long, text string")
    folder = Folder(store._folder(spark).removeprefix("file:"))
    before = set(folder.glob("*")) if folder.exists() else set()
    kept = store.stored_alone(lambda: jaccard.keep_one(docs), spark)
    assert len(set(folder.glob("*")) - before) == 1
    assert kept.count() == 5
