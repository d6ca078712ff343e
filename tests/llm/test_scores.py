"""Token counts, language, quality, page text, decontamination, packing and the pipeline."""

from __future__ import annotations

import random
import re
import sys
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from anchorwake.llm import decontaminate, language, packing, pages, quality, queries, store, tokens

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return plain.odd_documents(), plain.frame(spark, plain.odd_documents())


def _empty(spark):
    return spark.createDataFrame([], plain.SCHEMA)


# -- token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_are_the_library_s(odd, spark, library):
    rows, docs = odd
    found = tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    expected = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in rows]
    assert sorted((tuple(r) for r in found), key=plain.sort_key) == sorted(expected, key=plain.sort_key)
    assert tokens.token_counts(_empty(spark), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_token_counts_of_strange_strings(library):
    merger = tokens.PairMerger(public_tokenizers.path("byte_bpe_50k.json"), kept=50)
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "\x1c", "\x85", "\xa0", "　", "é", "漢", "٣", "½", "_", "-", "\U0001f642", "́", "<|endoftext|>", "<|endof", " the", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert merger.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_long_texts_are_counted_in_parts(library, monkeypatch):
    monkeypatch.setattr(tokens, "_LONG", 50)
    merger = tokens.PairMerger(public_tokenizers.path("byte_bpe_50k.json"))
    text = plain.prose(random.Random(3), 500) + "z" * 500
    assert merger.count(text) == len(library.encode(text, add_special_tokens=False).ids)


# -- language


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = queries.op3_language(spark, SMALL)
    met = found.join(docs, "doc_id").where("held_out AND text RLIKE '[[:alpha:]]'")
    right, total = met.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert found.count() == docs.count() and right >= 0.97 * total > 100


def test_language_of_odd_rows(odd, spark):
    rows, docs = odd
    found = language.identify(docs, F.lit(True), F.lit(False)).collect()
    assert len(found) == len(rows)
    known = {d: t for d, t, *_ in rows if d is not None}
    for r in found:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        if r.doc_id is not None and r.doc_id != 2:
            assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", known[r.doc_id] or ""))
    none = language.identify(docs, F.lit(False), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.identify(_empty(spark), F.lit(True), F.lit(False)).collect() == []


def test_language_scores_are_the_kernel_expansion():
    """The folded table of weights scores like the kernel against the landmarks, Nyström map and ridge weights."""
    rng = random.Random(4)
    texts = [plain.prose(rng, 30, 60) for _ in range(20)] + ["éè " * 20] * 2
    labels = ["a"] * 10 + ["b"] * 10 + ["c"] * 2
    new = [plain.prose(rng, rng.randint(3, 50), 60) for _ in range(30)] + ["è é è", "x"]
    model = language.fit(texts, labels, landmarks=22)
    present = [set(p.tolist()) for p in language._rows_of([*texts, *new])]
    kernel = np.array([[len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y))) for y in present[:22]] for x in present])
    values, vectors = np.linalg.eigh(kernel[:22])
    keep = values > values.max() * 1e-6
    mapped = kernel @ (vectors[:, keep] / np.sqrt(values[keep]))
    target = np.where(np.array(labels)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    weight = np.diag([1 / labels.count(x) for x in labels])
    # Ridge regression around the mean of the sample and the weighted mean of the targets.
    inner, level = mapped - mapped[:22].mean(0), (weight @ target).sum(0) / np.trace(weight)
    gram = inner[:22].T @ weight @ inner[:22] + 1e-2 * np.trace(weight) / 22 * np.eye(inner.shape[1])
    votes = inner @ np.linalg.solve(gram, inner[:22].T @ weight @ (target - level)) + level
    shares = np.exp(2 * votes) / np.exp(2 * votes).sum(1, keepdims=True)
    names, scores = language.predict(model, pa.array([*texts, *new]))
    assert scores == pytest.approx(shares.max(1), abs=2e-3)
    sure = np.sort(shares, 1)[:, -1] - np.sort(shares, 1)[:, -2] > 0.01
    assert [n for n, s in zip(names, sure, strict=True) if s] == [n for n, s in zip(np.array(["a", "b", "c"])[votes.argmax(1)].tolist(), sure, strict=True) if s]
    assert names[20] == names[-2] == "c" and scores[20] == scores[21]


# -- quality


def test_quality_of_held_out_rows(spark):
    found = queries.op6_quality(spark, SMALL)
    met = found.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = met.score[met.quality == 1].to_numpy(), met.score[met.quality == 0].to_numpy()
    assert found.count() == 1000 and (good[:, None] > bad[None]).mean() > 0.95
    assert (met.predicted == met.quality).mean() > 0.9


def test_quality_of_odd_rows(odd, spark):
    rows, docs = odd
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 1), (None, 1, 1), (5, None, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, labels, F.lit(True), F.lit(False)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    none = quality.quality_scores(docs, labels.limit(0), F.lit(True), F.lit(False)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(_empty(spark), labels, F.lit(True), F.lit(False)).collect() == []
    assert quality.keep_good(docs, labels.limit(0), F.lit(True)).count() == len(rows)


def test_pairs_in_linear_time():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    x = quality.Sparse(np.array([0, 3, 8, 2, 2, 5]), rng.normal(size=6), np.array([0, 3, 6]))
    value, _ = quality.margins(machine, x)
    for row in range(2):
        at = slice(x.offs[row], x.offs[row + 1])
        places, values = x.places[at], x.values[at]
        pairs = sum(machine.factors[places[i]] @ machine.factors[places[j]] * values[i] * values[j] for i in range(3) for j in range(i))
        assert value[row] == pytest.approx(0.3 + machine.weights[places] @ values + pairs)


# -- pages

_PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body class=home>"
    '<div class="site-header">Site name</div><div class="main-menu"><ul><li><a href=x>Home page<li><a>Other</a></ul></div>'
    '<div class="post-content"><h1>Title &eacute;</h1><p>First   paragraph with <b>bold</b> and <a href="a>b">a link</a>,\n more text.'
    "<p>Second &lt;x&gt; is longer and has many words in it&nbsp;too<ul><li>item one<li>item two</ul>"
    '<div class="advert">Buy now things</div><form>Name <input></form><!-- a comment <p>no</p> -->'
    '<p>Last paragraph closes the article with words.</p></div><div class="comments"><p>I like this very much, thanks.</p></div>'
    "<footer>All rights</footer>"
)
_TEXT = (
    "Title é\nFirst paragraph with bold and a link, more text.\nSecond <x> is longer and has many words in it too\n"
    "item one\nitem two\nLast paragraph closes the article with words."
)


def test_page_without_marks():
    model = pages.fit(["<nav>a b c</nav><article><h1>d</h1><p>e f g h</p></article><footer>i j</footer>"] * 3)
    assert pages.main_text(model, _PAGE) == _TEXT
    assert pages.main_text(pages.fit([]), _PAGE) == _TEXT


def test_page_text_is_the_article(spark):
    found = {r.page_id: r for r in queries.op2_main_text(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(pages.html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inside)]
        text = "\n".join(b for b in blocks if b)
        assert (found[r.page_id].text, found[r.page_id].n_chars) == (text, len(text))


def test_odd_pages(spark):
    htmls = [None, "", "<", "<p", "<p>unclosed", "</p></div>text", "<script>x", "<!-- open", "plain words only", "&#x41;&amp", "<a b='", "<div>" * 2000 + "deep", "<p>a " * 5000]
    rows = [(i, None if i == 3 else "u", h, "x") for i, h in enumerate(htmls)] + [(None, "u", "<p>some words here</p>", "x")] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = pages.extract(frame).collect()
    assert len(found) == len(rows) and all(len(r.text) == r.n_chars for r in found)
    assert [r.text for r in found if r.page_id in (0, 1, 6, 7)] == [""] * 4
    assert pages.extract(frame.limit(0)).collect() == []


_LONG = " ".join(f"word{i}" for i in range(120))


@pytest.mark.parametrize("body", ["<body>", "<body class='single no-sidebar'>", "<body class='has-header wide'>", "<body class='comments-open'>", "<body class=menu-closed>", "<body><div class='layout has-sidebar'>"])
@pytest.mark.parametrize("mark", ["<article>", "<article class='post promo'>", "<main id=content>", "<div class='post-content'>"])
def test_names_of_the_layout_do_not_hide_the_text(body, mark):
    model = pages.fit(["<nav>a b c</nav><div class=ad>x y</div><article><h1>d</h1><p>e f g h</p></article><footer>i j</footer>"] * 3)
    page = f"<html>{body}<nav><a>home</a></nav>{mark}<p>{_LONG}</p><div class=ad>buy this</div><p>{_LONG}</p></article></main><footer>all rights</footer>"
    assert pages.main_text(model, page) == f"{_LONG}\n{_LONG}"


def test_comments_in_articles_are_no_text():
    model = pages.fit(["<nav>a b c</nav><article><p>e f g h</p></article><footer>i j</footer>"] * 3)
    comments = f"<section class=comments><article class=comment><p>{_LONG}</p></article></section>"
    assert pages.main_text(model, f"<body><article><p>{_LONG}</p></article>{comments}") == _LONG
    assert pages.main_text(model, f"<body><article><p>{_LONG}</p>{comments}</article>") == _LONG


@pytest.mark.parametrize(
    "page",
    ["<div><span>" * 8000, "<b>x</i>" * 8000, "<b>" * 8000 + "<div></div>" * 8000, "<p><section>" + "<b>" * 8000 + "<div>a</div>" * 8000, "".join(f"<div class='c{i}'>" for i in range(8000))],
    ids=["nested", "stray", "inline", "shielded", "names"],
)
def test_broken_pages_are_parsed_in_linear_time(page):
    model = pages.fit(["<nav>a b c</nav><article><p>e f g h</p></article>"])
    began = time.process_time()
    pages.main_text(model, page)
    assert time.process_time() - began < 2


def test_only_the_sample_of_pages_reaches_the_driver(spark, monkeypatch):
    rows = [(i % 3, f"<article><p>text {i % 50}</p></article>") for i in range(300)] + [(7, "<article>" + "x" * 5000), (8, "<p>no mark</p>")]
    frame = spark.createDataFrame(rows, "page_id long, html string")
    monkeypatch.setattr(pages, "fit", lambda found: found)
    assert len(pages.train(frame, 20)) == 20
    every = pages.train(frame, 100, 1000)
    assert len(every) == len(set(every)) == 50


def test_best_run_of_scores():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        begin, end = pages.region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[begin:end]) == max(0, best)


def test_one_row_of_a_repeated_id_is_in_the_samples(spark, monkeypatch):
    rows = [(1, f"many texts of one id {k}", "en") for k in range(50)] + [(k, f"another text {k}", "en") for k in (2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    everything = docs.doc_id.isNotNull()
    monkeypatch.setattr(language, "fit", lambda texts, names: texts)
    assert len(language.train(docs, everything)) == 3
    monkeypatch.setattr(quality, "fit", lambda x, y: y)
    assert len(quality.train(docs, labels, labels.doc_id.isNotNull())) == 3


# -- decontamination


def _changed(rng, words, rate):
    out = list(words)
    for _ in range(int(rate * len(words))):
        k = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[k] = f"changed{rng.getrandbits(30)}"
        elif kind < 0.75 and len(out) > 1:
            del out[k]
        else:
            out.insert(k, f"more{rng.getrandbits(30)}")
    return out


def test_changed_items_are_found(spark):
    rng = random.Random(9)
    items = [(i, plain.prose(rng, rng.randint(20, 60))) for i in range(60)]
    rows = []
    for rate, first in ((0.0, 0), (0.1, 100), (0.2, 200)):
        for i, text in items:
            inner = _changed(rng, text.split(" "), rate)
            rows.append((first + i, f"{plain.prose(rng, 80)} {' '.join(inner).upper()} {plain.prose(rng, 30)}"))
    rows += [(1000 + k, plain.prose(rng, 300)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    for first, least in ((0, 1.0), (100, 0.95), (200, 0.9)):
        assert len({i for i, _ in items if (first + i, i) in pairs}) >= least * len(items)
    assert not [p for p in pairs if p[0] >= 1000]
    texts, by_item = dict(rows), dict(items)

    def normal(text):
        return re.findall(r"[^\W_]+", text.lower())

    for r in found:
        stretch = normal(texts[r.doc_id].encode()[r.begin : r.end].decode())
        item = normal(by_item[r.item_id])
        assert plain.edit_distance(item, stretch) == r.edits <= 0.2 * len(item) and r.item_words == len(item)
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert kept == set(texts) - {d for d, _ in pairs}
    blocks = decontaminate.contaminated(docs, bench, block=2000).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} >= {p for p in pairs if p[0] < 100}


def test_short_items_with_frequent_words_first_are_found(spark):
    rng = random.Random(14)
    frequent = "what is the name of the one that was in a of".split(" ")
    items = [(i, " ".join([*frequent[: n // 2], *plain.prose(rng, n - n // 2, 10**6).split(" ")])) for i, n in enumerate(list(range(8, 15)) * 8)]
    rows = []
    for rate, first in ((0.0, 0), (0.2, 100)):
        for i, text in items:
            rows.append((first + i, f"{plain.prose(rng, 40)} {' '.join(_changed(rng, text.split(' '), rate))} {plain.prose(rng, 30)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    pairs = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert pairs >= {(first + i, i) for first in (0, 100) for i, _ in items}
    assert decontaminate.keep_clean(docs, bench).count() == 0


def test_decontamination_of_odd_rows(odd, spark):
    rows, docs = odd
    bench = spark.createDataFrame([(0, "one two"), (1, ""), (2, None), (None, "one"), (3, rows[0][1]), (3, rows[0][1])], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    has_two = {d for d, t, *_ in rows if "one two" in (t or "")}
    assert {d for d, i in found if i == 0} == has_two
    assert {d for d, i in found if i == 3} >= {d for d, t, *_ in rows if t == rows[0][1]}
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(_empty(spark), bench).collect() == []
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns


def test_items_without_an_id_are_found(spark):
    rng = random.Random(15)
    items = [(None, plain.prose(rng, n, 10**6)) for n in (3, 12, 40)] + [(7, plain.prose(rng, 20, 10**6))]
    rows = [(i, f"{plain.prose(rng, 30)} {text} {plain.prose(rng, 30)}") for i, (_, text) in enumerate(items)] + [(9, plain.prose(rng, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(0, None), (1, None), (2, None), (3, 7)}
    assert [r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()] == [9]


# -- packing


@pytest.mark.parametrize(("capacity", "block"), [(64, 20_000), (300, 10), (2048, 20_000)])
def test_bins_hold_no_conflict_and_all_text(odd, spark, capacity, block):
    rows, docs = odd
    found = packing.pack(docs, capacity, block=block).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        bins[r.bin_id].append(r)
        pieces[r.doc_id].append(r)
    for held in bins.values():
        assert sum(r.n_tokens for r in held) <= capacity
        assert len({r.source for r in held}) == len({r.cluster for r in held}) == len(held)
    assert sum(r.n_tokens for r in found) == sum(-(-len(t or "") // 4) + 1 for _, t, *_ in rows)
    assert sum(r.end - r.begin for r in found) == sum(len(t or "") for _, t, *_ in rows)
    assert sum(r.piece == 0 for r in found) == len(rows)
    assert packing.pack(_empty(spark)).collect() == []


def test_equal_rows_without_an_id_are_dealt_to_several_blocks(spark):
    docs = spark.range(2000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same text' AS text", "CAST(NULL AS STRING) AS source").repartition(3)
    found = packing.pack(docs, block=100).selectExpr("bin_id >> 32 AS block").groupBy("block").count().collect()
    assert len(found) == 20 and max(r["count"] for r in found) < 200


def test_tightest_compatible_bin_is_chosen():
    rng = random.Random(7)
    bins, plain_bins = packing.Bins(40), []  # [room, sources, clusters]
    for _ in range(3000):
        size, source, cluster = rng.randint(1, 40), 1 << rng.randrange(6), rng.choice([0, 0, 1, 2, 4])
        fitting = [(b[0], k) for k, b in enumerate(plain_bins) if b[0] >= size and not b[1] & source and not b[2] & cluster]
        number = bins.place(size, source, cluster)
        if not fitting:
            assert number == len(plain_bins)
            plain_bins.append([40, 0, 0])
        else:
            assert plain_bins[number][0] == min(fitting)[0]
        b = plain_bins[number]
        assert b[0] >= size and not b[1] & source and not b[2] & cluster
        plain_bins[number] = [b[0] - size, b[1] | source, b[2] | cluster]


# -- pipeline


def test_pipeline_stages_against_plain_versions(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, texts = rows, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = store.stored(stage(spark, docs, SMALL))
        if name == "packed":
            break
        assert docs.columns == rows.columns
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert texts.items() <= before.items()
        if name == "good_quality":
            known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            assert sum(known.get(d) == 1 for d in before.keys() - texts.keys()) <= 3
            assert sum(known.get(d) == 0 for d in texts) <= 5
        elif name == "distinct_texts":
            first: dict = {}
            for d in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[d]), d)
            assert set(texts) == set(first.values())
        elif name == "distinct_content":
            assert set(texts) == {d for d, c in plain.components(before, 5, 80).items() if c == d}
        elif name == "without_benchmark":
            items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            flat = {d: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} " for d, t in before.items()}
            leaked = {d for d, t in flat.items() if any(f" {' '.join(i)} " in t for i in items)}
            assert leaked and set(texts) == set(before) - leaked
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(texts)
    assert sum(r.end - r.begin for r in packed) == sum(len(t) for t in texts.values())
