"""One query per operator, over its whole table, and the SQL that says the same where there is one."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from anchorwake.llm import (
    codes,
    decontaminate,
    exact,
    jaccard,
    language,
    packing,
    pages,
    passages,
    pii,
    quality,
    search,
    substrings,
    tokens,
)
from anchorwake.llm.ship import ship

TOKENIZER_CONF = "spark.anchorwake.tokenizer"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """Where the vocabulary lies on every machine: a session setting, else the installed package."""
    folder = spark.conf.get(TOKENIZER_CONF, None)
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language.remainder("doc_id", 4) == 2
    return language.identify(table(spark, sf_dir, "documents"), ~held_out, held_out)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality.remainder("doc_id", 5) == 0
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, held_out)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


_BY_NAME = {
    f.__name__: f
    for f in (
        op1_repeated_bytes, op2_main_text, op3_language, op4_decontamination, op5_packing,
        op6_quality, op7_jaccard_join, op8_exact_dedup, op9_token_counts, op10_passages,
        op11_ranked_search, op12_pii, op13_vector_codes,
    )
} | {"pipeline": corpus_pipeline.run}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: lambda spark, sf_dir, query=query: query(ship(spark), sf_dir) for name, query in _BY_NAME.items()
}


def _lloyd_sql(rounds: int = 2) -> str:
    """Parts against all entries of their position, in every round."""
    nearest = (
        "SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.vec_id, x.p, b.e, "
        "list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d "
        "FROM parts x JOIN book{i} b ON x.p = b.p) GROUP BY vec_id, p"
    )
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v "
        "FROM embeddings WHERE embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "cut AS (SELECT vec_id, unnest(range(16)) AS p, v, len(v) // 16 AS w FROM kept)",
        "parts AS (SELECT vec_id, p, v[p * w + 1 : (p + 1) * w] AS v FROM cut)",
        "seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64)",
        "book0 AS (SELECT p, e, v FROM parts JOIN seeds USING (vec_id))",
    ]
    for i in range(rounds):
        steps += [
            f"near{i} AS ({nearest.format(i=i)})",
            f"sums{i} AS (SELECT p, e, k, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, "
            f"unnest(range(len(v))) AS k FROM near{i} JOIN parts USING (vec_id, p)) GROUP BY p, e, k)",
            f"mean{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS v FROM sums{i} GROUP BY p, e)",
            f"book{i + 1} AS (SELECT p, e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN mean{i} m USING (p, e))",
        ]
    steps += [
        f"last AS ({nearest.format(i=rounds)})",
        "coded AS (SELECT vec_id, string_agg(format('{:02x}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY vec_id)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})",
    ]
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, "
        "h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest"
    )


SQL = {
    "op8_exact_dedup": r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM plain WINDOW w AS (PARTITION BY t)
""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), total AS (SELECT count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_terms FROM d
), sizes AS (SELECT doc_id, 75 + (25 * count(*) * any_value(n_docs)) // any_value(n_terms) AS m FROM d, total GROUP BY doc_id
), tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d SEMI JOIN q USING (term) GROUP BY doc_id, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
""",
    "op13_vector_codes": _lloyd_sql(),
}
