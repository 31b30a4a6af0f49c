"""Registered queries of the operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsignals.llm import (adaptive_rules, bucket_refinement, entropy_mixing, license_scan, mil_quality, minhash_forest, oracles, packing, prefix_trie,
                             rlz_dedup, run_detection, simhash_vptree, topk_search, warc)
from shopsignals.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_warc_archive", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
             CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d""")
def op1(spark, sf_dir):
    """Every page written as a WARC record and read back."""
    return warc.archive_pages(spark, sf_dir)


@query("op2_vector_packing")
def op2(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op3_suffix_dedup", oracles.SUFFIX_DEDUP)
def op3(spark, sf_dir):
    """All documents without the bytes of 100-byte strings that start earlier."""
    return bucket_refinement.remove_repeated_bytes(read(spark, sf_dir, "documents"), 100)


@query("op4_exact_topk", """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def op4(spark, sf_dir):
    """The ten best candidates of every query vector."""
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op5_substring_dedup", oracles.SUBSTRING_DEDUP)
def op5(spark, sf_dir):
    """All documents without the words of repeated 35-word windows."""
    return rlz_dedup.kept_words(read(spark, sf_dir, "documents"), 35)


@query("op6_mil_quality")
def op6(spark, sf_dir):
    """Quality scores of all documents, learned from the labels not held out."""
    documents = read(spark, sf_dir, "documents")
    return mil_quality.score(documents, mil_quality.train(documents, read(spark, sf_dir, "labels")), 0.3)


@query("op7_jaccard_forest", oracles.JACCARD_JOIN)
def op7(spark, sf_dir):
    """Near-duplicate groups of all documents at similarity 0.8."""
    return minhash_forest.classes(read(spark, sf_dir, "documents"), 0.8)


@query("op8_adaptive_rules", oracles.RULES)
def op8(spark, sf_dir):
    """Counts and verdicts of all documents under their group's thresholds."""
    return adaptive_rules.verdicts(read(spark, sf_dir, "documents"))


@query("op9_entropy_mixing")
def op9(spark, sf_dir):
    """All documents mixed to 150% of their words at weights 5, 2, 1."""
    return entropy_mixing.taken_words(read(spark, sf_dir, "documents"))


@query("op10_license_scan", license_scan.DOCUMENTS_SQL)
def op10(spark, sf_dir):
    """Licences of all documents, by header, licence file or nearest folder."""
    return license_scan.scan_documents(read(spark, sf_dir, "documents"))


@query("op11_run_detection")
def op11(spark, sf_dir):
    """Periodic runs of words in all documents, runs planted by id included."""
    return run_detection.run_digests(read(spark, sf_dir, "documents"), rewrite=True)


@query("op12_prefix_trie", oracles.PREFIX_TRIE)
def op12(spark, sf_dir):
    """The prefix trie of all conversations, rebuilt."""
    return prefix_trie.rebuilt_trie(read(spark, sf_dir, "conversations"))


@query("op13_simhash_vptree")
def op13(spark, sf_dir):
    """SimHash fingerprints and components of all documents at three bits."""
    return simhash_vptree.components_by_fingerprint(read(spark, sf_dir, "documents"), 3)
