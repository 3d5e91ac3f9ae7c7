"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitagrain.llm import (
    bpe, clusters, contamination, line_dedup, mask_search, neural_lsh, ngram_join, packing, spotsigs, store, surrogates, toxicity, urls,
)
from vitagrain.llm.common import shared_folder, table

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.edited_likeness(table(spark, folder, "documents"))


def op2_neural_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return neural_lsh.search(table(spark, folder, "embeddings"), "pmod(vec_id, 50) = 0")


def op3_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), BYTE_VOCABULARY)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, kept="n_kept", every="n_lines", shingle=line_dedup.FINE).select("doc_id", "n_lines", "n_kept", "text")


def op6_token_store(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/store"
    store.write(table(spark, folder, "documents"), path, BYTE_VOCABULARY, end_id=0)
    return store.digest(spark, path)


def op4_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digest(table(spark, folder, "documents"), WORD_VOCABULARY, end_id=2)


def op7_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace(docs, count="n_entities").select("doc_id", "n_entities", "text")


def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages").select("page_id", "url")).drop("url")


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.classes(table(spark, folder, "documents"), size=4, num=85, den=100)


def op11_prefix_containment(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_mask_search(spark: SparkSession, folder: str) -> DataFrame:
    return mask_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clustered(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spot_signatures": op1_spot_signatures,
    "op2_neural_lsh": op2_neural_lsh,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_store": op6_token_store,
    "op7_toxic_segments": op7_toxic_segments,
    "op8_surrogates": op8_surrogates,
    "op9_url_rules": op9_url_rules,
    "op10_ngram_join": op10_ngram_join,
    "op11_prefix_containment": op11_prefix_containment,
    "op12_mask_search": op12_mask_search,
    "op13_centroid_clusters": op13_centroid_clusters,
}
ORACLE_SQL: dict[str, str] = {
    "op9_url_rules": urls.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
    "op11_prefix_containment": contamination.ORACLE,
    "op12_mask_search": mask_search.ORACLE,
    "op13_centroid_clusters": clusters.oracle(),
}
