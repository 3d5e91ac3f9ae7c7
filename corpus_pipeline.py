"""The corpus pipeline: each stage takes the documents that the one before kept.

1. toxicity: documents scored as toxic go (maximum-scoring segments of token log-odds).
2. lines: of lines equal or alike across the corpus one stays; documents that lose
   every line go, others keep the rest of their text.
3. near duplicates: one document of each group stays (five words, similarity 0.8).
4. privacy: personal data is replaced by keyed surrogates.
5. packing: token ids of the documents, packed into sequences.

Stages 1 to 4 return the columns of their input. A stage works on every row it is
given, in any number of tasks, and keeps what it reuses in the shared folder. `run`
writes what each stage keeps there as well and hands on the rows read again, so no
stage repeats an earlier one's work and a lost executor costs its own tasks.

Defined cases: null and empty texts pass all stages; very long texts are taken whole;
repeated rows are rows of their own to toxicity and privacy, lose their lines as
copies do, and of the rows of one group the smallest doc_id stays; ties follow doc_id;
extra columns, whatever their names, are kept up to packing, which returns its own;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitagrain.llm import line_dedup, ngram_join, packing, surrogates, toxicity
from vitagrain.llm.common import shared_folder, table, written
from vitagrain.llm.queries import WORD_VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones among `docs`."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that another place of the corpus keeps."""
    return line_dedup.drop_emptied(docs, shingle=line_dedup.FINE)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs, size=5, num=4, den=5)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return surrogates.replace(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in the packed sequences."""
    return packing.pack(docs, WORD_VOCABULARY, end_id=2).withColumnRenamed("carried", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", keep_clean),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_documents),
    ("surrogates", hide_private),
    ("packing", pack),
]
#: SQL cannot express the fitted scores, the linked lines and the tokens of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents, each reading what the one before wrote."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, folder, f"{k}_{name}")
    return docs
