"""Keyword, coverage and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagrain.catalog import sqlkit as sk
from vitagrain.catalog.base import Catalog
from vitagrain.operators import matching as mt
from vitagrain.session import read_parts
from vitagrain.sources.scratch import stored
from vitagrain.sources.tables import read_table

catalog = Catalog()
query = catalog.query

DOC_TERMS = f"doc_terms AS ({sk.exploded('documents', 'doc_id')})"
ITEM_TERMS = f"item_terms AS ({sk.exploded('benchmark', 'item_id')})"
WEAK = ("len(list_filter(string_split(text, chr(10)), "
        "lambda x: trim(x) <> '' AND NOT regexp_matches(x, '[0-9]')))")
PAIRS = f"""{DOC_TERMS}, {ITEM_TERMS},
need AS (SELECT b.item_id, count(i.item_id) AS n_required FROM benchmark b LEFT JOIN item_terms i USING (item_id) GROUP BY 1),
stems AS (SELECT DISTINCT doc_id, stem FROM doc_terms),
hits AS (SELECT doc_id, item_id, CAST(count(*) AS INT) AS n_matched
         FROM item_terms JOIN stems USING (stem) GROUP BY 1, 2),
pairs AS (SELECT d.doc_id, n.item_id, coalesce(n_matched, 0) AS n_matched, n_required
          FROM documents d CROSS JOIN need n LEFT JOIN hits USING (doc_id, item_id)),
scored AS (SELECT doc_id, item_id, CAST(n_matched AS INT) AS n_matched, CAST(n_required AS INT) AS n_required,
           CASE WHEN n_required = 0 THEN 1.0 ELSE round_even(n_matched::DOUBLE / n_required, 4) END AS score
           FROM pairs)"""


def weak_lines():
    lines = F.split("text", "\n")
    return F.size(F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike("[0-9]")))


def corpus(spark, sf):
    return read_parts(read_table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def weighed_corpus(spark, sf):
    return stored(mt.document_stems(corpus(spark, sf).withColumn("weak_lines", weak_lines())))


def best_of_corpus(spark, sf, k=1):
    return mt.best_documents(weighed_corpus(spark, sf), read_table(spark, sf, "benchmark"), k)


@query("best_document_per_posting_o6_j14", f"""WITH {PAIRS},
weak AS (SELECT doc_id, {WEAK} AS weak_lines FROM documents)
SELECT item_id, doc_id, n_matched, n_required, score, CAST(weak_lines AS INT) AS weak_lines
FROM scored JOIN weak USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, weak_lines, doc_id) = 1""")
def best_document(spark, sf):
    return best_of_corpus(spark, sf).drop("rank")


@query("top_documents_per_posting_o6", f"""WITH {PAIRS},
weak AS (SELECT doc_id, {WEAK} AS weak_lines FROM documents)
SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, weak_lines, doc_id) AS INT) AS rank
FROM scored JOIN weak USING (doc_id) QUALIFY rank <= 5""")
def top_documents(spark, sf):
    return best_of_corpus(spark, sf, 5).select("item_id", "doc_id", "score", "rank")
