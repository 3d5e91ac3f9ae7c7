"""Whole-word matches of texts with a dictionary table of any size.

A text is cut into pieces, runs of word characters and what stands between them, and
so is every term. A term stands alone in a text exactly where as many pieces as it has
begin with a word piece and read the same, so matching is an equi-join of n-grams of
pieces with terms: no pattern is built from a term, and the plan is the same for ten
terms and for millions. Only the distinct term lengths are read ahead, as a scalar
subquery. A small dictionary is broadcast by the optimizer's own size test, a large
one is shuffled; hand in a stored table so that its size is known.

Terms that do not begin and end with a word character never stand alone in this sense;
``matches`` also takes them from the keywords of a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.functions import sqltext as st
from vitagrain.functions import tokens as tk

#: Characters of a word.
WORD = r"\p{L}\p{N}_"


def pieces(text: str, word: str = WORD) -> str:
    """Words and what stands between them, in order."""
    return f"regexp_extract_all({text}, {st.raw(f'[{word}]+|[^{word}]+')}, 0)"


def _terms(dictionary: DataFrame, word: str) -> DataFrame:
    """Lower-case terms that can stand alone, with their number of pieces and all other columns.

    The test stands inside an array: as a filter the optimizer would infer it for the other
    side of the join and run it, gram and all, on every n-gram of the texts.
    """
    alone = f"t RLIKE {st.raw(f'^[{word}]')} AND t RLIKE {st.raw(f'[{word}]$')}"
    terms = dictionary.withColumn("term", F.explode(F.expr(f"filter(array(lower(term)), t -> {alone})"))).distinct()
    return terms.withColumn("n", F.expr(f"size({pieces('term', word)})"))


def _cut(texts: DataFrame, key: str, text: str, terms: DataFrame, word: str) -> DataFrame:
    sizes = terms.agg(F.array_sort(F.collect_set("n")).alias("sizes")).scalar()
    cut = texts.select(key, F.expr(pieces(f"lower(coalesce({text}, ''))", word)).alias("p"), sizes.alias("sizes"))
    # (texts without pieces have no n-grams either; a filter on p would be pushed down and cut every text twice)
    first = f"CASE WHEN get(p, 0) RLIKE {st.raw(f'^[{word}]')} THEN 1 ELSE 2 END"
    return cut.withColumn("first", F.expr(first))


def mentions(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", word: str = WORD) -> DataFrame:
    """Every place where a term stands alone: key, at (first piece, from 1), n (pieces), term, and the dictionary's columns."""
    terms = _terms(dictionary, word)
    cut = _cut(texts, key, text, terms, word).withColumn("n", F.explode("sizes")).where("size(p) - n + 1 >= first")
    grams = cut.select(key, "n", "p", F.explode(F.expr("sequence(first, size(p) - n + 1, 2)")).alias("at"))
    grams = grams.select(key, "at", "n", F.expr(
        "CASE WHEN n = 1 THEN get(p, at - 1) ELSE array_join(slice(p, at, n), '') END").alias("term"))
    return grams.join(terms.drop("n"), "term").select(key, "at", "n", "term", *[c for c in dictionary.columns if c != "term"])


def longest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mentions that no longer one covers: a hit inside another, or begun by it, drops out."""
    before = Window.partitionBy(key).orderBy("at", F.col("n").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.col("at") + F.col("n")).over(before)  # a group is the mentions of one text
    return found.withColumn("covered", covered).where("covered IS NULL OR at + n > covered").drop("covered")


def matches(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct terms that a text names, standing alone or as a keyword: key and the dictionary's columns."""
    terms = _terms(dictionary, WORD)
    cut = _cut(texts, key, text, terms, WORD)
    every = ("array_distinct(flatten(transform(filter(sizes, n -> size(p) - n + 1 >= first), n -> "
             "transform(sequence(first, size(p) - n + 1, 2), i -> CASE WHEN n = 1 THEN get(p, i - 1) ELSE array_join(slice(p, i, n), '') END))))")
    alone = cut.select(key, F.explode(F.expr(every)).alias("term")).join(terms.drop("n"), "term")
    named = texts.select(key, F.explode(F.expr(tk.keywords(text))).alias("term"))
    named = named.join(dictionary.withColumn("term", F.lower("term")).distinct(), "term")
    columns = [key, *dictionary.columns]
    return alone.select(columns).union(named.select(columns)).distinct()
