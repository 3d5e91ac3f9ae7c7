"""Keyword coverage of documents against postings.

Two access paths share one definition of a match:

* ``score_pairs`` - a given list of (document, posting) pairs. Both sides are
  joined by id and compared inside the row, so the cost is linear in the pairs.
* ``best_documents`` - the exact top documents per posting without meeting every
  document that shares a stem. Lists of documents are read from the rarest stem
  on; a few promising documents are completed to learn a score that the k-th best
  reaches at least, and from there only lists that a document of that score can't
  avoid, and only documents whose bound still reaches it.

A stem that many postings ask for is split into slots of postings, so no stem
gathers all of them in one task; a stem of many documents is left to the
adaptive skew join. Nothing is broadcast by hand or brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st
from vitagrain.functions import tokens as tk
from vitagrain.sources.scratch import stored

#: Postings of one stem that share a join key.
POSTINGS_PER_SLOT = 1_000
#: Documents of the rarest lists that a posting tries first; steers cost only.
SEEDS = 300
#: Of these, so many per wanted document are completed.
TRIED = 16


def round_score(value: Column) -> Column:
    """Four decimals, half to even."""
    return F.bround(value, 4)


def with_keywords(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace a text by its keyword array."""
    return df.withColumn("keywords", F.expr(tk.keywords(text))).drop(text)


def document_stems(docs: DataFrame) -> DataFrame:
    """(..., stems): the stems of a text in its place."""
    return with_keywords(docs).withColumn("stems", F.expr(tk.stems("keywords"))).drop("keywords")


def posting_terms(postings: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, n_required, stem, n_terms): how many required terms share a stem.

    A posting without keywords is one row without a stem.
    """
    return (
        with_keywords(postings)
        .withColumn("n_required", F.size("keywords"))
        .select(key, "n_required", F.explode_outer("keywords").alias("keyword"))
        .withColumn("stem", F.expr(tk.stem("keyword")))
        .groupBy(key, "n_required", "stem")
        .agg(F.count("keyword").alias("n_terms"))
    )


def overlaps(doc_stems: DataFrame, terms: DataFrame, key: str = "item_id") -> DataFrame:
    """Matched count of every document and posting that share a stem."""
    terms = terms.filter("stem IS NOT NULL")
    slots = terms.groupBy("stem").agg(F.ceil(F.count("*") / POSTINGS_PER_SLOT).alias("slots"))
    asked = terms.join(slots, "stem").withColumn("slot", F.expr(f"pmod(xxhash64({key}), slots)"))
    held = (
        doc_stems.select("doc_id", "weak_lines", F.explode_outer("stems").alias("stem"))
        .join(slots, "stem")
        .withColumn("slot", F.explode(F.expr("sequence(0L, slots - 1)")))
    )
    met = held.drop("slots").join(asked.drop("slots"), ["stem", "slot"])
    return met.groupBy("doc_id", "weak_lines", key, "n_required").agg(
        F.sum("n_terms").cast("int").alias("n_matched"))


def with_score(counted: DataFrame) -> DataFrame:
    """The score; a posting that asks for nothing is met in full."""
    return counted.withColumn("score", round_score(
        F.when(F.col("n_required") == 0, F.lit(1.0)).otherwise(F.col("n_matched") / F.col("n_required"))))


def rare_first(doc_stems: DataFrame, terms: DataFrame, key: str = "item_id") -> DataFrame:
    """Posting terms with the length of their stem's list and, in rare-first order, what comes before and after.

    ``seen`` counts the documents of the lists up to and including this one; ``rest``
    is the most that a document in none of these lists can still match.
    """
    terms = terms.filter("stem IS NOT NULL")
    asked = terms.select("stem").distinct()
    lengths = doc_stems.select(F.explode("stems").alias("stem")).join(asked, "stem", "left_semi").groupBy("stem").agg(
        F.count("*").alias("n_docs"))
    order = Window.partitionBy(key).orderBy("n_docs", "stem")  # a group is the terms of one posting
    return (
        terms.join(lengths, "stem")
        .withColumn("seen", F.sum("n_docs").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("rest", F.sum("n_terms").over(order.rowsBetween(1, Window.unboundedFollowing)))
        .withColumn("list", F.row_number().over(order))
        .fillna(0, ["rest"])
    )


def _complete(pairs: DataFrame, doc_stems: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Full counts of given pairs, inside the row: (doc_id, weak_lines, key, n_required, n_matched).

    Every stem in common counts once, and again for each further term that shares it.
    """
    counted = st.let("hs", "array_intersect(term_stems, stems)", "size(hs) + size(filter(again, s -> array_contains(hs, s)))")
    parts = int(doc_stems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.select("doc_id", key).join(items, key).repartition(parts, "doc_id").join(doc_stems, "doc_id")
    return met.select("doc_id", "weak_lines", key, "n_required", F.expr(counted).alias("n_matched"))


def rounded(count: str) -> Column:
    """The score that a count of matched terms gives."""
    return round_score(F.expr(f"{count} / n_required"))


def candidates(doc_stems: DataFrame, terms: DataFrame, items: DataFrame, k: int, key: str = "item_id",
               seeds: int = SEEDS) -> DataFrame:
    """Pairs of a posting and a document that can be among its k best: (key, doc_id).

    Seeds are the documents of the rarest lists, up to ``seeds`` of them per posting
    but one list at least; the best of these are completed, and the k-th best count is
    a floor. A document that reaches the floor stands in one of the first lists whose
    rest falls short of it, so only these are joined. There it has matched some terms
    and can match the rest at most; the sum is its bound.
    """
    ranked = stored(rare_first(doc_stems, terms, key))
    first = ranked.filter((F.col("list") == 1) | (F.col("seen") <= seeds))
    partial = overlaps(doc_stems, first.select(key, "n_required", "stem", "n_terms"), key)
    likely = Window.partitionBy(key).orderBy(F.col("n_matched").desc(), "doc_id")
    tried = partial.withColumn("place", F.row_number().over(likely)).filter(F.col("place") <= TRIED * k)
    best = Window.partitionBy(key).orderBy(F.col("n_matched").desc(), "doc_id")
    floor = (
        _complete(tried, doc_stems, items, key).withColumn("place", F.row_number().over(best))
        .filter(F.col("place") == k).select(key, F.col("n_matched").alias("floor"))
    )
    bounded = ranked.join(floor, key, "left").fillna(0, ["floor"])
    needed = bounded.filter(rounded("(rest + n_terms)") >= rounded("floor"))  # the rest before this list
    needed = stored(needed.withColumn("rest", F.min("rest").over(Window.partitionBy(key))))
    found = overlaps(doc_stems, needed.select(key, F.struct("n_required", "floor", "rest").alias("n_required"), "stem", "n_terms"), key)
    found = found.select(key, "doc_id", "n_matched", "n_required.*")
    return found.filter(rounded("(n_matched + rest)") >= rounded("floor")).select(key, "doc_id")


def best_documents(doc_stems: DataFrame, postings: DataFrame, k: int = 1, key: str = "item_id") -> DataFrame:
    """Top k documents per posting: score, then fewer weak lines, then id.

    ``doc_stems`` is (doc_id, weak_lines, stems). It is read several times, so hand in a
    stored table; the terms of the postings and their lists are stored here. Every posting gets k documents: beside the candidates, the k first
    documents of the tie order stand in, which is all that a posting without keywords,
    or without overlap, has to choose from.
    """
    items = required_terms(with_keywords(postings), key).withColumn("n_required", F.size("terms")).drop("terms")
    again = "filter(term_stems, (s, i) -> array_position(term_stems, s) <= i)"
    items = stored(items.withColumn("again", F.expr(again)))
    terms = items.select(key, "n_required", F.explode_outer("term_stems").alias("stem"))
    terms = terms.groupBy(key, "n_required", "stem").agg(F.count("stem").alias("n_terms"))
    first = doc_stems.select("doc_id", "weak_lines").orderBy("weak_lines", "doc_id").limit(k)
    idle = items.select(key, "n_required").distinct().join(F.broadcast(first)).withColumn("n_matched", F.lit(0))  # k documents
    pairs = candidates(doc_stems, terms, items, k, key)
    counted = _complete(pairs, doc_stems, items, key).unionByName(idle)
    counted = counted.groupBy("doc_id", "weak_lines", key, "n_required").agg(F.max("n_matched").alias("n_matched"))
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("weak_lines"), F.col("doc_id"))
    return with_score(counted).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def score_pairs(pairs: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Score, matched and missing terms of given pairs.

    ``docs`` is (doc_id, stems); ``items`` is (item_id, terms, term_stems), where
    both arrays run in parallel. Membership uses one array intersection per
    pair, and an empty requirement set scores 1.0. No pair is lost: one without its document or posting has null results and
    says so in ``reason``.
    """
    # The intersection is bound once per pair, ahead of the filter over terms.
    matched = st.let("hs", "array_intersect(term_stems, stems)",
                     "filter(terms, (t, i) -> array_contains(hs, get(term_stems, i)))")
    hits = meet_pairs(pairs, items, docs).withColumn("matched", F.when(F.col("reason").isNull(), F.expr(matched)))
    return hits.select(
        *pairs.columns,
        "matched",
        F.when(F.col("reason").isNull(), F.array_except("terms", "matched")).alias("missing"),
        F.when(F.col("reason").isNull(), round_score(
            F.when(F.size("terms") == 0, F.lit(1.0))
            .otherwise(F.size("matched") / F.size("terms"))
        )).alias("score"),
        "reason",
    )


def meet_pairs(pairs: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """Every pair with its posting and document; ``reason`` names what is missing and is null if nothing is.

    Thin pairs take the documents first, so that neither terms nor stems are shuffled once
    per pair. The postings are stored, so that their size is known: few enough are
    broadcast by the optimizer's own test and the joined rows stay where they are.
    """
    items = stored(items.withColumn("has_item", F.lit(True)))
    met = pairs.join(docs.withColumn("has_doc", F.lit(True)), "doc_id", "left").join(items, "item_id", "left")
    return met.withColumn("reason", F.when(F.col("has_doc").isNull(), "no profile")
                          .when(F.col("has_item").isNull(), "no posting")).drop("has_item", "has_doc")


def required_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, terms, term_stems) from a posting keyword array."""
    return items.select(
        key, F.col("keywords").alias("terms"),
        F.expr(tk.stem_each("keywords")).alias("term_stems"),
    )


def family_dimension(spark) -> DataFrame:
    """(tier, family, term, stem): fixed size, a few hundred rows."""
    rows = [
        (tier, fam, term)
        for tier, families in enumerate(lx.SKILL_FAMILIES, 1)
        for fam, members in enumerate(families)
        for term in members
    ]
    dim = spark.createDataFrame(rows, "tier INT, family INT, term STRING")
    return dim.withColumn("stem", F.expr(tk.stem("term")))


def sibling_dimension(spark, mode: str = "accurate") -> DataFrame:
    """(term, siblings): siblings in order of preference for a mode.

    Cheaper tiers come first, then family order, then the sibling's name, so
    the first supported sibling is the answer.
    """
    dim = family_dimension(spark).filter(F.col("tier") <= lx.MODE_TIERS[mode])
    other = dim.select("tier", "family", F.col("term").alias("sibling"),
                       F.col("stem").alias("sibling_stem"))
    return (
        dim.join(other, ["tier", "family"])
        .filter(F.col("term") != F.col("sibling"))
        .groupBy("term")
        .agg(F.array_sort(F.collect_list(F.struct("tier", "family", "sibling", "sibling_stem")))
             .alias("siblings"))
    )
