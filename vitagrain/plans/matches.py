"""Match and score given (profile, posting) pairs.

Profiles and postings are reduced to term arrays once per object. A pair is then
two joins by id and array comparisons inside the joined row, so the cost is
linear in the pairs and nothing is regrouped per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st
from vitagrain.functions import tokens as tk
from vitagrain.operators import matching as mt
from vitagrain.plans import postings as po
from vitagrain.plans import profiles as pf

FAMILY_TERMS = sorted({t for tier in lx.SKILL_FAMILIES for family in tier for t in family})


def profile_terms(profiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, stems, job_stems): stems of the whole record and of each job."""
    own = f"transform(skills_raw, s -> {tk.stem('s')})"
    per_job = tk.stems(tk.keywords("array_join(concat(array(j.title), j.bullets), ' ')"))
    listed = tk.keywords("array_join(skills_raw, chr(10))")  # no token spans a line break
    return (
        profiles.withColumn("words", F.expr(
            f"array_distinct(concat({tk.keywords(pf.flat_text())}, {listed}))"))
        .selectExpr(key, f"array_distinct(concat({tk.stem_each('words')}, {own})) AS stems",
                    f"transform(experience, j -> {per_job}) AS job_stems")
        # Only these few can ever support a missing term, whatever the posting.
        .withColumn("family_stems", F.expr(f"array_intersect(stems, {tk.stem_each(st.array(FAMILY_TERMS))})"))
    )


def posting_needs(analyses: DataFrame, mode: str, key: str = "item_id") -> DataFrame:
    """(key, needs): each required term with its stem, preference and siblings.

    Terms are exploded once per posting to meet the fixed sibling dimension; a
    regrouped posting holds no more than the terms of its own text.
    """
    spark = analyses.sparkSession
    preferred = tk.stem_each(po.preferred_terms())
    terms = (
        analyses.selectExpr(key, f"{po.all_terms()} AS terms", f"{preferred} AS preferred_stems")
        .select(key, "preferred_stems", F.explode_outer("terms").alias("term"))
        .withColumn("stem", F.expr(tk.stem("term")))
    )
    need = F.struct("term", "stem",
                    F.array_contains("preferred_stems", F.col("stem")).alias("preferred"),
                    "siblings")
    return (
        terms.join(F.broadcast(mt.sibling_dimension(spark, mode)), "term", "left")
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), need))).alias("needs"))
    )


def match(pairs: DataFrame, profiles: DataFrame, analyses: DataFrame,
          mode: str = "accurate") -> DataFrame:
    """Matched, transferable and missing terms with job order and score.

    A pair without its profile or posting stays, with null results and a ``reason``.
    """
    joined = mt.meet_pairs(pairs, posting_needs(analyses, mode), profile_terms(profiles))
    df = joined.withColumn("hits", F.expr("array_intersect(transform(needs, n -> n.stem), stems)"))
    df = df.withColumns({
        "found": F.expr("filter(needs, n -> array_contains(hits, n.stem))"),
        "others": F.expr(
            "transform(filter(needs, n -> NOT array_contains(hits, n.stem)), n -> named_struct("
            "'term', n.term, 'preferred', n.preferred, 'related', get(filter(n.siblings, "
            "s -> array_contains(family_stems, s.sibling_stem)), 0).sibling))"),
    })
    linked = "filter(others, o -> o.related IS NOT NULL{})"
    label = "o -> concat(o.term, ' (related: ', o.related, ')')"
    overlap = ("size(filter(needs, n -> array_contains(js, n.stem)))")
    matched = df.selectExpr(
        *pairs.columns,
        "transform(found, n -> n.term) AS matched_skills",
        f"array_sort(transform({linked.format('')}, {label})) AS transferable_skills",
        "transform(filter(others, o -> o.related IS NULL), o -> o.term) AS missing_skills",
        "transform(filter(found, n -> n.preferred), n -> n.term) AS preferred_matched",
        f"array_sort(transform({linked.format(' AND o.preferred')}, {label})) "
        "AS preferred_transferable",
        f"transform(array_sort(transform(job_stems, (js, i) -> named_struct('k', -{overlap}, "
        "'i', i))), s -> s.i) AS prioritized_job_indices",
        "CASE WHEN size(needs) = 0 THEN 1.0D ELSE "
        "bround(CAST(size(found) AS DOUBLE) / size(needs), 4) END AS preliminary_score",
        "reason",
    )
    out = [c for c in matched.columns if c not in (*pairs.columns, "reason")]
    return matched.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in out})


def score(pairs: DataFrame, profiles: DataFrame, analyses: DataFrame) -> DataFrame:
    """Keyword coverage of given pairs against the structured requirements."""
    docs = profiles.selectExpr("doc_id", f"{tk.keywords(pf.flat_text(True))} AS words") \
        .selectExpr("doc_id", f"{tk.stems('words')} AS stems")
    items = analyses.selectExpr("item_id", f"{tk.keywords(po.requirement_text())} AS keywords")
    return mt.score_pairs(pairs, docs, mt.required_terms(items))


def tailored_text() -> str:
    """Searchable text of a tailored record: its eight skill groups in order; spoken languages never count."""
    groups = ", ".join(f"coalesce(skills.{g}, {pf.EMPTY_TEXTS})" for g in lx.SKILL_GROUPS)
    return (f"array_join(concat(array(coalesce(summary, '')), {groups}, "
            "flatten(transform(experience, j -> concat(array(j.title, j.company), j.bullets))), "
            "flatten(transform(education, e -> array(e.degree, e.institution))), certifications), ' ')")


def score_tailored(pairs: DataFrame, records: DataFrame, analyses: DataFrame) -> DataFrame:
    """Keyword coverage of given pairs by tailored records, whose skills are a struct of eight lists."""
    docs = records.selectExpr("doc_id", f"{tk.keywords(tailored_text())} AS words").selectExpr("doc_id", f"{tk.stems('words')} AS stems")
    items = analyses.selectExpr("item_id", f"{tk.keywords(po.requirement_text())} AS keywords")
    return mt.score_pairs(pairs, docs, mt.required_terms(items))
