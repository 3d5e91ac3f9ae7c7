"""Alignment of questions with drafted answers across tables.

Every draft is used once. Equal wording decides first, by occurrence number, so the
second asking of a question takes the second draft of that wording; then the k-th
question left takes the k-th draft left. Numbers come from counts per bucket of
positions, so a long conversation is never gathered in one task. Where no question
takes over the draft of a later one, this is what asking in order gives; where it
would, the later question keeps its own draft.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.functions import sqltext as st
from vitagrain.functions import text as tx
from vitagrain.operators.paging import numbered


def cleaned_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts with broken characters removed from the answer; blank answers drop out."""
    clean = drafts.withColumn("answer", F.expr(tx.clean(st.strip("coalesce(answer, '')"))))
    return clean.where("answer <> ''")


def aligned(questions: DataFrame, drafts: DataFrame, key: str = "conv_id") -> DataFrame:
    """Questions (key, pos, question) with their answer, null where no draft is left; drafts are (key, pos, question, answer)."""
    wording = F.expr(f"lower({st.collapse('coalesce(question, {0})'.format(chr(39) * 2))})")
    asked = numbered(questions.select(key, "pos", "question", wording.alias("wording")), [key, "wording"], "pos")
    held = numbered(cleaned_drafts(drafts).select(key, "pos", wording.alias("wording"), "answer"), [key, "wording"], "pos")
    equal = asked.join(held.withColumnRenamed("pos", "draft"), [key, "wording", "n"], "left").drop("n")
    used = equal.where("draft IS NOT NULL").select(key, F.col("draft").alias("pos"))
    open_questions = numbered(equal.where("draft IS NULL").select(key, "pos", "question"), [key], "pos")
    spare = numbered(held.drop("n", "wording").join(used, [key, "pos"], "left_anti"), [key], "pos")
    filled = open_questions.join(spare.select(key, "n", "answer"), [key, "n"], "left").drop("n")
    return equal.where("draft IS NOT NULL").select(key, "pos", "question", "answer").unionByName(
        filled.select(key, "pos", "question", "answer"))
