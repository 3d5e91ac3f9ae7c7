"""Cheaper forms of text and pair steps against the plain ones."""

import random

from pyspark.sql import functions as F

from vitagrain.functions import sqltext as st
from vitagrain.functions import stacks as sk
from vitagrain.functions import text as tx
from vitagrain.functions import tokens as tk
from vitagrain.operators import dictionary as dc
from vitagrain.operators import matching as mt
from vitagrain.plans import audits as au
from vitagrain.sources import derived as dv


def odd_texts(n, alphabet):
    draw = random.Random(7)
    return [("".join(draw.choice(alphabet) for _ in range(draw.randrange(12))),) for _ in range(n)]


def test_cleaning_equals_its_plain_rules(spark):
    df = spark.createDataFrame(odd_texts(4_000, ["a", "b ", " ", "\t", "\n", "\r", "|", "•", "□", "\x0b", "\x85"]), "t STRING")
    plain = f"regexp_replace(t, {st.raw(tx.BROKEN)}, '')"
    plain = f"regexp_replace({plain}, {st.raw(tx.REPEATED_PIPES)}, ' | ')"
    plain = st.let("z", plain, f"CASE WHEN left({st.strip('z')}, 1) IN ('|', '•') OR right({st.strip('z')}, 1) IN ('|', '•') "
                               f"THEN regexp_replace(z, {st.raw(tx.EDGE_SEPARATORS)}, '') ELSE z END")
    for pattern, by in ((r"[ \t]+", "' '"), (r" *\n *", "'\\n'"), (r"\n{3,}", "'\\n\\n'")):
        plain = f"regexp_replace({plain}, {st.raw(pattern)}, {by})"
    assert df.where(f"NOT {st.strip(plain)} <=> {tx.clean('t')}").limit(3).collect() == []
    assert df.where(f"NOT trim(regexp_replace(t, r'\\s+', ' ')) <=> {st.collapse('t')}").limit(3).collect() == []
    every = f"filter(transform(split(t, {st.raw(tx.LINE_BREAK)}), x -> {st.strip('x')}), x -> x <> '')"
    assert df.where(f"NOT {every} <=> {tx.lines('t')}").limit(3).collect() == []


def test_keywords_are_sorted_natively(spark):
    assert "array_sort" not in tk.keywords("t") and "array_except" not in tk.keywords("t")
    df = spark.createDataFrame([("the Zeta alpha/beta, beta. of a C++ .net alpha",), ("",), (None,)], "t STRING")
    assert [r[0] for r in df.selectExpr(tk.keywords("t")).collect()] == [["alpha", "alpha/beta", "beta", "c++", "net", "zeta"], [], None]


def test_pairs_shuffle_thin(spark):
    """With few postings, whatever their estimate, the only joined sides shuffled are pairs and documents."""
    items = spark.range(10**9).where("id < 5").selectExpr("id AS item_id", "array('a', 'b') AS terms", "array('a', 'b') AS term_stems")
    docs = spark.range(10**9).where("id < 9").selectExpr("id AS doc_id", "array('a') AS stems")
    pairs = spark.range(10**9).where("id < 30").selectExpr("id % 10 AS doc_id", "id % 6 AS item_id")
    found = mt.score_pairs(pairs, docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
    got = found.groupBy("reason").agg(F.count("*").alias("n"), F.max("score")).orderBy("reason").collect()
    assert [tuple(r) for r in got] == [(None, 23, 0.5), ("no posting", 4, None), ("no profile", 3, None)]


def test_vocabulary_by_runs_equals_every_pattern(spark):
    terms = ["c", "c++", ".net", "asp.net", "machine learning", "ci/cd", "go", "problem-solving"]
    parts = [*terms, " ", "_", "é", "x", "9", ".", "machine", "  ", "learning", "\n"]
    draw = random.Random(3)
    texts = [("".join(draw.choice(parts) for _ in range(draw.randrange(9))),) for _ in range(3_000)]
    df = spark.createDataFrame(texts, "t STRING").selectExpr("t", f"{tk.keywords('t')} AS kw")
    df = df.selectExpr("t", "kw", f"{tx.known('kw', terms)} AS few", f"{tx.known_runs('t', terms)} AS rn")
    assert df.where("size(few) > size(kw) OR size(rn) > 9").limit(1).collect() == []
    plain, fast = tx.vocabulary_hits("kw", "t", terms), tx.vocabulary_hits("few", "t", terms, runs="rn")
    assert df.where(f"NOT {plain} <=> {fast}").limit(3).collect() == []
    assert df.where(f"size({plain}) > 1").limit(1).collect() != []


def test_repeated_bullets_are_tested_once(spark):
    """Rival and era tests run over the distinct bullets of a record, and the text of a record is made once."""
    seen = spark.range(1).selectExpr(au.bullets_where(
        "array(named_struct('bullets', array('a', 'b')), named_struct('bullets', array('b', 'a')), named_struct('bullets', CAST(NULL AS ARRAY<STRING>)))",
        "x <> ''")).first()[0]
    assert seen == ["a", "b"]
    plan = dv.tailored(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Noted: ") == 1


def test_rival_and_era_tests_equal_the_plain_ones(spark):
    words = ["php", "PHPUnit", "spring boot", "node", "asp.net", "C#", "error", "ror", "Ruby", "gpt4", "ChatGPT", "x", " ", ".", "-", "mcp"]
    draw = random.Random(11)
    texts = [("".join(draw.choice(words) for _ in range(draw.randrange(6))), f) for f in ("php", "dotnet", "nodejs") for _ in range(1_000)]
    df = spark.createDataFrame([*texts, (None, "php")], "t STRING, fam STRING")
    rival = df.selectExpr(f"size({sk.competing('t', 'fam')}) > 0 AS plain", f"coalesce({sk.names_rival('t', 'fam')}, false) AS fast")
    assert rival.where("plain <> fast").limit(3).collect() == [] and rival.where("fast").limit(1).collect() != []
    era = df.selectExpr(f"size({sk.mentions('t')}) > 0 AS plain", f"{sk.may_name_technology('t')} AS fast")
    assert era.where("plain AND NOT fast").limit(3).collect() == [] and era.where("NOT fast").limit(1).collect() != []


def test_grams_meet_terms_without_inferred_tests(spark):
    """A text is cut once, and the test of a term runs on terms only."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(2)
    terms = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("text").alias("term"))
    plan = dc.mentions(texts, terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(coalesce(text") == 1 and "RLIKE(array_join" not in plan
    few = spark.createDataFrame([(1, "a b, a"), (2, ""), (3, None), (4, "..")], "doc_id INT, text STRING")
    words = spark.createDataFrame([("A",), ("b, a",), (",",), (None,), ("a",)], "term STRING")
    got = sorted(tuple(r) for r in dc.mentions(few, words).collect())
    assert got == [(1, 1, 1, "a"), (1, 3, 3, "b, a"), (1, 5, 1, "a")]
