"""Whole-plan behaviour on small fixtures, checked by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from vitagrain.functions import lexicon as lx
from vitagrain.operators import activity as ac
from vitagrain.operators import lines as ln
from vitagrain.operators import maintain as mn
from vitagrain.operators import matching as mt
from vitagrain.operators import stages as sg
from vitagrain.plans import audits as au
from vitagrain.plans import matches as ma
from vitagrain.plans import postings as po
from vitagrain.plans import profiles as pf
from vitagrain.sources import tables as tb

PROFILE = """Alex
Sample
+385 55 0101234 alex@example.com
Split, Croatia

Summary
Senior engineer with 10+ years.

Skills
Core: Python, Go
and SQL
Experience
Staff | Tech Lead Full Stack Engineer /Acorn FEBRUARY 2023 – MAY 2026
- Led design of platform services
across regions
Staff Software Engineer | Tech Lead (.NET, Cloud & Full Stack) /1234
Foundry
JANUARY 2022 – JANUARY 2023
- Built cloud services
Page 2
Senior Full Stack .NET Engineer
iBrain Works
MAY 2018 – DECEMBER 2021
- Did it
Education
North University 2001 - 2005
"""


def one(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    return pf.structure(df).first()


def test_structure_profile(spark):
    r = one(spark, PROFILE)
    assert r.is_structured and r.name == "Alex Sample"
    assert r.contact.email == "alex@example.com" and r.contact.location is not None
    assert r.skills_raw == ["Python", "Go and SQL"]
    assert [(j.title, j.company) for j in r.experience] == [
        ("Staff | Tech Lead Full Stack Engineer", "Acorn"),
        ("Staff Software Engineer | Tech Lead (.NET, Cloud & Full Stack)", "1234 Foundry"),
        ("Senior Full Stack .NET Engineer", "iBrain Works"),
    ]
    assert r.experience[0].bullets == ["Led design of platform services across regions"]


def test_company_from_first_bullet(spark):
    r = one(spark, "Ann Lee\nExperience\nSenior Developer May 2018 – July 2019\n"
                   "Fjord Software\n- Ran 3 things\n")
    assert [(j.title, j.company, j.bullets) for j in r.experience] == [
        ("Senior Developer", "Fjord Software", ["Ran 3 things"])]


def test_missing_company_is_unstructured(spark):
    r = one(spark, "Ann Lee\nExperience\nSenior Developer May 2018 – July 2019\n- ran 3 things.\n")
    assert not r.is_structured and r.raw_text.startswith("Ann Lee") and r.experience == []


@pytest.mark.parametrize("parked", [0, 1, 2])
def test_steal_back(spark, parked):
    """Headers parked above the next date line move to that job, whatever their number."""
    headers = ["Platform Engineer", "Cedar Works"][:parked]
    lines = ["Data Analyst", "Acorn Systems", "May 2015 – July 2016", "- one", *headers,
             "Cloud Architect | Birch Labs June 2017 – July 2018", "- two"]
    df = spark.createDataFrame([(1, "A B\nExperience\n" + "\n".join(lines))], "doc_id BIGINT, text STRING")
    islands = pf.with_jobs(pf.with_sections(pf.with_lines(df))).selectExpr(
        "transform(islands, j -> transform(j.kinds, x -> x.line)) AS v").first().v
    assert islands[0] == lines[:4]
    assert islands[1] == [*headers, *lines[-2:]]


def test_analyse_posting(spark):
    text = ("Senior Engineer\nRequirements\n- Kafka is a plus\n- " + "x" * 201 +
            "\n- Bachelor degree\nBenefits\nGym\nDuties:\n- Own it\n")
    df = spark.createDataFrame([(1, text)], "item_id BIGINT, text STRING")
    whole = po.analyse(df).first()
    assert whole.required_skills == ["x" * 201, "Bachelor degree"]
    r = po.analyse(df, longest=200).first()
    assert r.preferred_skills == ["Kafka is a plus"] and r.required_skills == ["Bachelor degree"]
    assert r.responsibilities == ["Own it"] and r.qualifications == ["Bachelor degree"]
    assert r.target_job_title == "Senior Engineer" and r.technologies == ["kafka"]


def test_empty_requirements_score_one(spark):
    docs = spark.createDataFrame([(1, ["lead"])], "doc_id BIGINT, stems ARRAY<STRING>")
    items = spark.createDataFrame(
        [(1, [], []), (2, ["kafka", "leadership"], ["kafka", "lead"])],
        "item_id BIGINT, terms ARRAY<STRING>, term_stems ARRAY<STRING>")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "doc_id BIGINT, item_id BIGINT")
    got = {r.item_id: r for r in mt.score_pairs(pairs, docs, items).collect()}
    assert got[1].score == 1.0 and got[1].matched == []
    assert got[2].score == 0.5 and got[2].missing == ["kafka"]


def corpus(spark, n_docs=60, n_items=12, seed=5):
    """Documents and postings in which one word is everywhere."""
    rng = random.Random(seed)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnp"]
    def text():
        return " ".join(["common"] + rng.sample(words, rng.randint(1, 12)))
    docs = [(i, text() + ("\nline 7" if i % 3 else "\nline")) for i in range(n_docs)]
    items = [(i, text()) for i in range(n_items)]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").withColumn(
        "weak_lines", F.expr("CASE WHEN text LIKE '%7%' THEN 1 ELSE 2 END"))
    return docs, items, mt.document_stems(d), spark.createDataFrame(items, "item_id BIGINT, text STRING")


def brute_force(docs, items):
    scores = {}
    for i, it in items:
        need = set(it.split())
        for d, dtx in docs:
            have = {w for w in dtx.split() if len(w) > 2}
            if need & have:
                scores[d, i] = len(need & have)
    return scores


@pytest.mark.parametrize("per_slot", [1_000, 3])
def test_best_documents_brute_force(spark, monkeypatch, per_slot):
    monkeypatch.setattr(mt, "POSTINGS_PER_SLOT", per_slot)
    docs, items, d, _ = corpus(spark)
    items += [(100, "a of"), (101, "unheard xylophone")]  # without keywords, and without overlap
    i = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    hits = brute_force(docs, items)
    for k in (1, 4):
        best = mt.best_documents(d, i, k).collect()
        for item, _ in items:
            ranked = sorted((-hits.get((doc, item), 0), 1 if text.find("7") >= 0 else 2, doc) for doc, text in docs)[:k]
            mine = sorted((-r.n_matched, r.weak_lines, r.doc_id) for r in best if r.item_id == item)
            assert mine == ranked
            assert {r.score for r in best if r.item_id == item} == {1.0} if item == 100 else True


def test_matched_and_missing_partition_the_terms(spark):
    cvs = spark.createDataFrame([(1, PROFILE)], "doc_id BIGINT, text STRING")
    jd = spark.createDataFrame(
        [(1, "Engineer\nRequirements\n- MySQL and python\nNice to have\n- Golang\n- PyTorch\n")],
        "item_id BIGINT, text STRING")
    pairs = spark.createDataFrame([(1, 1)], "doc_id BIGINT, item_id BIGINT")
    r = ma.match(pairs, pf.structure(cvs), po.analyse(jd), "accurate").first()
    assert r.matched_skills == ["python"] and r.missing_skills == ["golang", "pytorch"]
    assert r.transferable_skills == ["mysql (related: sql)"]
    assert r.preliminary_score == 0.25


def test_no_pair_is_lost(spark):
    cvs = spark.createDataFrame([(1, PROFILE)], "doc_id BIGINT, text STRING")
    jd = spark.createDataFrame([(1, "Engineer\nRequirements\n- MySQL and python\n")], "item_id BIGINT, text STRING")
    pairs = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (None, 1)], "doc_id BIGINT, item_id BIGINT")
    want = {(1, 1): None, (2, 1): "no profile", (1, 2): "no posting", (None, 1): "no profile"}
    for made, result in ((ma.match(pairs, pf.structure(cvs), po.analyse(jd)), "preliminary_score"),
                         (ma.score(pairs, pf.structure(cvs), po.analyse(jd)), "score")):
        rows = made.collect()
        assert {(r.doc_id, r.item_id): r.reason for r in rows} == want and len(rows) == 4
        assert all((r[result] is None) == (r.reason is not None) for r in rows)


def test_wider_modes_only_move_missing_to_transferable(spark):
    tiers = [mt.sibling_dimension(spark, m).count() for m in lx.MODE_TIERS]
    assert tiers == sorted(tiers)


def test_bullets_dedupe_and_excess(spark):
    bullets = ["A  b", "Ran PHP jobs", "a B", "Wrote Laravel pages", "Kept Rails up", "Used Django 4"]
    job = {"title": "Engineer", "company": "Acorn", "dates": "Jan 2020 – Dec 2023", "bullets": bullets}
    schema = ("doc_id BIGINT, raw_text STRING, is_structured BOOLEAN, master ARRAY<STRUCT<title: STRING, "
              "company: STRING, dates: STRING, bullets: ARRAY<STRING>>>, tailored ARRAY<STRUCT<title: STRING, "
              "company: STRING, dates: STRING, bullets: ARRAY<STRING>>>, main_stack STRING, summary STRING, "
              "master_certs ARRAY<STRING>, tailored_certs ARRAY<STRING>")
    row = (1, "x", True, [job], [job], ".NET", "Engineer with 9 years.", [], [])
    r = au.audit(spark.createDataFrame([row], schema), "DATE'2026-03-01'").first()
    out = r.experience[0].bullets
    assert len(out) == 5 and out[1] == "Ran PHP jobs" and out[2] == "Wrote Laravel pages"
    assert "Rails" not in out[3] and "Django" not in out[4]
    assert r.summary == "Engineer with 4 years."
    assert [i.rule for i in r.issues] == [
        "bullets off stack", "duplicate bullets", "bullet count", "tenure restated"]


def test_unique_links_survive_a_hot_key(spark):
    rows = [(i, f"f{i % 3}", 1 if i % 3 else i, "s", "HTTPS://Ex.com/a/" if i % 2 else "https://ex.com/A",
             False, None, False) for i in range(500)]
    rows += [(900, "f", 2, "s", " https://t.me/x ", False, None, False), (901, "f", 2, "s", " ", False, None, False),
             (902, "f", 2, "s", "https://ex.com/a", True, None, False)]
    records = spark.createDataFrame(
        rows, "id BIGINT, file_id STRING, user_id BIGINT, main_stack STRING, job_link STRING, "
              "is_fake BOOLEAN, created_at TIMESTAMP, cv_saved BOOLEAN")
    got = ac.unique_links(records, drop_excluded=True).collect()
    assert [(r.link_key, r.id) for r in got] == [("https://ex.com/a", 499)]
    again = ac.unique_links(records.join(spark.createDataFrame([(g.id,) for g in got], "id BIGINT"), "id"))
    assert again.count() == 1
    paid = ac.attach_payload(records, spark.createDataFrame([("f1", "pdf")], "file_id STRING, payload STRING"))
    assert [r.id for r in paid.filter("payload IS NOT NULL").collect()] == [499]


def test_page_clamp(spark):
    df = spark.range(25)
    assert [r.id for r in ac.page_slice(df, [F.col("id").desc()], 9, 10, clamp=True).collect()] == [4, 3, 2, 1, 0]
    assert ac.page_slice(df, [F.col("id").desc()], 9, 10).count() == 0


def test_stage_seed_keeps_later_values(spark):
    row = spark.range(1).select(sg.seed(
        F.create_map(F.lit("a"), F.lit(1.0)),
        F.create_map(F.lit("a"), F.lit(9.0), F.lit("b"), F.lit(2.0))).alias("m")).first()
    assert row.m == {"a": 1.0, "b": 2.0}


def test_upsert_deactivates_unlisted(spark):
    cur = spark.createDataFrame([("a", "A"), ("b", "B")], "slug STRING, name STRING")
    new = spark.createDataFrame([("b", "B2"), ("c", "C")], "slug STRING, name STRING")
    got = {r.slug: (r.name, r.is_active) for r in mn.upsert(cur, new, "slug").collect()}
    assert got == {"a": ("A", False), "b": ("B2", True), "c": ("C", True)}


def test_groups_from(spark):
    got = spark.range(1).selectExpr(
        f"{ln.groups_from('array(1, 9, 2, 9, 9, 3)', 'x = 9')} AS g").first().g
    assert got == [[1], [9, 2], [9], [9, 3]]


def test_files_roundtrip(spark, tmp_path):
    facts = spark.createDataFrame(
        [(1, "a", "2026-03-01 10:00:00"), (2, "b", "2026-03-02 10:00:00")],
        "id BIGINT, stack STRING, created STRING").selectExpr(
            "id", "stack", "CAST(created AS TIMESTAMP) AS created_at")
    tb.append_activity(facts, f"{tmp_path}/facts")
    tb.append_activity(facts, f"{tmp_path}/facts")
    back = spark.read.parquet(f"{tmp_path}/facts")
    assert back.count() == 4 and back.filter("day = DATE'2026-03-01'").count() == 2

    nested = facts.selectExpr("id", "named_struct('stack', stack) AS inner")
    tb.write_json_documents(nested, f"{tmp_path}/json")
    read = tb.read_json_documents(spark, f"{tmp_path}/json", "id BIGINT, inner STRUCT<stack: STRING>")
    assert sorted((r.id, r.inner.stack) for r in read.collect()) == [(1, "a"), (2, "b")]

    out = tb.export_csv(facts.select("id", "stack"), str(tmp_path), "links", "2026-03-01")
    assert out.endswith("links-2026-03-01")
    assert spark.read.option("header", True).csv(out).columns == ["id", "stack"]

    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("a\nb")
    assert tb.read_text_corpus(spark, f"{tmp_path}/texts").collect() == [("one.txt", "a\nb")]


def test_stream_append(spark, tmp_path):
    from vitagrain.streaming.activity import append_stream

    source = f"{tmp_path}/in"
    spark.range(5).selectExpr("id", "TIMESTAMP'2026-03-01 08:00:00' AS created_at").write.parquet(source)
    stream = spark.readStream.schema("id BIGINT, created_at TIMESTAMP").parquet(source)
    for _ in range(2):  # a second run finds nothing new
        append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
