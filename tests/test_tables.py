"""Dictionary tables, period joins, pages, alignment, nested records, files and rewrites on small fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vitagrain.catalog import tables
from vitagrain.functions import lexicon as lx
from vitagrain.functions import nested as ne
from vitagrain.functions import text as tx
from vitagrain.operators import activity as ac
from vitagrain.operators import answers as an
from vitagrain.operators import dictionary as dc
from vitagrain.operators import intervals as iv
from vitagrain.operators import lines as ln
from vitagrain.operators import matching as mt
from vitagrain.operators import paging as pg
from vitagrain.operators import rewrites as rw
from vitagrain.plans import audits as au
from vitagrain.plans import matches as ma
from vitagrain.sources import files as fl


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- patterns on long runs ------------------------------------------------------------
@pytest.mark.parametrize("text", [
    "|" * 10_000, " | " * 10_000, "a" + " |" * 10_000 + "b", "• " * 10_000 + "x", "x" + " •" * 10_000, " " * 100_000 + "x",
    "a" + " " * 100_000 + "b", "|x" * 10_000, "\n" * 10_000 + "|", "- " * 10_000])
def test_cleaning_survives_long_runs(spark, text):
    df = spark.createDataFrame([(text,)], "t STRING")
    got = df.selectExpr(f"{tx.clean('t')} AS a", f"{tx.clean_extracted('t')} AS b").first()
    plain = re.sub(r"[\s|•]+", " ", text).strip()
    assert re.sub(r"[\s|•]+", " ", got.a).strip() == plain


@pytest.mark.parametrize("link, host", [
    ("https://" + "@" * 10_000 + "jobs.example.org/x", "jobs.example.org"), ("a@" * 10_000 + "t.me", "t.me"),
    ("x" * 100_000, "x" * 100_000), ("https://u:p@h.example.org:80/a@b", "h.example.org"), ("//" * 10_000, ""),
    ("://" * 10_000, "")])
def test_hosts_survive_long_runs(spark, link, host):
    assert spark.createDataFrame([(link,)], "u STRING").selectExpr(f"{tx.host('u')} AS h").first().h == host


# --- top documents ----------------------------------------------------------------------
def test_top_documents_meet_few_pairs(spark):
    rng = random.Random(4)
    common, rare = [f"common{i}" for i in range(40)], [f"rare{i}" for i in range(3000)]
    texts = [" ".join(rng.sample(common, 20) + rng.sample(rare, 8)) for _ in range(600)]
    items = [" ".join(rng.sample(common, 6) + texts[7 * i].split()[20:]) for i in range(30)]
    docs = mt.document_stems(spark.createDataFrame([(i, t, i % 5) for i, t in enumerate(texts)], "doc_id long, text string, weak_lines int")).cache()
    postings = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    terms = mt.posting_terms(postings)
    asked = mt.required_terms(mt.with_keywords(postings)).withColumn("n_required", F.size("terms")).withColumn("again", F.expr("array()").cast("array<string>"))
    found = mt.candidates(docs, terms, asked, 1).count()
    sharing = mt.overlaps(docs, terms).count()
    assert found * 10 < sharing and sharing > 15_000
    best = {r.item_id: r.doc_id for r in mt.best_documents(docs, postings).collect()}
    full = mt.overlaps(docs, terms).collect()
    for item in best:
        want = min((-r.n_matched, r.weak_lines, r.doc_id) for r in full if r.item_id == item)
        assert best[item] == want[2]


# --- dictionary ---------------------------------------------------------------------------
def test_mentions_equal_patterns(spark):
    texts = ["Node.js and node js, C++ .NET ASP.NET über-Über x_y Go", "google  cloud google cloud platform", "", None, "go" * 50,
             "a.b.c a.b", "Naïve go, go; GO!"]
    terms = ["node.js", "node", "js", "c++", ".net", "asp.net", "net", "über", "google cloud", "google cloud platform", "cloud", "go", "a.b", "b.c", "x_y", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    words = spark.createDataFrame([(t, len(t)) for t in terms], "term string, size int")
    got = {(r.doc_id, r.term): r["count"] for r in dc.mentions(docs, words).groupBy("doc_id", "term").count().collect()}
    want = {}
    for i, t in enumerate(texts):
        for term in terms:
            if re.match(r"\w", term) and re.search(r"\w$", term):
                n = len(re.findall(rf"(?<!\w){re.escape(term)}(?!\w)", (t or "").lower()))
                want |= {(i, term): n} if n else {}
    assert got == want
    longest = {(r.doc_id, r.term) for r in dc.longest(dc.mentions(docs, words)).collect()}
    assert (1, "google cloud platform") in longest and (1, "google cloud") not in longest and (1, "cloud") in longest
    named = {(r.doc_id, r.term) for r in dc.matches(docs, words).collect()}
    assert (0, "c++") in named and set(want) <= named


def test_a_large_dictionary_keeps_the_plan(spark, tmp_path):
    rng = random.Random(9)
    spark.range(100_000).selectExpr("concat('term', id, CASE WHEN id % 3 = 0 THEN ' two' WHEN id % 3 = 1 THEN '-a b' ELSE '' END) AS term").write.parquet(f"{tmp_path}/large")
    spark.range(10).selectExpr("concat('term', id, ' two') AS term").write.parquet(f"{tmp_path}/small")
    picked = [rng.randrange(100_000) for _ in range(300)]
    texts = [f"we met term{i}{' two' if i % 3 == 0 else '-a b' if i % 3 == 1 else ''}, and more" for i in picked]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    plans = []
    for name in ("large", "small"):
        found = dc.mentions(docs, spark.read.parquet(f"{tmp_path}/{name}"))
        plans.append(len(re.sub(r"#\d+L?|\d+", "", found._jdf.queryExecution().optimizedPlan().toString())))
        if name == "large":
            assert {r.doc_id for r in found.collect()} == set(range(300))
    assert abs(plans[0] - plans[1]) < 20


# --- periods -------------------------------------------------------------------------------
def test_periods_meet_without_a_loop(spark):
    rng = random.Random(2)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.randrange(24_000, 24_100)
            out.append((i, rng.choice((a, a, a, None)), rng.choice((a + rng.randrange(-2, 40), a, None))))
        return out

    left, right = spans(60), spans(25)
    a = spark.createDataFrame(left, "a int, starts int, ends int")
    b = spark.createDataFrame(right, "b int, starts int, ends int")
    low, high = -10**9, 10**9
    open_ends = lambda x: (low if x[1] is None else x[1], high if x[2] is None else x[2])
    want = sorted(((x[0], y[0]) for x in left for y in right
                  if max(open_ends(x)[0], open_ends(y)[0]) <= min(open_ends(x)[1], open_ends(y)[1])
                  and open_ends(x)[0] <= open_ends(x)[1] and open_ends(y)[0] <= open_ends(y)[1]), key=repr)
    for width, slots in ((12, 8), (1, 1), (1000, 3)):
        met = iv.overlapping(a, b, width, slots).select("a", "b")
        assert rows_of(met) == want
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert iv.overlapping(a.limit(0), b).collect() == [] and iv.overlapping(a, b.limit(0)).collect() == []


def test_unknown_ends_forbid_nothing(spark):
    jobs = spark.sql("SELECT * FROM VALUES (1, DATE'2020-05-31'), (2, DATE'2022-11-01'), (3, NULL) AS t(job, ends)")
    rules = spark.sql("SELECT * FROM VALUES ('old', DATE'2019-01-01'), ('new', DATE'2022-11-20') AS t(rule, introduced)")
    assert rows_of(iv.forbidden(jobs, rules).select("job", "rule")) == [(1, "new")]


# --- pages and answers -------------------------------------------------------------------------
@pytest.mark.parametrize("page, size, clamp", [(1, 10, False), (3, 7, False), (25, 10, True), (25, 10, False), (10**6, 9, True)])
def test_deep_pages(spark, page, size, clamp):
    ids = random.Random(page).sample(range(100_000), 237)
    df = spark.createDataFrame([(i, f"n{i}") for i in ids], "id long, name string")
    at = max(1, min(page, -(-len(ids) // size))) if clamp else page
    want = sorted(ids, reverse=True)[(at - 1) * size: at * size]
    got = pg.deep_page(df, "id", page, size, width=512, clamp=clamp)
    assert sorted((r.id for r in got.collect()), reverse=True) == want
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
    assert pg.deep_page(df.limit(0), "id", page, size, clamp=clamp).collect() == []


def test_numbers_within_hot_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(("hot", "hot", "cold", None)), i) for i in rng.sample(range(50_000), 400)]
    got = pg.numbered(spark.createDataFrame(rows, "k string, pos long"), ["k"], "pos", width=100).collect()
    for key in ("hot", "cold", None):
        own = sorted(r.pos for r in got if r.k == key)
        assert {r.pos: r.n for r in got if r.k == key} == {p: i for i, p in enumerate(own, 1)}


def test_answers_align(spark):
    questions = [(1, 0, "Why us?"), (1, 2, " notice  PERIOD?"), (1, 4, "Salary?"), (1, 6, "why us?"), (2, 0, "Alone"), (3, 0, "x")]
    drafts = [(1, 1, "Notice period?", "Two weeks"), (1, 3, "other", "Good team"), (1, 5, "WHY  US?", "Mission"), (1, 7, "late", " ■ "), (2, 1, None, "Only one"), (2, 3, "", "Spare")]
    q = spark.createDataFrame(questions, "conv_id int, pos int, question string")
    d = spark.createDataFrame(drafts, "conv_id int, pos int, question string, answer string")
    got = {(r.conv_id, r.pos): r.answer for r in an.aligned(q, d).collect()}
    assert got == {(1, 0): "Mission", (1, 2): "Two weeks", (1, 4): "Good team", (1, 6): None, (2, 0): "Only one", (3, 0): None}
    assert [r.answer for r in an.aligned(q, d.limit(0)).collect()] == [None] * 6 and an.aligned(q.limit(0), d).collect() == []


def test_answers_are_those_of_the_fold_unless_a_leftover_steals(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e"]
    for _ in range(6):
        asked = rng.sample(words, 3)
        drafted = rng.sample(words[:3] + ["y", "z"], 3)
        unmatched = [x for x in asked if x not in drafted]
        spare = [x for x in drafted if x not in asked]
        if unmatched and spare and any(drafted.index(s) > drafted.index(x) for x in asked if x in drafted for s in spare):
            continue
        q = spark.createDataFrame([(1, i, x) for i, x in enumerate(asked)], "conv_id int, pos int, question string")
        d = spark.createDataFrame([(1, i, x, f"to {x}") for i, x in enumerate(drafted)], "conv_id int, pos int, question string, answer string")
        fold = d.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "question", "answer"))).alias("d")).select(F.expr(ln.aligned(
            f"array({', '.join(repr(x) for x in asked)})", "transform(d, x -> named_struct('question', x.question, 'answer', x.answer))")).alias("v")).first().v
        assert [r.answer for r in sorted(an.aligned(q, d).collect(), key=lambda r: r.pos)] == list(fold)


# --- nested records ------------------------------------------------------------------------------
def test_cleaning_walks_any_schema(spark):
    kind = "STRUCT<a STRING, n INT, `b c` ARRAY<STRUCT<d ARRAY<ARRAY<STRING>>, m MAP<STRING, STRUCT<e STRING>>>>, z ARRAY<INT>>"
    df = spark.sql(f"""SELECT from_json('{{"a": " ■ x ", "n": 1, "b c": [{{"d": [["□", " y  y "], ["■"]], "m": {{"■k": {{"e": "| q |"}}}}}}, null], "z": [1]}}', '{kind}') AS r
        UNION ALL SELECT CAST(NULL AS {kind})""")
    got = df.select(ne.cleaned_column("r", df.schema["r"].dataType)).collect()
    assert got[1].r is None
    r = got[0].r
    assert (r.a, r.n, r.z) == ("x", 1, [1]) and r["b c"][0].d == [["y y"], []] and r["b c"][0].m["■k"].e == "q" and r["b c"][1] is None
    assert df.select(ne.cleaned_column("r", df.schema["r"].dataType)).schema["r"].dataType.fieldNames() == ["a", "n", "b c", "z"]


def test_one_field_of_one_element(spark):
    df = spark.sql("""SELECT array(named_struct('t', 'a', 'c', 'x'), named_struct('t', 'b', 'c', 'y')) AS jobs,
        map(1, named_struct('c', 'new', 't', CAST(NULL AS STRING))) AS fixes""")
    got = df.select(ne.replaced("jobs", F.col("fixes"), ["c", "t"]).alias("jobs")).first().jobs
    assert [tuple(j) for j in got] == [("a", "x"), ("b", "new")]


# --- files ----------------------------------------------------------------------------------------
def test_spoilt_json_is_told_apart(spark, tmp_path):
    spark.createDataFrame([('{"id": 1, "x": {"y": [1]}}',), ('{"id": 2, "x"',), ("no json",), ('{"x": {"y": []}}',)], "value string").coalesce(1).write.text(f"{tmp_path}/in")
    good, bad = fl.read_json_checked(spark, f"{tmp_path}/in", "id BIGINT, x STRUCT<y: ARRAY<INT>>", "id")
    assert [r.id for r in good.collect()] == [1]
    assert {r.line for r in bad.collect()} == {'{"id": 2, "x"', "no json", '{"x":{"y":[]}}'} and {r.file[:4] for r in bad.collect()} == {"part"}


def test_a_batch_twice_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/facts"
    rows = spark.range(40).selectExpr("id", "timestamp_seconds(1700000000 + id * 7200) AS created_at")
    for batch, part in (("a", "id < 20"), ("b", "id >= 20"), ("a", "id < 20")):
        fl.append_batch(rows.where(part), path, batch)
    every = spark.read.parquet(path)
    assert every.count() == 40 and {r.batch for r in every.collect()} == {"a", "b"}
    day = fl.read_days(spark, path, "2023-11-15", "2023-11-15")
    assert day.count() == 12 and "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()


def test_files_are_judged_before_they_are_read(spark, tmp_path):
    for name, body in (("a.txt", "hello"), ("b.TXT", ""), ("c.exe", "x"), ("d.txt", "y" * 50), ("e.txt", "")):
        (tmp_path / name).write_text(body)
    listed = fl.listed_files(spark, str(tmp_path)).withColumn("reason", fl.file_reason([".txt"], 20))
    assert {r.name: r.reason for r in listed.collect()} == {"a.txt": "", "c.exe": "extension", "d.txt": "too large"}
    told = spark.createDataFrame([(".txt", 0), (".txt", 20)], "extension string, length long")
    assert [r.reason for r in told.select(fl.file_reason([".txt"], 20).alias("reason")).collect()] == ["empty", ""]
    read = fl.accepted_files(spark, str(tmp_path), [".txt"], 20)
    assert [r.text for r in read.collect()] == ["hello"]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


# --- rewrites ----------------------------------------------------------------------------------------
def test_a_failed_rewrite_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert rw.create(spark.range(10).toDF("id"), path) == 10
    with pytest.raises(rw.RewriteRejected):
        rw.rewrite(spark, path, lambda t: t.where("id > 3"), change=-3)
    with pytest.raises(Exception, match="broken"):
        rw.rewrite(spark, path, lambda t: t.selectExpr("CASE WHEN id = 7 THEN raise_error('broken') ELSE id END AS id"))
    assert rw.read_current(spark, path).count() == 10
    assert rw.rewrite(spark, path, lambda t: t.where("id > 3"), change=-4) == (10, 6)
    assert rw.rewrite(spark, path, lambda t: t.union(t), change=6) == (6, 12)
    assert rw.read_current(spark, path).count() == 12


def test_erasure_is_guarded(spark):
    users = spark.createDataFrame([(1, "admin", True), (2, "admin", True), (3, "user", True), (4, "admin", False)], "id long, role string, is_active boolean")

    def reasons(ids, actor):
        return {r.id: r.reason for r in rw.erasable(users, spark.createDataFrame([(i,) for i in ids], "id long"), actor).collect()}

    assert reasons([1, 2, 3, 4, 9], 3) == {1: "last administrator", 2: "", 3: "own account", 4: "", 9: "unknown"}
    assert reasons([1, 2], 2) == {1: "", 2: "own account"}
    assert reasons([1, 1, 3], 4) == {1: "", 3: ""}


# --- positions ------------------------------------------------------------------------------------------
def test_positions_follow_the_order(spark):
    rng = random.Random(11)
    rows = [(rng.choice(("hot", "hot", "b", None)), f"t{i:03}", i) for i in rng.sample(range(300), 300)]
    df = spark.createDataFrame(rows, "k string, t string, i long")
    got = {r.i: r.position for r in pg.positions(df, F.col("t").desc()).collect()}
    assert got == {i: n for n, i in enumerate(sorted(got, reverse=True), 1)}
    within = pg.positions(df, F.col("k"), F.col("i").desc(), within="k").collect()
    for key in ("hot", "b", None):
        own = sorted((r.i for r in within if r.k == key), reverse=True)
        assert {r.i: r.position for r in within if r.k == key} == {i: n for n, i in enumerate(own, 1)}
    assert pg.positions(df.limit(0), "t").collect() == []


def test_one_default_per_owner(spark):
    rows = [(1, "x", "b", True), (2, "x", "a", False), (3, "x", "b", True), (4, "y", "d", False), (5, "y", "c", False), (6, None, "z", False)]
    df = spark.createDataFrame(rows, "id long, user_id string, slug string, is_default boolean")
    out = ac.default_per_owner(df)
    assert {r.id for r in out.collect() if r.is_default} == {1, 5, 6} and out.count() == 6
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter, (id" in plan


# --- gap closing -----------------------------------------------------------------------------------------
def gaps_of(row):
    """Brute force: candidates in order, each tested against the text grown so far."""
    c = lx.CATEGORIES
    groups = [("languages", c["programming_languages"]), ("frontend", lx.FRONTEND_FRAMEWORKS),
              ("backend", [t for t in c["frameworks"] if t not in lx.FRONTEND_FRAMEWORKS]), ("cloud", c["cloud_platforms"]),
              ("devops", c["devops_tools"]), ("databases", c["databases"]), ("ai", c["ai_ml_tools"]), ("tools", c["methodologies"] + lx.EXTRA_TECHNOLOGIES)]
    group = lambda t: next((g for g, terms in groups if t.lower() in terms), None)
    alone = lambda t, text: re.search(rf"\b{re.escape(t)}\b", text, re.A) is not None
    bare = lambda e: e.split(" (related:")[0].strip()
    preferred = list({t.lower(): t for t in reversed([*row.preferred_matched, *map(bare, row.preferred_transferable)])}.values())[::-1]
    text, added = " ".join(s.term for s in row.skills).lower(), []
    for t in dict.fromkeys([*preferred, *row.matched_skills, *map(bare, row.transferable_skills)]):
        if group(t) and not alone(t.lower(), text):
            own = [s for s in row.cv_skills if s.lower() == t.lower()]
            shown = own[-1] if own else t.upper() if t.lower() in lx.ACRONYMS else t[:1].upper() + t[1:]
            added.append((group(t), shown, "preferred" if t.lower() in {p.lower() for p in preferred} else "matched/transferable"))
            text += f" {t.lower()}"
    clean = re.sub(r"(?is)\s+(?:Matched(?:\s+skills|\s+terms)?\s*:|Transferable(?:\s+skills)?\s*:|Transferable experience with\b|Hands-on with\b).*$",
                   "", row.summary.strip()).rstrip(" ;,")
    clean += "" if not clean or clean[-1] in ".!?" else "."
    woven = [p for p in preferred if not alone(p.lower(), clean.lower())]
    names = " and ".join(woven) if len(woven) < 3 else ", ".join(woven[:-1]) + f", and {woven[-1]}"
    closed = f"{clean} Additional strengths include {names}, aligned with this role's preferred qualifications.".strip() if woven else clean
    return added, woven, closed, clean != row.summary.strip()


def test_gap_closing_after_matching(spark, sf):
    inputs = tables.matched_gaps(spark, sf)
    rows = {r.doc_id: r for r in inputs.collect()}
    closed = {r.doc_id: r for r in au.close_gaps(inputs).collect()}
    assert set(rows) == set(closed) and len(rows) == 200
    texts = []
    for k, row in rows.items():
        added, woven, text, dumped = gaps_of(row)
        assert [tuple(a) for a in closed[k].added] == added and list(closed[k].woven) == woven
        rules = [n.rule for n in closed[k].notes]
        assert rules.count("skill added") == len(added) and ("dump removed" in rules) == dumped and ("preferred terms woven in" in rules) == bool(woven)
        texts.append((k, text, row.phrase))
    df = spark.createDataFrame(texts, "doc_id long, text string, phrase string")
    for r in df.selectExpr("doc_id", "text", f"{tx.with_tenure('text', 'phrase')} AS final").collect():
        assert closed[r.doc_id].summary == r.final
        assert ("tenure restated" in [n.rule for n in closed[r.doc_id].notes]) == (r.final != r.text)
    assert any(r.added for r in closed.values()) and any(n.rule == "tenure restated" for r in closed.values() for n in r.notes)


def test_gaps_of_terms_with_odd_edges(spark):
    row = dict(doc_id=1, matched_skills=["c++", "node.js", "java", "sql"], transferable_skills=["docker (related: podman)"], preferred_matched=["go"],
               preferred_transferable=["Kafka (related: pulsar)"], cv_skills=["NODE.JS"], summary="Runs C++ on Go-lang, javascript; Kafka2")
    kind = ("doc_id long, matched_skills array<string>, transferable_skills array<string>, preferred_matched array<string>, preferred_transferable array<string>, "
            "skills array<struct<grp: string, term: string>>, cv_skills array<string>, summary string")
    df = spark.createDataFrame([(1, row["matched_skills"], row["transferable_skills"], row["preferred_matched"], row["preferred_transferable"],
                                 [("tools", "JavaScript"), ("tools", "PL/SQL")], row["cv_skills"], row["summary"])], kind)
    r, want = au.close_gaps(df).first(), gaps_of(df.first())
    assert [tuple(a) for a in r.added] == want[0] and list(r.woven) == want[1] == ["Kafka"] and r.summary == want[2]


def test_tailored_text_takes_all_groups(spark):
    df = spark.sql("""SELECT 'sum' AS summary, named_struct('languages', array('a'), 'backend', array('b'), 'frontend', array('c'), 'cloud', array('d'),
        'devops', CAST(NULL AS ARRAY<STRING>), 'databases', array('e'), 'ai', array('f'), 'tools', array('g')) AS skills,
        array(named_struct('title', 't', 'company', 'co', 'dates', '2020', 'bullets', array('x', 'y'))) AS experience,
        array(named_struct('degree', 'dg', 'institution', 'in', 'dates', '1')) AS education, array('cert') AS certifications""")
    assert df.selectExpr(f"{ma.tailored_text()} AS t").first().t == "sum a b c d e f g t co x y dg in cert"
