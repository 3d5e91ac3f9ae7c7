"""Profile, posting and matching queries over the derived corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagrain.catalog import sqlkit as sk
from vitagrain.catalog.base import Catalog
from vitagrain.functions import lexicon as lx
from vitagrain.plans import matches as ma
from vitagrain.plans import postings as po
from vitagrain.plans import profiles as pf
from vitagrain.sources import derived as dv
from vitagrain.sources.tables import read_table

catalog = Catalog()
query = catalog.query

K = "doc_id"
# What the profile texts were rendered from, one row per job.
JOBS = "jobs AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {j} AS pos, {dv.job_title(K, j)} AS title, {dv.job_company(K, j)} AS company, "
    f"{dv.job_dates(K, j)} AS dates, list_transform([{', '.join(dv.job_bullets(K, j))}], "
    f"lambda b: replace(b, '  ', ' ')) AS bullets FROM documents WHERE {j} < {dv.job_count(K)}"
    for j in range(dv.MAX_JOBS)) + ")"
SUMMARY = ("array_to_string(list_filter(list_transform(string_split(text, chr(10)), "
           "lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), ' ')")
SUMMARY = f"trim(regexp_replace({SUMMARY}, '(\\s*[|•]\\s*)+$', ''))"
SKILLS = f"[{', '.join(dv.profile_skills(K))}]"
CERT = f"'AWS Certified Developer ' || ({K} % 7)"


def structured(spark, sf):
    return pf.structure(dv.profiles(spark, sf))


def exploded_jobs(profiles):
    """One row per job. The outer form keeps the optimizer from adding a size
    filter that would evaluate the parsing expressions a second time."""
    return profiles.select("doc_id", F.posexplode_outer("experience").alias("pos", "j")).filter(
        "pos IS NOT NULL")


@query("structure_profiles_c2", f"""SELECT doc_id, true AS is_structured, 'Person Number' AS name,
'p' || doc_id || '@example.com' AS email, 'Split, Croatia' AS location, {SUMMARY} AS summary,
array_to_string({SKILLS}, ';') AS skills, {dv.job_count(K)} AS n_jobs,
'Bachelor of Science|North University|2001 - 2005' AS education, {CERT} AS certifications FROM documents""")
def structure_profiles(spark, sf):
    e = F.col("education")[0]
    return structured(spark, sf).select(
        "doc_id", "is_structured", "name", "contact.email", "contact.location", "summary",
        F.array_join("skills_raw", ";").alias("skills"),
        F.size("experience").cast("bigint").alias("n_jobs"),
        F.concat_ws("|", e["degree"], e["institution"], e["dates"]).alias("education"),
        F.array_join("certifications_raw", ";").alias("certifications"))


@query("structure_jobs_c2_w5_w6_w7_w8_w9_t16", f"""WITH {JOBS} SELECT doc_id, CAST(pos AS INT) AS pos, title, company, dates,
array_to_string(bullets, ';') AS bullets FROM jobs""")
def structure_jobs(spark, sf):
    """Every job of every profile, parsed back from the rendered text."""
    return exploded_jobs(structured(spark, sf)).select(
        "doc_id", "pos", "j.title", "j.company", "j.dates",
        F.array_join("j.bullets", ";").alias("bullets"))


# --- postings --------------------------------------------------------------------------
P = "item_id"
S = dv.posting_skills(P)
REQUIRED = f"[CAST({P} % 6 + 2 AS STRING) || '+ years of experience with ' || {S[0]}, 'Strong ' || {S[1]} || ' and google cloud']"
PREFERRED = f"[{S[2]} || ' is a plus', {S[3]} || ' and agile/scrum', 'AWS Certified Developer preferred']"
DUTIES = ("list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), "
          "lambda x: x <> '')")
TITLE = dv.pick(dv.TITLES, P)
YEARS = f"CAST({P} % 6 + 2 AS STRING) || '+ years'"
LEVEL = (f"CASE WHEN regexp_matches({TITLE}, 'Staff') THEN 'Principal/Staff (' || {YEARS} || ')' "
         f"WHEN regexp_matches({TITLE}, 'Senior') THEN 'Senior (' || {YEARS} || ')' ELSE {YEARS} END")
NAMED = (f"list_distinct([lower({S[0]}), lower({S[1]}), lower({S[2]}), lower({S[3]}), "
         f"'google cloud', 'aws', 'agile', 'scrum', 'mentoring'])")
CATEGORY_SQL = {
    name: (f"array_to_string(list_transform(list_sort(list_transform(list_filter({NAMED}, "
           f"lambda t: list_contains([{sk.quoted(terms)}], t)), lambda t: CASE WHEN contains(t, ' ') THEN '0' ELSE '1' END || t)), "
           f"lambda t: t[2:]), ';')")
    for name, terms in lx.CATEGORIES.items()
}


@query("analyse_postings_c1", f"""SELECT item_id, array_to_string({REQUIRED}, ';') AS required_skills,
array_to_string({PREFERRED}, ';') AS preferred_skills, array_to_string({DUTIES}, ';') AS responsibilities,
array_to_string(list_sort(list_filter({NAMED}, lambda t: list_contains([{sk.quoted(lx.TECHNOLOGIES)}], t) AND t <> 'google cloud')), ';') AS technologies,
{LEVEL} AS seniority, {TITLE} AS target_job_title, {', '.join(f'{v} AS {k}' for k, v in CATEGORY_SQL.items())},
CASE WHEN item_id % 2 = 0 THEN 'Fintech' ELSE 'Retail' END AS business_domain,
({REQUIRED})[1] || ';AWS Certified Developer preferred' AS qualifications, 'AWS Certified Developer' AS certifications,
{YEARS} AS required_years_experience FROM benchmark""")
def analyse_postings(spark, sf):
    a = po.analyse(dv.postings(spark, sf)).drop("text", "keywords")
    return a.select(*[
        F.array_join(f.name, ";").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in a.schema.fields])


# --- matching -----------------------------------------------------------------------------
PAIRS = "SELECT DISTINCT o_custkey AS doc_id, o_orderkey % (SELECT count(*) FROM benchmark) AS item_id FROM orders"


def application_pairs(spark, sf):
    """Distinct (profile, posting) applications, one per stored order."""
    return spark.sql(PAIRS.replace("FROM benchmark", "FROM {b}").replace("FROM orders", "FROM {o}"),
                     b=read_table(spark, sf, "benchmark"), o=read_table(spark, sf, "orders"))


def _flat(with_company: bool) -> str:
    jobs = ", ".join(
        f"CASE WHEN {j} < {dv.job_count(K)} THEN concat_ws(' ', {dv.job_title(K, j)}, "
        + (f"{dv.job_company(K, j)}, " if with_company else "")
        + f"{', '.join(dv.job_bullets(K, j))}) END" for j in range(dv.MAX_JOBS))
    tail = f", 'Bachelor of Science North University', {CERT}" if with_company else ""
    return f"concat_ws(' ', text, array_to_string({SKILLS}, ' '), {jobs}{tail})"


NEED_TEXT = f"concat_ws(' ', array_to_string({REQUIRED}, ' '), array_to_string({PREFERRED}, ' '), array_to_string({DUTIES}, ' '), 'mentoring', {TITLE})"


def every_pair(sql: str, results: str) -> str:
    """All pairs with the results that the SQL gives for those it has, and why others have none."""
    return f"""WITH every AS ({PAIRS}), given AS ({sql})
SELECT e.doc_id, e.item_id, {results}, CASE WHEN e.doc_id IS NULL OR e.doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL) THEN 'no profile'
WHEN e.item_id IS NULL OR e.item_id NOT IN (SELECT item_id FROM benchmark WHERE item_id IS NOT NULL) THEN 'no posting' END AS reason
FROM every e LEFT JOIN given g ON g.doc_id = e.doc_id AND g.item_id = e.item_id"""


SCORE_SQL = f"""WITH flat AS (SELECT doc_id, {_flat(True)} AS flat FROM documents),
need AS (SELECT item_id, {NEED_TEXT} AS need FROM benchmark), pairs AS ({PAIRS}),
have AS (SELECT DISTINCT doc_id, stem FROM ({sk.exploded('flat', 'doc_id', 'flat')})),
want AS ({sk.exploded('need', 'item_id', 'need')}),
hit AS (SELECT p.doc_id, p.item_id, w.term, h.stem IS NOT NULL AS ok FROM pairs p SEMI JOIN flat USING (doc_id)
JOIN want w USING (item_id) LEFT JOIN have h ON h.doc_id = p.doc_id AND h.stem = w.stem)
SELECT doc_id, item_id, coalesce(string_agg(term, ';' ORDER BY term) FILTER (ok), '') AS matched,
coalesce(string_agg(term, ';' ORDER BY term) FILTER (NOT ok), '') AS missing,
round_even(count(*) FILTER (ok)::DOUBLE / count(*), 4) AS score FROM (SELECT p.doc_id, p.item_id, h.term, h.ok FROM hit h JOIN pairs p USING (doc_id, item_id)) p GROUP BY 1, 2"""


@query("score_every_pair_c4_a1_a4_t5", every_pair(SCORE_SQL, "matched, missing, score"))
def scoreevery_pair(spark, sf):
    scored = ma.score(application_pairs(spark, sf), structured(spark, sf),
                      po.analyse(dv.postings(spark, sf)))
    return scored.withColumn("matched", F.array_join("matched", ";")).withColumn(
        "missing", F.array_join("missing", ";"))


@query("score_pairs_c4_a1_a4_t5", SCORE_SQL)
def score_pairs(spark, sf):
    # its SQL states the pairs with a stored profile only
    return scoreevery_pair(spark, sf).where("reason IS NULL").drop("reason")


def _match_sql(mode: str) -> str:
    tiers = lx.SKILL_FAMILIES[: lx.MODE_TIERS[mode]]
    fam = ", ".join(f"({t}, {f}, '{term}')" for t, fams in enumerate(tiers)
                    for f, members in enumerate(fams) for term in members)
    terms = f"list_distinct(list_concat({sk.tokens('lines')}, ['google cloud']))"
    job_have = " UNION ALL ".join(
        f"SELECT doc_id, {j} AS pos, unnest({sk.tokens('jt')}) AS term FROM (SELECT doc_id, "
        f"concat_ws(' ', {dv.job_title(K, j)}, {', '.join(dv.job_bullets(K, j))}) AS jt "
        f"FROM documents WHERE {j} < {dv.job_count(K)})" for j in range(dv.MAX_JOBS))
    return f"""WITH flat AS (SELECT doc_id, {_flat(False)} AS flat FROM documents), pairs AS ({PAIRS}),
have AS (SELECT DISTINCT doc_id, stem FROM ({sk.exploded('flat', 'doc_id', 'flat')})),
need AS (SELECT item_id, concat_ws(' ', array_to_string({REQUIRED}, ' '), array_to_string({PREFERRED}, ' ')) AS lines FROM benchmark),
want AS (SELECT item_id, term, {sk.stem('term')} AS stem FROM (SELECT item_id, unnest({terms}) AS term FROM need)),
fam(tier, family, term) AS (VALUES {fam}),
sib AS (SELECT a.term, b.term AS sibling, {sk.stem('b.term')} AS stem, a.tier, a.family FROM fam a JOIN fam b USING (tier, family) WHERE a.term <> b.term),
hit AS (SELECT p.doc_id, p.item_id, w.term, w.stem, h.stem IS NOT NULL AS ok FROM pairs p SEMI JOIN flat USING (doc_id)
JOIN want w USING (item_id) LEFT JOIN have h ON h.doc_id = p.doc_id AND h.stem = w.stem),
rel AS (SELECT hit.doc_id, hit.item_id, hit.term, sib.sibling FROM hit JOIN sib ON sib.term = hit.term JOIN have h ON h.doc_id = hit.doc_id AND h.stem = sib.stem
WHERE NOT ok QUALIFY row_number() OVER (PARTITION BY hit.doc_id, hit.item_id, hit.term ORDER BY tier, family, sibling) = 1),
jobterm AS (SELECT doc_id, pos, {sk.stem('term')} AS stem FROM ({job_have})),
jobhit AS (SELECT j.doc_id, j.pos, p.item_id, count(DISTINCT w.term) FILTER (w.term IS NOT NULL) AS n FROM (SELECT DISTINCT doc_id, pos FROM jobterm) j JOIN pairs p USING (doc_id)
LEFT JOIN (SELECT DISTINCT jt.doc_id, jt.pos, w.item_id, w.term FROM jobterm jt JOIN want w USING (stem)) w ON w.doc_id = j.doc_id AND w.pos = j.pos AND w.item_id = p.item_id GROUP BY ALL),
prio AS (SELECT doc_id, item_id, string_agg(CAST(pos AS STRING), ';' ORDER BY n DESC, pos) AS prioritized_job_indices FROM jobhit GROUP BY 1, 2)
SELECT h.doc_id, h.item_id, coalesce(string_agg(h.term, ';' ORDER BY h.term) FILTER (ok), '') AS matched_skills,
coalesce(string_agg(h.term || ' (related: ' || sibling || ')', ';' ORDER BY h.term || ' (related: ' || sibling || ')') FILTER (sibling IS NOT NULL), '') AS transferable_skills,
coalesce(string_agg(h.term, ';' ORDER BY h.term) FILTER (NOT ok AND sibling IS NULL), '') AS missing_skills,
any_value(prioritized_job_indices) AS prioritized_job_indices,
round_even(count(*) FILTER (ok)::DOUBLE / count(*), 4) AS preliminary_score
FROM hit h LEFT JOIN rel USING (doc_id, item_id, term) JOIN prio USING (doc_id, item_id) GROUP BY 1, 2"""


def _register_match(mode: str, ids: str) -> None:
    results = ("matched_skills", "transferable_skills", "missing_skills", "prioritized_job_indices", "preliminary_score")

    @query(f"match_every_pair_{mode}_{ids}", every_pair(_match_sql(mode), ", ".join(results)))
    def every(spark, sf):
        m = ma.match(application_pairs(spark, sf), structured(spark, sf),
                     po.analyse(dv.postings(spark, sf)), mode)
        return m.select("doc_id", "item_id", *[
            F.array_join(F.col(c).cast("array<string>"), ";").alias(c)
            for c in results[:4]], "preliminary_score", "reason")

    @query(f"match_{mode}_{ids}", _match_sql(mode))
    def run(spark, sf):
        # its SQL states the pairs with a stored profile only
        return every(spark, sf).where("reason IS NULL").drop("reason")


_register_match("accurate", "c3_j8_w13_a2")
_register_match("aggressive", "c3_j8")
_register_match("aggressive_match", "c3_j8")
