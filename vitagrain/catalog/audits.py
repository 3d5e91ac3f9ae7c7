"""Audit, era, stack, tenure and gap queries over master and tailored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagrain.catalog.base import Catalog
from vitagrain.catalog.profiles import exploded_jobs, structured
from vitagrain.functions import dates as dt
from vitagrain.functions import stacks as sk
from vitagrain.plans import audits as au
from vitagrain.sources import derived as dv

catalog = Catalog()
query = catalog.query

K = "doc_id"
AS_OF = "DATE'2020-06-15'"
FAMILY = ("CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN 'dotnet' WHEN 1 THEN 'python' WHEN 2 THEN 'nodejs' "
          "WHEN 3 THEN 'php' WHEN 4 THEN 'java' ELSE 'golang' END")


def _jobs(fields, bullets):
    return " UNION ALL ".join(
        f"SELECT doc_id, {j} AS pos, " + ", ".join(f"{v} AS {f}" for f, v in fields(j).items())
        + f", [{', '.join(bullets(j))}] AS bullets FROM documents WHERE {j} < {dv.job_count(K)}"
        for j in range(dv.MAX_JOBS))


def _month(expr):
    return f"make_date(CAST(({expr[0]}) AS INT), CAST(({expr[1]}) AS INT), 1)"


SPANS = " UNION ALL ".join(
    f"SELECT doc_id, {j} AS pos, least({_month(dv.job_start(K, j))}, {_month(dv.job_end(K, j))}) AS starts, "
    f"greatest({_month(dv.job_start(K, j))}, {_month(dv.job_end(K, j))}) AS ends FROM documents WHERE {j} < {dv.job_count(K)}"
    for j in range(dv.MAX_JOBS))
M = f"""m AS ({_jobs(lambda j: {'title': dv.job_title(K, j), 'company': dv.job_company(K, j), 'dates': dv.job_dates(K, j)}, lambda j: dv.job_bullets(K, j))})"""
T = f"t AS ({_jobs(lambda j: dv.tailored_fields(K, j), lambda j: dv.tailored_bullets(K, j))})"
S = f"""s AS ({SPANS}), career AS (SELECT doc_id, min(starts) AS first_month, least(max(ends), DATE '2020-06-01') AS last_month FROM s GROUP BY 1),
tenure AS (SELECT doc_id, CASE WHEN last_month >= first_month THEN (year(last_month) - year(first_month)) * 12 + month(last_month) - month(first_month) + 1 END AS months FROM career),
phrases AS (SELECT doc_id, months, CASE WHEN months < 12 THEN 'under 1 year' WHEN months % 12 > 0 THEN (months // 12) || '+ years' ELSE (months // 12) || ' years' END AS phrase FROM tenure)"""
SUMMARY = dv.tailored_summary(K)
NEW_SUMMARY = """CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Engineer with ' || phrase || ' of delivery. Calm under load.'
WHEN 1 THEN 'Platform engineer with ' || phrase || ' of experience. Likes tests'
WHEN 2 THEN 'Seasoned builder with ' || phrase || ' of experience, care. Hands-on with a, b, c.'
WHEN 3 THEN 'Curious person with ' || phrase || ' of experience. Writes well.' ELSE 'Quiet builder with ' || phrase || ' of experience.' END"""
# Unstructured records keep their own (sometimes blank) dates in the tailored form.
LIVE = f"""live AS (SELECT t.doc_id, t.pos, CASE WHEN t.dates = '' AND doc_id % 10 = 9 THEN NULL ELSE s.ends END AS ends,
t.bullets FROM t JOIN s USING (doc_id, pos)),
b AS (SELECT doc_id, pos, ends, unnest(bullets) AS bullet, generate_subscripts(bullets, 1) AS n FROM live),
kept AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, pos, lower(trim(regexp_replace(bullet, '\\s+', ' ', 'g'))) ORDER BY n) = 1)"""
ERA_PAIRS = [("MCP servers", "mcp", "2024-11-01", "platform services"),
             ("ChatGPT", "chatgpt", "2022-11-01", "AI assistants"),
             ("LangChain", "langchain", "2022-10-01", "AI orchestration tooling")]
ERAS = "era(word, rule_key, introduced, neutral) AS (VALUES " + ", ".join(
    f"('{w}', '{k}', DATE '{d}', '{n}')" for w, k, d, n in ERA_PAIRS) + ")"
ALL_ERAS = "rules(rule_key, introduced) AS (VALUES " + ", ".join(
    f"('{k}', DATE '{d}')" for k, d, _ in sk.era_rules()) + ")"
RIVAL = f"""rival AS (SELECT kb.doc_id, kb.pos, kb.n, kb.bullet FROM (SELECT *, {FAMILY} AS fam FROM b) kb WHERE
(fam <> 'php' AND regexp_matches(bullet, 'Laravel|PHP')) OR (fam <> 'python' AND regexp_matches(bullet, 'Python|Django'))
OR (fam <> 'scala' AND contains(bullet, 'Scala')) OR (fam <> 'ruby' AND contains(bullet, 'Rails')))"""


def audited(spark, sf):
    return au.audit(dv.tailored(spark, sf), AS_OF)


@query("audit_issues_c5_a16_j12_w14_a11_a21", f"""WITH {M}, {T}, {S}, {LIVE}, {ERAS}, {ALL_ERAS}, {RIVAL},
flagged AS (SELECT DISTINCT kept.doc_id, kept.pos FROM kept JOIN era ON contains(kept.bullet, word) AND ends < introduced),
issues AS (
SELECT doc_id, 'title drifted' AS rule, pos + 1 AS job, t.title AS detail FROM m JOIN t USING (doc_id, pos) WHERE doc_id % 10 <> 9 AND m.title <> t.title
UNION ALL SELECT doc_id, 'company drifted', pos + 1, t.company FROM m JOIN t USING (doc_id, pos) WHERE doc_id % 10 <> 9 AND m.company <> t.company
UNION ALL SELECT doc_id, 'dates drifted', pos + 1, t.dates FROM m JOIN t USING (doc_id, pos) WHERE doc_id % 10 <> 9 AND m.dates <> t.dates
UNION ALL SELECT doc_id, 'bullets off stack', pos + 1, CAST(count(*) - 2 AS STRING) FROM rival GROUP BY doc_id, pos HAVING count(*) > 2
UNION ALL SELECT doc_id, 'certifications drifted', NULL, '' FROM documents WHERE doc_id % 10 <> 9 AND doc_id % 6 = 0
UNION ALL SELECT doc_id, 'certifications missing', NULL, '' FROM documents WHERE doc_id % 10 = 9 AND doc_id % 6 = 0 AND regexp_matches(lower(text), 'certif|license')
UNION ALL SELECT doc_id, 'duplicate bullets', pos + 1, CAST(any_value(len(bullets)) - count(*) AS STRING) FROM kept JOIN live USING (doc_id, pos) GROUP BY doc_id, pos HAVING count(*) < any_value(len(bullets))
UNION ALL SELECT doc_id, 'bullet count', pos + 1, CAST(count(*) AS STRING) FROM kept GROUP BY doc_id, pos HAVING count(*) <> 8
UNION ALL SELECT f.doc_id, 'anachronism', f.pos + 1, string_agg(r.rule_key, ', ' ORDER BY r.rule_key) FROM flagged f JOIN live USING (doc_id, pos) JOIN rules r ON live.ends < r.introduced GROUP BY f.doc_id, f.pos
UNION ALL SELECT doc_id, 'tenure restated', NULL, phrase FROM phrases JOIN documents USING (doc_id) WHERE phrase IS NOT NULL AND {NEW_SUMMARY} <> {SUMMARY})
SELECT doc_id, rule, CAST(job AS INT) AS job, detail FROM issues""")
def audit_issues(spark, sf):
    return audited(spark, sf).select("doc_id", F.explode_outer("issues").alias("i")).filter(
        "i IS NOT NULL").select("doc_id", "i.rule", "i.job", "i.detail")


@query("audit_corrections_c5_w16_t32", f"""WITH {M}, {T}, {S}, {LIVE}, {ERAS}, {RIVAL},
excess AS (SELECT doc_id, pos, n FROM rival QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n) > 2),
fixed AS (SELECT kept.*, CASE WHEN e.n IS NULL THEN bullet ELSE CASE {FAMILY}
WHEN 'dotnet' THEN regexp_replace(regexp_replace(bullet, 'Laravel', 'ASP.NET Core'), 'PHP', 'C#/.NET')
WHEN 'java' THEN regexp_replace(regexp_replace(bullet, 'Laravel', 'Spring Boot'), 'PHP', 'Java')
WHEN 'nodejs' THEN regexp_replace(regexp_replace(bullet, 'Laravel', 'NestJS'), 'PHP', 'Node.js')
WHEN 'python' THEN regexp_replace(regexp_replace(bullet, 'Laravel', 'Django'), 'PHP', 'Python') ELSE bullet END END AS b1,
e.n IS NOT NULL AS rewritten, {FAMILY} AS fam FROM kept LEFT JOIN excess e USING (doc_id, pos, n)),
swapped AS (SELECT *, CASE WHEN rewritten THEN regexp_replace(b1, CASE fam WHEN 'php' THEN 'Python|Django|Scala|Rails' WHEN 'python' THEN 'Laravel|PHP|Scala|Rails'
ELSE 'Laravel|PHP|Python|Django|Scala|Rails' END, CASE fam WHEN 'dotnet' THEN '.net' WHEN 'nodejs' THEN 'node.js' ELSE fam END, 'g') ELSE b1 END AS b2 FROM fixed),
era_out AS (SELECT s.*, coalesce((SELECT any_value(replace(s.b2, word, neutral)) FROM era WHERE contains(s.b2, word) AND s.ends < introduced), s.b2) AS b3 FROM swapped s)
SELECT o.doc_id, CAST(o.pos AS INT) AS pos, CASE WHEN doc_id % 10 <> 9 THEN m.title ELSE t.title END AS title,
CASE WHEN doc_id % 10 <> 9 THEN m.company ELSE t.company END AS company, CASE WHEN doc_id % 10 <> 9 THEN m.dates ELSE t.dates END AS dates,
string_agg(b3, ';' ORDER BY n) AS bullets FROM era_out o JOIN m USING (doc_id, pos) JOIN t USING (doc_id, pos) GROUP BY ALL""")
def audit_corrections(spark, sf):
    return exploded_jobs(audited(spark, sf)).select(
        "doc_id", "pos", "j.title", "j.company", "j.dates",
        F.array_join("j.bullets", ";").alias("bullets"))


@query("audit_clean_a16_p17", f"""SELECT doc_id, false AS is_clean, 'AWS Certified Developer ' || (doc_id % 7) AS certifications FROM documents WHERE doc_id % 10 <> 9
UNION ALL SELECT doc_id, false, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'AWS Certified Developer ' || (doc_id % 7) END FROM documents WHERE doc_id % 10 = 9""")
def audit_clean(spark, sf):
    return audited(spark, sf).select(
        "doc_id", "is_clean", F.array_join("certifications", ";").alias("certifications"))


@query("tenure_a7_a8_a9_t36", f"""WITH {S} SELECT doc_id, strftime(first_month, '%Y-%m-%d') AS first_month, strftime(last_month, '%Y-%m-%d') AS last_month,
CAST(months AS INT) AS months, CAST(months // 12 AS INT) AS years, phrase, {NEW_SUMMARY} AS summary FROM phrases JOIN career USING (doc_id)""")
def tenure(spark, sf):
    df = structured(spark, sf).select(
        "doc_id", F.expr(SUMMARY).alias("summary"), F.expr(au.span("experience", AS_OF)).alias("s"))
    df = df.withColumn("months", F.expr(dt.months_inclusive("s.starts", "s.ends")))
    df = df.withColumn("phrase", F.expr(dt.tenure_phrase("months")))
    return df.select(
        "doc_id", F.col("s.starts").cast("string").alias("first_month"),
        F.col("s.ends").cast("string").alias("last_month"), "months",
        F.floor(F.col("months") / 12).cast("int").alias("years"), "phrase",
        F.expr(au.tx.with_tenure("summary", "phrase")).alias("summary"))


@query("job_periods_d1_d2_d8_p14", f"""WITH s AS ({SPANS}) SELECT doc_id, CAST(pos AS INT) AS pos, strftime(starts, '%Y-%m') AS starts,
strftime(ends, '%Y-%m') AS ends, ends >= DATE '2016-03-01' AS allowed FROM s""")
def job_periods(spark, sf):
    jobs = exploded_jobs(structured(spark, sf))
    p = jobs.select("doc_id", "pos", F.expr(dt.period("j.dates", AS_OF)).alias("p"))
    return p.select("doc_id", "pos", F.date_format("p.starts", "yyyy-MM").alias("starts"),
                    F.date_format("p.ends", "yyyy-MM").alias("ends"),
                    F.expr(dt.allows("p.ends", "DATE'2016-03-14'")).alias("allowed"))


@query("date_ranges_d3", f"""WITH {M} SELECT doc_id, CAST(pos AS INT) AS pos, true AS dated, company || ' |  x' AS rest FROM m""")
def date_ranges(spark, sf):
    """Detect and strip the period inside a header line."""
    jobs = exploded_jobs(structured(spark, sf))
    line = "concat(j.company, ' | ', j.dates, ' x')"
    return jobs.select("doc_id", "pos", F.expr(au.st.matches(line, dt.FULL_RANGE)).alias("dated"),
                       F.expr(au.st.replace(line, dt.FULL_RANGE)).alias("rest"))


@query("forbidden_technologies_j9", f"""WITH s AS ({SPANS}), {ALL_ERAS} SELECT doc_id, CAST(pos AS INT) AS pos, rule_key FROM s JOIN rules ON ends < introduced""")
def forbidden_technologies(spark, sf):
    """Rules newer than each job; the rule list is a literal, so no join is needed."""
    jobs = exploded_jobs(structured(spark, sf))
    ended = jobs.select("doc_id", "pos", F.expr(f"{dt.period('j.dates', AS_OF)}.ends").alias("ends"))
    return ended.select("doc_id", "pos", F.explode_outer(F.expr(sk.forbidden("ends"))).alias("r")) \
        .filter("r IS NOT NULL").select("doc_id", "pos", "r.rule_key")


@query("technology_mentions_j10", f"""WITH {M}, {ERAS}, b AS (SELECT doc_id, pos, unnest(bullets) AS bullet, generate_subscripts(bullets, 1) AS n FROM m)
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(n - 1 AS INT) AS bullet_pos, rule_key FROM b JOIN era ON contains(bullet, word)""")
def technology_mentions(spark, sf):
    jobs = exploded_jobs(structured(spark, sf))
    bullets = jobs.select("doc_id", "pos", F.posexplode_outer("j.bullets").alias("bullet_pos", "b"))
    return bullets.select("doc_id", "pos", "bullet_pos",
                          F.explode_outer(F.expr(sk.mentions("b"))).alias("m")) \
        .filter("m IS NOT NULL").select("doc_id", "pos", "bullet_pos", "m.rule_key")


MARKS = "marks(word, family) AS (VALUES ('laravel', 'php'), ('php', 'php'), ('django', 'python'), ('python', 'python'), ('scala', 'scala'), ('rails', 'ruby'))"


@query("competing_families_j11_t33", f"""WITH {T}, {MARKS}, b AS (SELECT doc_id, pos, unnest(bullets) AS bullet, generate_subscripts(bullets, 1) AS n, {FAMILY} AS primary_family FROM t)
SELECT DISTINCT doc_id, CAST(pos AS INT) AS pos, CAST(n - 1 AS INT) AS bullet_pos, primary_family, family FROM b JOIN marks ON contains(lower(bullet), word) AND family <> primary_family""")
def competing_families(spark, sf):
    df = dv.tailored(spark, sf).select(
        "doc_id", F.expr(sk.resolve("main_stack")).alias("primary_family"), "tailored")
    jobs = df.select("doc_id", "primary_family", F.posexplode_outer("tailored").alias("pos", "j"))
    bullets = jobs.select("doc_id", "primary_family", "pos",
                          F.posexplode_outer("j.bullets").alias("bullet_pos", "b"))
    return bullets.select(
        "doc_id", "pos", "bullet_pos", "primary_family",
        F.explode_outer(F.expr(sk.competing("b", "primary_family"))).alias("family")
    ).filter("family IS NOT NULL")


@query("unmeasured_bullets_p15", f"""WITH {T}, b AS (SELECT doc_id, pos, unnest(bullets) AS bullet FROM t)
SELECT doc_id, CAST(pos AS INT) AS pos, bullet FROM b WHERE NOT regexp_matches(bullet, '[0-9]')""")
def unmeasured_bullets(spark, sf):
    jobs = exploded_jobs(dv.tailored(spark, sf).selectExpr("doc_id", "tailored AS experience"))
    return jobs.select("doc_id", "pos", F.explode_outer(F.expr(au.unmeasured("j.bullets"))).alias("bullet")) \
        .filter("bullet IS NOT NULL")


# --- gaps ------------------------------------------------------------------------------
LISTED = dv.profile_skills(K)
HAVE = f"[{dv.pick(dv.SKILLS, K)}, {dv.pick(dv.SKILLS, K + ' + 1')}]"
CATS = "cats(term, grp) AS (VALUES ('python', 'languages'), ('scala', 'languages'), ('kafka', 'tools'), ('postgresql', 'databases'), ('docker', 'devops'), ('react', 'frontend'), ('aws', 'cloud'), ('terraform', 'devops'), ('graphql', 'tools'), ('mysql', 'databases'), ('laravel', 'backend'))"


def gap_rows(spark, sf):
    """Candidate terms of each profile beside the skills its tailored form lists."""
    s = LISTED
    docs = dv.tailored(spark, sf).select("doc_id", "summary")
    return docs.selectExpr(
        "doc_id", "summary",
        f"array(lower({s[0]}), 'stakeholders', 'ci/cd') AS matched_skills",
        f"array(concat(lower({s[1]}), ' (related: x)')) AS transferable_skills",
        f"array(lower({s[2]})) AS preferred_matched",
        f"array(concat(lower({s[3]}), ' (related: y)')) AS preferred_transferable",
        f"array(named_struct('grp', 'tools', 'term', {dv.pick(dv.SKILLS, K)}), "
        f"named_struct('grp', 'tools', 'term', {dv.pick(dv.SKILLS, K + ' + 1')})) AS skills",
        f"array({', '.join(s[:3])}) AS cv_skills")


@query("close_gaps_c6_n6_g5_t30_t31_t34_t35", f"""WITH c AS (SELECT doc_id, [lower({LISTED[2]}), lower({LISTED[3]})] AS pref,
[lower({LISTED[2]}), lower({LISTED[3]}), lower({LISTED[0]}), 'stakeholders', 'ci/cd', lower({LISTED[1]})] AS cand,
list_transform({HAVE}, lambda x: lower(x)) AS have, [{', '.join(LISTED[:3])}] AS cv, {SUMMARY} AS summary FROM documents), {CATS},
x AS (SELECT doc_id, unnest(cand) AS term, generate_subscripts(cand, 1) AS n, have, cv, pref FROM c),
a AS (SELECT x.*, CASE WHEN x.term = 'ci/cd' THEN 'tools' ELSE cats.grp END AS grp FROM x LEFT JOIN cats USING (term)
WHERE NOT list_contains(have, x.term) AND NOT (x.term = 'sql' ) QUALIFY row_number() OVER (PARTITION BY doc_id, x.term ORDER BY n) = 1),
added AS (SELECT doc_id, string_agg(grp || ':' || coalesce(list_filter(cv, lambda o: lower(o) = term)[1], CASE WHEN term IN ('ci/cd', 'aws', 'graphql') AND term <> 'graphql' THEN upper(term) ELSE upper(term[1]) || term[2:] END)
|| ':' || CASE WHEN list_contains(pref, term) THEN 'preferred' ELSE 'matched/transferable' END, ';' ORDER BY n) AS added FROM a WHERE grp IS NOT NULL GROUP BY 1),
w AS (SELECT doc_id, pref, CASE CAST(doc_id % 5 AS INT) WHEN 1 THEN 'Platform engineer. Likes tests.' WHEN 2 THEN 'Seasoned builder with care.' WHEN 4 THEN 'Quiet builder.' ELSE summary END AS cleaned FROM c)
SELECT doc_id, coalesce(added, '') AS added, array_to_string(pref, ';') AS woven,
cleaned || ' Additional strengths include ' || pref[1] || ' and ' || pref[2] || ', aligned with this role''s preferred qualifications.' AS summary FROM w LEFT JOIN added USING (doc_id)""")
def close_gaps(spark, sf):
    g = au.close_gaps(gap_rows(spark, sf))
    return g.select("doc_id", F.expr(
        "array_join(transform(added, a -> concat(a.grp, ':', a.term, ':', a.kind)), ';')").alias("added"),
        F.array_join("woven", ";").alias("woven"), "summary")
