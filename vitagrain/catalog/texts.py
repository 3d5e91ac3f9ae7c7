"""Keyword, line, header, contact and prose queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagrain.catalog import sqlkit as sk
from vitagrain.catalog.base import Catalog
from vitagrain.catalog.coverage import PAIRS as SCORED
from vitagrain.catalog.coverage import WEAK, corpus, weighed_corpus
from vitagrain.catalog.profiles import JOBS, PREFERRED, REQUIRED, exploded_jobs, structured
from vitagrain.functions import headers as hd
from vitagrain.functions import lexicon as lx
from vitagrain.functions import sqltext as st
from vitagrain.functions import text as tx
from vitagrain.functions import tokens as tk
from vitagrain.operators import lines as ln
from vitagrain.operators import matching as mt
from vitagrain.plans import postings as po
from vitagrain.plans import profiles as pf
from vitagrain.sources import derived as dv
from vitagrain.sources.tables import read_table

catalog = Catalog()
query = catalog.query
K = "doc_id"


def joined(expr: str, name: str):
    return F.expr(f"array_join({expr}, ';')").alias(name)


# --- keywords -----------------------------------------------------------------------
@query("keywords_t1_t2_t3_a3_n3", f"SELECT doc_id, array_to_string({sk.tokens('text')}, ';') AS keywords FROM documents")
def keywords(spark, sf):
    return corpus(spark, sf).select("doc_id", joined(tk.keywords("text"), "keywords"))


@query("stems_t4", f"SELECT d.doc_id, coalesce(string_agg(DISTINCT stem, ';' ORDER BY stem), '') AS stems FROM documents d LEFT JOIN ({sk.exploded('documents', 'doc_id')}) e USING (doc_id) GROUP BY 1")
def stems(spark, sf):
    out = corpus(spark, sf).select("doc_id", joined(
        f"array_sort({tk.stems(tk.keywords('text'))})", "stems"))
    return out


BEST = f"""WITH {SCORED}, weak AS (SELECT doc_id, {WEAK} AS weak_lines FROM documents),
best AS (SELECT item_id, doc_id FROM scored JOIN weak USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, weak_lines, doc_id) = 1)"""


def best_terms(spark, sf, kind):
    """Matched or missing terms of every posting with its best document, from one pass over the pairs."""
    docs, postings = weighed_corpus(spark, sf), read_table(spark, sf, "benchmark")
    best = mt.best_documents(docs, postings).select("item_id", "doc_id")
    scored = mt.score_pairs(best, docs.drop("weak_lines"), mt.required_terms(mt.with_keywords(postings)))
    return scored.select("item_id", "doc_id", F.explode_outer(kind).alias("term")).filter("term IS NOT NULL")


@query("matched_terms_j6_g3", f"{BEST} SELECT t.item_id, t.doc_id, t.term FROM (SELECT * FROM item_terms JOIN best USING (item_id)) t SEMI JOIN stems s ON s.doc_id = t.doc_id AND s.stem = t.stem")
def matched_terms(spark, sf):
    return best_terms(spark, sf, "matched")


@query("missing_terms_j7_g4", f"{BEST} SELECT t.item_id, t.doc_id, t.term FROM (SELECT * FROM item_terms JOIN best USING (item_id)) t ANTI JOIN stems s ON s.doc_id = t.doc_id AND s.stem = t.stem")
def missing_terms(spark, sf):
    return best_terms(spark, sf, "missing")


VOCAB = "vocab(category, term) AS (VALUES " + ", ".join(
    f"('{c}', '{t}')" for c, ts in lx.CATEGORIES.items() for t in ts) + ")"
PROFILE = f"p AS (SELECT doc_id, {dv.profile_text(K, 'text')} AS text FROM documents)"


@query("dictionary_matches_t6_w15", f"""WITH {PROFILE}, {VOCAB}, k AS (SELECT doc_id, lower(text) AS lt, {sk.tokens('text')} AS kw FROM p),
hits AS (SELECT doc_id, category, term FROM k JOIN vocab ON list_contains(kw, term) OR
(contains(lt, term) AND regexp_matches(lt, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_replace(term, '([.+])', '\\\\\\1', 'g') || '($|[^\\p{{L}}\\p{{N}}_])') AND regexp_matches(term, '^[a-z0-9].*[a-z0-9]$|^[a-z]$')))
SELECT doc_id, category, string_agg(term, ';' ORDER BY len(string_split(term, ' ')) DESC, term) AS terms FROM hits GROUP BY 1, 2""")
def dictionary_matches(spark, sf):
    terms = [t for ts in lx.CATEGORIES.values() for t in ts]
    base = dv.profiles(spark, sf).selectExpr("doc_id", "text", "lower(text) AS lt").selectExpr(
        "doc_id", "lt", f"{tx.known(tk.keywords('text'), terms)} AS kw", f"{tx.known_runs('lt', terms)} AS rn")
    cats = ", ".join(
        f"named_struct('category', '{c}', 'terms', array_join({tx.vocabulary_hits('kw', 'lt', ts, runs='rn')}, ';'))"
        for c, ts in lx.CATEGORIES.items())
    return base.select("doc_id", F.explode_outer(F.expr(f"array({cats})")).alias("c")).select(
        "doc_id", "c.category", "c.terms").filter("terms <> ''")


POSTING_TERMS = f"list_sort(list_distinct(list_concat({sk.tokens(f'array_to_string(list_concat({REQUIRED}, {PREFERRED}), chr(32))')}, ['google cloud'])))"
NOISE = sk.quoted(lx.PREFERRED_NOISE)


@query("posting_terms_g1_g2_j16", f"""SELECT item_id, array_to_string({POSTING_TERMS}, ';') AS terms,
array_to_string(list_filter({sk.tokens(f"array_to_string({PREFERRED}, ' ')")}, lambda t: NOT list_contains([{NOISE}], t) AND
(length(t) >= 4 OR list_contains(['aws'], t))), ';') AS preferred FROM benchmark""")
def posting_terms(spark, sf):
    return po.analyse(dv.postings(spark, sf)).select(
        "item_id", joined(po.all_terms(), "terms"), joined(po.preferred_terms(), "preferred"))


TECH = "tech(term, grp) AS (VALUES ('python', 'languages'), ('scala', 'languages'), ('kafka', 'tools'), ('postgresql', 'databases'), ('docker', 'devops'), ('react', 'frontend'), ('aws', 'cloud'), ('terraform', 'devops'), ('graphql', 'tools'), ('mysql', 'databases'), ('laravel', 'backend'))"


@query("skill_categories_t30_t31_g6", f"""WITH {TECH}, w AS (SELECT p_partkey AS id, unnest(list_concat(string_split(p_name, ' '), [{dv.pick(dv.SKILLS, 'p_partkey')}])) AS word FROM part)
SELECT id, word, grp AS skill_group, CASE WHEN lower(word) = 'aws' THEN 'AWS' ELSE upper(lower(word)[1]) || lower(word)[2:] END AS display
FROM w LEFT JOIN tech ON term = lower(word)""")
def skill_categories(spark, sf):
    words = read_table(spark, sf, "part").select("p_partkey", F.explode_outer(F.expr(
        f"concat(split(p_name, ' '), array({dv.pick(dv.SKILLS, 'p_partkey')}))")).alias("word"))
    return words.select(
        F.col("p_partkey").alias("id"), "word", F.expr(tx.skill_category("word")).alias("skill_group"),
        F.expr(tx.display_form("lower(word)", pf.EMPTY_TEXTS)).alias("display"))


@query("vocabulary_order_o5", "SELECT DISTINCT p_name AS term, len(string_split(p_name, ' ')) AS n_words FROM part ORDER BY n_words DESC, term")
def vocabulary_order(spark, sf):
    terms = read_table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct()
    return terms.withColumn("n_words", F.size(F.split("term", " ")).cast("bigint")).orderBy(
        F.col("n_words").desc(), "term")


# --- cleaning ------------------------------------------------------------------------------
DIRTY = "CONCAT('□ ', text, '  |  | ', chr(9), text, ' |')"
CLEANED = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, "
           "'[\\x{{FFFD}}\\x{{FFFC}}\\x{{FEFF}}\\x{{25A0}}-\\x{{25FF}}\\x{{2B1B}}\\x{{2B1C}}\\x{{E000}}-\\x{{F8FF}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]+', '', 'g'), "
           "'(?:\\s*\\|\\s*){{2,}}', ' | ', 'g'), '(?:^(?:\\s*[|•]\\s*)+)|(?:(?:\\s*[|•]\\s*)+$)', '', 'g'), "
           "'[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10))")


@query("clean_text_t7", f"SELECT doc_id, {CLEANED.format(DIRTY)} AS cleaned FROM documents")
def clean_text(spark, sf):
    return corpus(spark, sf).select("doc_id", F.expr(tx.clean(DIRTY)).alias("cleaned"))


@query("clean_lists_t8", f"""SELECT doc_id, array_to_string(list_filter(list_transform(list_concat(string_split(text, chr(10)), ['□', ' a □ b ']),
lambda v: {CLEANED.format('v')}), lambda v: v <> ''), '~') AS items FROM documents""")
def clean_lists(spark, sf):
    items = "concat(split(text, '\\n'), array('□', ' a □ b '))"
    return corpus(spark, sf).select("doc_id", F.expr(
        f"array_join({tx.clean_items(items)}, '~')").alias("items"))


@query("extracted_lines_t23_n1", f"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line,
generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS pos FROM documents)
SELECT doc_id, CAST(pos AS INT) AS pos, trim({CLEANED.format('line')}, ' |,-–—') AS line FROM l""")
def extracted_lines(spark, sf):
    rows = corpus(spark, sf).select("doc_id", F.posexplode_outer(F.expr(tx.lines("text"))).alias("pos", "raw")) \
        .filter("pos IS NOT NULL")
    return rows.select("doc_id", "pos", F.expr(
        tx.clean_extracted("concat('• Major: ', raw)")).alias("line"))


# --- profile lines ---------------------------------------------------------------------------
LINES = f"""{PROFILE}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM p),
ln AS (SELECT doc_id, n, trim({CLEANED.format('raw')}) AS line FROM l WHERE trim({CLEANED.format('raw')}) <> ''),
hd AS (SELECT *, CASE WHEN line = 'Summary' THEN 'summary' WHEN line = 'Technical Skills:' THEN 'skills' WHEN line = 'Work Experience' THEN 'experience'
WHEN line = 'Education' THEN 'education' WHEN line = 'Certifications' THEN 'certifications' END AS head FROM ln),
sec AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS kind FROM hd)"""


@query("section_fill_w3_w4_t18", f"""WITH {LINES} SELECT doc_id, kind, count(*) FILTER (head IS NULL) AS n_lines,
md5(string_agg(line, '~' ORDER BY n) FILTER (head IS NULL AND kind <> 'summary')) AS content FROM sec WHERE kind IS NOT NULL GROUP BY 1, 2""")
def section_fill(spark, sf):
    df = pf.with_lines(dv.profiles(spark, sf))
    seg = df.select("doc_id", F.explode_outer(F.expr(ln.sections("lines", "heads"))).alias("s"))
    return seg.filter("s IS NOT NULL").select(
        "doc_id", "s.kind", F.size("s.lines").cast("bigint").alias("n_lines"),
        F.expr("CASE WHEN s.kind <> 'summary' THEN md5(array_join(s.lines, '~')) END").alias("content"))


@query("line_kinds_t17_a19", f"""WITH {LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS pos, line,
regexp_matches(line, '(19|20)\\d\\d – ') AS boundary, starts_with(line, '- ') AS bullet,
list_contains([{sk.quoted(dv.TITLES)}], line) AS title, list_contains([{sk.quoted(dv.COMPANIES)}], line) AS company,
bool_or(starts_with(line, '- ')) OVER (PARTITION BY doc_id) AS any_bullet FROM sec WHERE kind = 'experience' AND head IS NULL""")
def line_kinds(spark, sf):
    df = pf.with_sections(pf.with_lines(dv.profiles(spark, sf)))
    rows = df.select("doc_id", F.expr("exists(flatten(job_segments), x -> x.bullet)").alias("any_bullet"),
                     F.posexplode_outer(F.expr("flatten(job_segments)")).alias("pos", "x"))
    return rows.filter("pos IS NOT NULL").select(
        "doc_id", "pos", "x.line", "x.boundary", "x.bullet", "x.title", "x.company", "any_bullet")


@query("jobs_by_bullets_w12", f"""WITH {LINES}, e AS (SELECT *, starts_with(line, '- ') AS b FROM sec WHERE kind = 'experience' AND head IS NULL),
o AS (SELECT *, CASE WHEN NOT b AND lag(b) OVER (PARTITION BY doc_id ORDER BY n) THEN 1 ELSE 0 END AS opens FROM e),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) AS job FROM o)
SELECT doc_id, CAST(job AS INT) AS pos, count(*) FILTER (NOT b) AS n_header, count(*) FILTER (b) AS n_bullets FROM g GROUP BY 1, 2""")
def jobs_by_bullets(spark, sf):
    df = pf.with_sections(pf.with_lines(dv.profiles(spark, sf)))
    rows = df.select("doc_id", F.posexplode_outer(F.expr(
        ln.jobs_by_bullets("flatten(job_segments)"))).alias("pos", "g")).filter("pos IS NOT NULL")
    return rows.select("doc_id", "pos",
                       F.expr("CAST(size(filter(g, x -> NOT x.bullet)) AS BIGINT)").alias("n_header"),
                       F.expr("CAST(size(filter(g, x -> x.bullet)) AS BIGINT)").alias("n_bullets"))


def bullets_of(spark, sf):
    """Jobs parsed back from the rendered profile, whole stored text included."""
    return structured(spark, sf).selectExpr("doc_id", "experience AS master", "experience AS tailored")


BULLETS = "b AS (SELECT doc_id, pos, unnest(bullets) AS bullet, generate_subscripts(bullets, 1) AS n FROM jobs)"


@query("filled_bullets_w21", f"""WITH {JOBS}, {BULLETS}, c AS (SELECT t.doc_id, t.pos, b.bullet, CASE WHEN b.pos = t.pos THEN 0 ELSE 1 END AS src, b.pos AS bpos, b.n
FROM (SELECT doc_id, pos FROM jobs) t JOIN b USING (doc_id)),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, c.pos, bullet ORDER BY src, bpos, n) = 1)
SELECT doc_id, CAST(pos AS INT) AS pos, string_agg(bullet, ';' ORDER BY src, bpos, n) AS bullets FROM d GROUP BY 1, 2""")
def filled_bullets(spark, sf):
    jobs = "transform(master, j -> transform(j.bullets, b -> replace(b, '  ', ' ')))"
    rows = bullets_of(spark, sf).select("doc_id", F.posexplode_outer(F.expr(
        ln.filled(jobs))).alias("pos", "b")).filter("pos IS NOT NULL")
    return rows.select("doc_id", "pos", F.array_join("b", ";").alias("bullets"))


@query("job_digest_w19", f"""WITH {JOBS} SELECT doc_id, string_agg(title || ' at ' || company || ' (' || dates || ')' || chr(10) ||
array_to_string(list_transform(bullets, lambda b: '  - ' || b), chr(10)), chr(10) || chr(10) ORDER BY pos) AS digest FROM jobs GROUP BY 1""")
def job_digest(spark, sf):
    tidy = ("transform(master, j -> named_struct('title', j.title, 'company', j.company, "
            "'dates', j.dates, 'bullets', transform(j.bullets, b -> replace(b, '  ', ' '))))")
    return bullets_of(spark, sf).selectExpr("doc_id", f"{tidy} AS jobs").select(
        "doc_id", F.expr(ln.digest("jobs")).alias("digest"))


@query("positional_zip_n4_n2_n8", f"""WITH {JOBS} SELECT doc_id, string_agg(title || '@' || company, ';' ORDER BY pos) AS headers, count(*) AS n_jobs FROM jobs GROUP BY 1""")
def positional_zip(spark, sf):
    """Parallel arrays zipped by position and put back into one nested value."""
    df = bullets_of(spark, sf).selectExpr(
        "doc_id", "transform(CASE WHEN size(master) > 0 THEN master ELSE tailored END, j -> j.title) AS ts",
        "transform(master, j -> j.company) AS cs")
    return df.selectExpr(
        "doc_id", "array_join(transform(arrays_zip(ts, cs), z -> concat(z.ts, '@', z.cs)), ';') AS headers",
        "CAST(size(ts) AS BIGINT) AS n_jobs")


@query("header_reliability_p16", f"""WITH {JOBS} SELECT doc_id, bool_and(NOT (doc_id % 4 = 0 AND pos = 0) AND NOT (doc_id % 6 = 1 AND pos = 1)) AS reliable FROM jobs GROUP BY 1""")
def header_reliability(spark, sf):
    """Profiles whose first title repeats as company, or whose second company is blank."""
    spoilt = ("transform(master, (j, i) -> named_struct('title', j.title, 'company', "
              "CASE WHEN doc_id % 4 = 0 AND i = 0 THEN upper(j.title) "
              "WHEN doc_id % 6 = 1 AND i = 1 THEN '' ELSE j.company END))")
    return bullets_of(spark, sf).selectExpr("doc_id", f"{spoilt} AS jobs").select("doc_id", F.expr(
        f"size(jobs) > 0 AND forall(jobs, j -> {hd.header_reliable('j.title', 'j.company')})").alias("reliable"))


# --- headers, skills, education, contact -----------------------------------------------------------
@query("title_company_splits_t12_t13_t14_t15", f"""SELECT doc_id, {dv.job_title(K, 0)} AS slash_title, {dv.job_company(K, 0)} || ' - Split' AS slash_company,
{dv.job_title(K, 1)} || ' | Web' AS pipe_title, {dv.job_company(K, 2)} AS pipe_company,
{dv.job_title(K, 0)} AS clipped_title, {dv.job_company(K, 1)} AS clipped_company FROM documents""")
def title_company_splits(spark, sf):
    t0, c0, t1, c2 = (dv.job_title(K, 0), dv.job_company(K, 0), dv.job_title(K, 1), dv.job_company(K, 2))
    docs = corpus(spark, sf).selectExpr(
        "doc_id", f"concat({t0}, ' / ', {c0}, ' - Split') AS slash",
        f"concat({t1}, ' | Web | ', {c2}) AS pipe",
        f"concat('□ ', {t0}, ' Designed  many things') AS duty",
        f"concat({dv.job_company(K, 1)}, ' ', {dv.job_dates(K, 1)}) AS dated")
    docs = docs.selectExpr("doc_id", f"{hd.slash_split('slash')} AS s", f"{hd.pipe_split('pipe')} AS p",
                           f"{hd.clip_title('duty')} AS clipped_title",
                           f"{hd.clip_company('dated', chr(39) * 2)} AS clipped_company")
    return docs.selectExpr("doc_id", "s.title AS slash_title", "s.company AS slash_company",
                           "p.title AS pipe_title", "p.company AS pipe_company",
                           "clipped_title", "clipped_company")


S4 = dv.profile_skills(K)


@query("skill_tokens_t21_w10", f"SELECT doc_id, concat_ws(';', {S4[0]}, {S4[1]}, {S4[2]}, 'deep work', {S4[3]}) AS skills FROM documents")
def skill_tokens(spark, sf):
    """A wrapped second line belongs to the label above it; repeats drop out."""
    lines = (f"array(concat('Core: ', {S4[0]}, ', ', {S4[1]}), concat('Also: ', {S4[2]}, ' | deep'), "
             f"concat('work, ', {S4[3]}, '; ', upper({S4[0]})))")
    return corpus(spark, sf).select("doc_id", joined(pf.skills(lines), "skills"))


@query("education_blocks_w11_t22", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Bachelor of Science|North University|2001 - 2005;Master of Arts|East College|Sep 2006 - Jun 2008'
ELSE 'Bachelor of Science|North University|2001 - 2005' END AS education FROM documents""")
def education_blocks(spark, sf):
    lines = ("concat(array('North University | 2001 - 2005', 'Bachelor of Science'), CASE WHEN doc_id % 2 = 0 "
             "THEN array('Sep 2006 - Jun 2008', 'East College', 'Master of Arts') "
             "ELSE CAST(array() AS ARRAY<STRING>) END)")
    return corpus(spark, sf).select("doc_id", F.expr(
        f"array_join(transform({pf.education(lines)}, e -> concat_ws('|', e.degree, e.institution, e.dates)), ';')"
    ).alias("education"))


PHONE = "CONCAT('+38555', lpad(CAST(doc_id AS STRING), 6, '0'))"


@query("contact_blocks_w23_t19", f"""SELECT doc_id, 'Ann Sample' AS name, 'p' || doc_id || '@example.com' AS email, {PHONE} AS phone,
CASE WHEN doc_id % 2 = 0 THEN '11000 Belgrade Serbia' ELSE 'Split, Croatia' END AS location, 'linkedin.com/in/p' || doc_id AS linkedin FROM documents""")
def contact_blocks(spark, sf):
    lines = (f"array('Ann', 'Sample', CONCAT({PHONE}, ' p', CAST(doc_id AS STRING), '@example.com', "
             f"CASE WHEN doc_id % 2 = 0 THEN ' 11000 Belgrade Serbia' ELSE '' END), "
             f"CONCAT('linkedin.com/in/p', CAST(doc_id AS STRING)), 'Senior Engineer | React | Web', 'Split, Croatia')")
    return corpus(spark, sf).selectExpr("doc_id", f"{pf.contact(lines)} AS c").select(
        "doc_id", "c.name", "c.details.email", "c.details.phone", "c.details.location", "c.details.linkedin")


@query("contact_tokens_t19_t20", """SELECT doc_id, regexp_extract(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+', 0) AS email,
regexp_extract(text, '\\+?\\d[\\d\\-.\\s()]{7,}\\d', 0) AS phone,
len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+'))) AS n_mail_lines FROM documents""")
def contact_tokens(spark, sf):
    return corpus(spark, sf).select(
        "doc_id", F.regexp_extract("text", tx.EMAIL, 0).alias("email"),
        F.regexp_extract("text", tx.PHONE, 0).alias("phone"),
        F.expr(f"CAST(size(filter(split(text, '\\n'), x -> {st.matches('x', tx.EMAIL)} "
               f"AND {hd.is_contact('x')})) AS BIGINT)").alias("n_mail_lines"))


@query("prose_lines_t20", """SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 80
AND length(x) - length(replace(x, ' ', '')) >= 10 AND NOT regexp_matches(x, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+')
AND NOT regexp_matches(x, '\\+?\\d[\\d\\-.\\s()]{7,}\\d') AND NOT (contains(x, '|') AND length(x) < 120))) AS n_prose FROM documents""")
def prose_lines(spark, sf):
    return corpus(spark, sf).select("doc_id", F.expr(
        f"CAST(size(filter(split(text, '\\n'), x -> {hd.is_prose('x')})) AS BIGINT)").alias("n_prose"))


# --- skills and prose ----------------------------------------------------------------------------------
@query("normalised_skills_w17_t31", f"""SELECT doc_id, 'languages:' || {S4[0]} || ';languages:CI/CD;tools:' || {S4[1]} || ';tools:Openstack' AS skills FROM documents""")
def normalised_skills(spark, sf):
    """The first group and position of a repeated term wins; spelling follows the profile."""
    rows = (f"array(named_struct('grp', 'languages', 'term', lower({S4[0]})), "
            f"named_struct('grp', 'languages', 'term', 'ci/cd'), "
            f"named_struct('grp', 'tools', 'term', upper({S4[0]})), "
            f"named_struct('grp', 'tools', 'term', {S4[1]}), named_struct('grp', 'tools', 'term', ' openstack '), "
            f"named_struct('grp', 'tools', 'term', 'CI/CD'))")
    kept = ln.first_by_key("sk", "lower(trim(x.term))")
    df = corpus(spark, sf).selectExpr("doc_id", f"{rows} AS sk", f"array({', '.join(S4)}) AS cv")
    return df.selectExpr("doc_id", f"{kept} AS kept", "cv").select("doc_id", F.expr(
        f"array_join(transform(kept, s -> concat(s.grp, ':', {tx.display_form('s.term', 'cv')})), ';')").alias("skills"))


@query("questions_w18", """WITH q AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM q WHERE trim(raw) <> ''),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY n) = 1)
SELECT t.doc_id, coalesce(string_agg(line, '~' ORDER BY n), '') AS questions FROM documents t LEFT JOIN d USING (doc_id) GROUP BY 1""")
def questions(spark, sf):
    lines = f"transform(split(text, '\\n'), x -> {st.collapse('x')})"
    return corpus(spark, sf).select("doc_id", F.expr(
        f"array_join({st.first(tx.distinct_folded(lines))}, '~')").alias("questions"))


Q = "array('Why us?', 'Notice period?', 'Salary?')"
DRAFT = ("CASE WHEN doc_id % 3 = 0 THEN array(named_struct('question', ' notice  PERIOD?', 'answer', 'Two weeks'), "
         "named_struct('question', 'Why', 'answer', 'Good team')) "
         "WHEN doc_id % 3 = 1 THEN array(named_struct('question', 'x', 'answer', ' '), named_struct('question', 'Salary?', 'answer', 'Open')) "
         "ELSE array(named_struct('question', 'Salary?', 'answer', 'Fair'), named_struct('question', 'Why us?', 'answer', 'Mission'), "
         "named_struct('question', 'z', 'answer', 'Soon')) END")


@query("aligned_answers_j13", """SELECT doc_id, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'Two weeks;Good team;none' WHEN 1 THEN 'Open;none;none' ELSE 'Mission;Fair;Soon' END AS answers FROM documents""")
def aligned_answers(spark, sf):
    """First question takes the first draft when no wording fits, as each draft is used once."""
    return corpus(spark, sf).select("doc_id", F.expr(
        f"array_join(transform({ln.aligned(Q, DRAFT)}, v -> coalesce(v, 'none')), ';')").alias("answers"))


@query("hedged_answers_t38", """SELECT conv_id, turn, turn % 2 = 1 AS hedged FROM conversations""")
def hedged_answers(spark, sf):
    text = ("CASE WHEN turn % 2 = 1 THEN concat(text, ' That is not documented here.') "
            "ELSE concat(text, ' That is documentedly here.') END")
    return read_table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr(st.matches(text, tx.HEDGE)).alias("hedged"))


@query("next_turns_w24", "SELECT a.conv_id, a.turn, a.role, b.role AS next_role, length(b.text) AS next_length FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1")
def next_turns(spark, sf):
    """Each turn beside the next one, joined on (conversation, turn) so that a
    long conversation spreads over tasks."""
    turns = read_table(spark, sf, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"),
                         F.length("text").cast("bigint").alias("next_length"))
    return turns.select("conv_id", "turn", "role").join(after, ["conv_id", "turn"], "left")


@query("truncated_texts_t37", "SELECT doc_id, CASE WHEN length(text) > 1800 THEN text[1:1800] || chr(10) || '...(truncated)' ELSE text END AS clip FROM documents")
def truncated_texts(spark, sf):
    """The clip is the feature: prompts carry a bounded excerpt."""
    return corpus(spark, sf).select("doc_id", F.expr(tx.truncated("text", 1800)).alias("clip"))


@query("prose_lists_t35_t41_t42", f"""SELECT p_partkey AS id, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN p_brand WHEN 2 THEN p_brand || ' and ' || p_type
ELSE p_brand || ', ' || p_type || ', and ' || p_name END AS prose, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '' ELSE 'Tools: ' || array_to_string([p_brand, p_type, p_name][1:p_partkey % 4], ', ') END AS labelled,
array_to_string(list_transform([p_brand, p_type, p_name][1:p_partkey % 4], lambda v, i: i || '. ' || v), '~') AS numbered FROM part""")
def prose_lists(spark, sf):
    vals = "slice(array(p_brand, p_type, p_name), 1, CAST(p_partkey % 4 AS INT))"
    df = read_table(spark, sf, "part").selectExpr("p_partkey AS id", f"{vals} AS v")
    return df.select("id", F.expr(tx.prose_list("v")).alias("prose"),
                     F.expr(f"array_join({tx.labelled_lines([('Tools', 'v')])}, ';')").alias("labelled"),
                     F.expr(f"replace({tx.numbered('v')}, '\\n', '~')").alias("numbered"))


@query("dictionary_tags_t39", """SELECT p_partkey AS id, coalesce(CASE WHEN regexp_matches(p_name, '\\bwidget\\b') THEN 'widget' WHEN regexp_matches(p_name, '\\bgizmo\\b') THEN 'gizmo' WHEN regexp_matches(p_name, '\\bring\\b') THEN 'ring' END,
CASE WHEN p_type = 'PROMO' THEN 'offer' ELSE '' END) AS tag FROM part""")
def dictionary_tags(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", "p_name", "p_type").select(
        F.col("p_partkey").alias("id"), F.expr(tx.dictionary_tag(
            "replace(p_name, ' ', '_')", ["ring", "gizmo", "widget"], "p_type", [("promo", "offer")])).alias("tag"))


@query("reading_order_o8", """SELECT l_orderkey AS page, round(l_quantity / 7, 1) AS y, round(l_tax, 1) AS x, l_partkey AS block FROM lineitem WHERE l_returnflag <> 'N'""")
def reading_order(spark, sf):
    """Blocks by page, then rounded y and x; blank blocks drop out."""
    blocks = read_table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS page", "round(l_quantity / 7, 1) AS y", "round(l_tax, 1) AS x",
        "l_partkey AS block", "CASE WHEN l_returnflag = 'N' THEN ' ' ELSE 'text' END AS text")
    return blocks.filter(F.trim("text") != "").drop("text").orderBy("page", "y", "x", "block")


@query("company_from_bullet_w25_w7", f"""SELECT doc_id, {dv.job_title(K, 0)} AS title, {dv.job_company(K, 0)} AS company,
CASE WHEN doc_id % 2 = 0 THEN 'Ran ' || (doc_id % 30 + 2) || ' services' ELSE 'ran both sites' END AS bullets FROM documents""")
def company_from_bullet(spark, sf):
    """Headers without an employer take it from a company-like first bullet."""
    text = (f"concat('Ann Lee\\nSummary\\n', text, '\\nCareer\\nsome stray remark.\\n', {dv.job_title(K, 0)}, ' ', {dv.job_dates(K, 0)}, "
            f"'\\n- ', {dv.job_company(K, 0)}, '\\n- ', CASE WHEN doc_id % 2 = 0 THEN concat('Ran ', doc_id % 30 + 2, ' services') "
            f"ELSE 'ran both sites' END)")
    docs = corpus(spark, sf).selectExpr("doc_id", f"{text} AS text")
    return exploded_jobs(pf.structure(docs)).select(
        "doc_id", "j.title", "j.company", F.array_join("j.bullets", ";").alias("bullets"))


@query("skill_digest_w18_t41", f"""SELECT doc_id, concat_ws(', ', {S4[0]}, 'Fjord', {S4[1]}, {S4[2]}) AS digest,
'Languages: ' || {S4[0]} || '~Cloud: Fjord~Tools: ' || {S4[1]} || ', ' || lower({S4[0]}) || ', ' || {S4[2]} AS lines FROM documents""")
def skill_digest(spark, sf):
    """Grouped skills as labelled lines, and as one digest without repeats."""
    held = {"languages": f"array({S4[0]})", "cloud": "array('Fjord')",
            "tools": f"array({S4[1]}, lower({S4[0]}), {S4[2]})"}
    groups = [(label, held.get(g, pf.EMPTY_TEXTS)) for g, label in lx.SKILL_GROUPS.items()]
    flat = f"concat({', '.join(v for _, v in groups)})"
    return corpus(spark, sf).select(
        "doc_id", F.expr(tx.skill_digest(flat)).alias("digest"),
        F.expr(f"array_join({tx.labelled_lines(groups)}, '~')").alias("lines"))
