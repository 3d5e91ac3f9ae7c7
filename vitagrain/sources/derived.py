"""Profiles, postings and activity derived row by row from the stored tables.

The stored tables hold no profiles or postings, so these projections shape them
into such records: every input row yields exactly one record, no row is
dropped, and the whole stored text is carried along. The expressions are plain
SQL scalars, so a checking engine can evaluate the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitagrain.session import read_parts
from vitagrain.sources.tables import read_table

TITLES = [
    "Senior Backend Engineer", "Platform Engineer", "Data Analyst", "Engineering Manager",
    "Staff Software Engineer", "Cloud Architect", "Release Coordinator",
]
COMPANIES = [
    "Acorn Systems", "Birch Labs", "Cedar Works", "Dune Analytics", "Ember Cloud",
    "Fjord Software", "Grove Bank", "Harbor Freight", "iCedar Technologies",
]
SKILLS = [
    "Python", "Kafka", "PostgreSQL", "Docker", "React", "AWS", "Terraform", "GraphQL", "Scala",
    "MySQL", "Laravel",
]
TOOLS = ["MCP servers", "ChatGPT", "LangChain", "Jenkins", "Grafana"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
STACKS = [".NET", "python", "Node.js", "PHP / Laravel", "Java", "golang"]
HOSTS = ["Jobs.Example.com", "t.me", "www.t.me", "djinni.co", "sub.dou.ua", "LinkedIn.com",
         "lnkd.in", "not-t.me"]
MAX_JOBS = 4


def pick(values: list[str], index: str) -> str:
    """Index a short list with a non-negative integer expression."""
    return f"split_part('{';'.join(values)}', ';', CAST(({index}) % {len(values)} AS INT) + 1)"


# --- activity ------------------------------------------------------------------
_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"

RECORDS = f"""
SELECT event_id AS id,
       CONCAT('f', CAST(event_id % 997 AS STRING)) AS file_id,
       CAST({_K} AS BIGINT) AS template_id,
       CONCAT('Person ', CAST(user_id AS STRING)) AS candidate_name,
       {pick(STACKS, _K)} AS main_stack,
       {pick(COMPANIES, 'event_id')} AS company_name,
       CONCAT(CASE WHEN event_id % 3 = 0 THEN 'HTTPS://' ELSE 'https://' END,
              {pick(HOSTS, 'event_id')}, '/Job/',
              CAST(event_id % 701 AS STRING),
              CASE WHEN event_id % 2 = 0 THEN '/' ELSE '' END) AS job_link,
       event_type = 'error' AS is_fake,
       event_type = 'purchase' AS cv_saved,
       ts AS created_at,
       user_id,
       value
FROM events
"""

USERS = """
SELECT c_custkey AS id,
       CONCAT(' ', c_name, '@Example.com ') AS email,
       c_name AS name,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role,
       c_acctbal >= 0 AS is_active,
       c_nationkey % 4 <> 0 AS is_approved,
       CASE WHEN c_custkey % 5 = 0 THEN CONCAT('g', CAST(c_custkey AS STRING)) END AS external_id
FROM customer
"""

TEMPLATES = """
SELECT s_suppkey AS id,
       CONCAT('layout-', CAST(s_suppkey AS STRING)) AS slug,
       CAST(s_nationkey AS BIGINT) AS user_id,
       s_acctbal > 1000 AS is_active,
       s_acctbal > 5000 AS is_default
FROM supplier
"""

RELATIONS = {
    "records": ("events", RECORDS),
    "users": ("customer", USERS),
    "templates": ("supplier", TEMPLATES),
}


def relation(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived relation as a projection of its stored table."""
    table, text = RELATIONS[name]
    source = read_table(spark, folder, table)
    return spark.sql(text.replace(f"FROM {table}", "FROM {source}"), source=source)


# --- profiles ------------------------------------------------------------------
def job_count(k: str) -> str:
    return f"(1 + {k} % {MAX_JOBS})"


def job_title(k: str, j: int) -> str:
    return pick(TITLES, f"{k} + {3 * j}")


def job_company(k: str, j: int) -> str:
    return pick(COMPANIES, f"2 * {k} + {j}")


def job_start(k: str, j: int) -> tuple[str, str]:
    """Year and month (1-12) expressions."""
    return f"CAST({2008 + 4 * j} + {k} % 3 AS INT)", f"CAST(1 + ({k} + {j}) % 12 AS INT)"


def job_end(k: str, j: int) -> tuple[str, str]:
    return f"CAST({2010 + 4 * j} + {k} % 5 AS INT)", f"CAST(1 + ({k} + {5 * j}) % 12 AS INT)"


def job_dates(k: str, j: int) -> str:
    (sy, sm), (ey, em) = job_start(k, j), job_end(k, j)
    return (
        f"CONCAT({pick(MONTHS, f'{sm} - 1')}, ' ', CAST({sy} AS STRING), ' – ', "
        f"{pick(MONTHS, f'{em} - 1')}, ' ', CAST({ey} AS STRING))"
    )


def job_bullets(k: str, j: int) -> list[str]:
    """Three bullets: one measured, one unmeasured, one repeated on some rows."""
    first = (f"CONCAT('Built ', {pick(SKILLS, f'{k} + {j}')}, ' services for ', "
             f"CAST({k} % 50 + 2 AS STRING), ' teams')")
    second = (f"CONCAT('Introduced ', {pick(TOOLS, f'{k} + {2 * j}')}, ' with ', "
              f"{pick(SKILLS, f'{k} + {j + 4}')}, ' across the group')")
    third = (f"CASE WHEN {k} % 3 = 0 THEN CONCAT('built  ', {pick(SKILLS, f'{k} + {j}')}, "
             f"' Services for ', CAST({k} % 50 + 2 AS STRING), ' teams') "
             f"ELSE CONCAT('Owned ', {pick(SKILLS, f'{k} + {j + 7}')}, ' rollout') END")
    return [first, second, third]


def job_block(k: str, j: int) -> str:
    """One rendered job in one of three header layouts."""
    title, company, dates = job_title(k, j), job_company(k, j), job_dates(k, j)
    header = (
        f"CASE CAST({k} % 3 AS INT) "
        f"WHEN 0 THEN CONCAT({title}, ' | ', {company}, ' ', {dates}) "
        f"WHEN 1 THEN CONCAT({company}, ' | ', {dates}, chr(10), {title}) "
        f"ELSE CONCAT({title}, chr(10), {company}, chr(10), {dates}) END"
    )
    b = job_bullets(k, j)
    lines = ", ".join(f"chr(10), '- ', {x}" for x in b)
    return f"CASE WHEN {j} < {job_count(k)} THEN CONCAT({header}{', ' + lines}, chr(10)) ELSE '' END"


def profile_skills(k: str) -> list[str]:
    return [pick(SKILLS, f"{k} + {i}") for i in (0, 3, 5, 8)]


def profile_text(k: str, body: str) -> str:
    """Whole profile text; ``body`` is carried in full as the summary."""
    s = profile_skills(k)
    parts = [
        f"'Person Number', chr(10), 'p', CAST({k} AS STRING), '@example.com | Split, Croatia'",
        f"chr(10), chr(10), 'Summary', chr(10), {body}",
        f"chr(10), 'Technical Skills:', chr(10), 'Core: ', {s[0]}, ', ', {s[1]}, "
        f"chr(10), 'Also: ', {s[2]}, ' | ', {s[3]}",
        "chr(10), chr(10), 'Work Experience', chr(10), "
        + ", ".join(job_block(k, j) for j in range(MAX_JOBS)),
        f"'Education', chr(10), 'North University | 2001 - 2005', chr(10), "
        f"'Bachelor of Science', chr(10), 'Certifications', chr(10), "
        f"'- AWS Certified Developer ', CAST({k} % 7 AS STRING)",
    ]
    return f"CONCAT({', '.join(parts)})"


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text): one rendered profile per stored document."""
    docs = read_parts(read_table(spark, folder, "documents"), "doc_id")
    return docs.selectExpr("doc_id", f"{profile_text('doc_id', 'text')} AS text")


# --- postings ------------------------------------------------------------------
def posting_skills(k: str) -> list[str]:
    return [pick(SKILLS, f"3 * {k} + {i}") for i in (0, 1, 2, 6)]


def posting_text(k: str, body: str) -> str:
    """Whole posting text; ``body`` is carried in full under the duties."""
    s = posting_skills(k)
    return (
        f"CONCAT('Job Title: ', {pick(TITLES, k)}, chr(10), 'About us', chr(10), "
        f"'A ', CASE WHEN {k} % 2 = 0 THEN 'fintech' ELSE 'retail' END, ' group.', chr(10), "
        f"'Requirements:', chr(10), "
        f"'- ', CAST({k} % 6 + 2 AS STRING), '+ years of experience with ', {s[0]}, chr(10), "
        f"'- Strong ', {s[1]}, ' and google cloud', chr(10), "
        f"'- ', {s[2]}, ' is a plus', chr(10), "
        f"'What you''ll do', chr(10), {body}, chr(10), "
        f"'Nice to have', chr(10), '- ', {s[3]}, ' and agile/scrum', chr(10), "
        f"'- AWS Certified Developer preferred', chr(10), 'Benefits', chr(10), 'Gym and mentoring')"
    )


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, text): one rendered posting per stored benchmark item."""
    items = read_table(spark, folder, "benchmark")
    return items.selectExpr("item_id", f"{posting_text('item_id', 'text')} AS text")


# --- master and tailored records ------------------------------------------------
def tailored_fields(k: str, j: int) -> dict[str, str]:
    """Tailored job fields: some drift from the master on purpose."""
    title, company, dates = job_title(k, j), job_company(k, j), job_dates(k, j)
    return {
        "title": f"CASE WHEN {k} % 4 = 0 AND {j} = 0 THEN CONCAT({title}, ' II') ELSE {title} END",
        "company": f"CASE WHEN {k} % 5 = 0 AND {j} = 1 THEN 'Other Co' ELSE {company} END",
        "dates": f"CASE WHEN {k} % 7 = 0 AND {j} = 0 THEN '' ELSE {dates} END",
    }


#: The whole stored text as one bullet.
NOTED = "CONCAT('Noted: ', translate(coalesce(text, ''), concat(chr(10), '.#'), '   '))"


def tailored_bullets(k: str, j: int, noted: str = NOTED) -> list[str]:
    return job_bullets(k, j) + [
        "'Moved Laravel and PHP jobs to the cloud'",
        f"CONCAT('Wrote Django and Scala tools for ', CAST({k} % 9 AS STRING), ' users')",
        "'Kept Rails alive during the move'",
        noted,
    ]


def tailored_summary(k: str) -> str:
    return pick([
        "Engineer with 8+ years of delivery. Calm under load.",
        "Platform engineer. Likes tests",
        "Seasoned builder with care. Hands-on with a, b, c.",
        "Curious person. Writes well.",
        "Quiet builder",
    ], k)


def tailored_certification(k: str) -> str:
    return f"CASE WHEN {k} % 6 = 0 THEN '' ELSE CONCAT('AWS Certified Developer ', CAST({k} % 7 AS STRING)) END"


def tailored(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, master, tailored, ...): one master with its tailored form per document."""
    k = "doc_id"

    def jobs(fields, bullets) -> str:
        items = ", ".join(
            f"named_struct('n', {j}, " + ", ".join(f"'{f}', {v}" for f, v in fields(j).items())
            + f", 'bullets', array({', '.join(bullets(j))}))" for j in range(MAX_JOBS))
        return (f"transform(filter(array({items}), x -> x.n < {job_count(k)}), x -> named_struct("
                f"'title', x.title, 'company', x.company, 'dates', x.dates, 'bullets', x.bullets))")

    docs = read_parts(read_table(spark, folder, "documents"), "doc_id")
    # made once for all jobs (several uses keep it in a projection of its own); replaces what NOTED translates
    plain = "replace(replace(replace(coalesce(text, ''), chr(10), ' '), '.', ' '), '#', ' ')"
    docs = docs.selectExpr("doc_id", "text", f"CONCAT('Noted: ', {plain}) AS noted")
    master = jobs(lambda j: {"title": job_title(k, j), "company": job_company(k, j),
                             "dates": job_dates(k, j)}, lambda j: job_bullets(k, j))
    drifted = jobs(lambda j: tailored_fields(k, j), lambda j: tailored_bullets(k, j, "noted"))
    return docs.selectExpr(
        "doc_id", "text AS raw_text", f"{k} % 10 <> 9 AS is_structured", f"{master} AS master",
        f"{drifted} AS tailored", f"{pick(STACKS, k)} AS main_stack",
        f"{tailored_summary(k)} AS summary",
        f"array(CONCAT('AWS Certified Developer ', CAST({k} % 7 AS STRING))) AS master_certs",
        f"filter(array({tailored_certification(k)}), c -> c <> '') AS tailored_certs",
    )
