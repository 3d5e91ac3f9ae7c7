"""Activity, member, template, stage and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitagrain.catalog.base import Catalog
from vitagrain.functions import dates as dt
from vitagrain.functions import lexicon as lx
from vitagrain.functions import text as tx
from vitagrain.operators import activity as ac
from vitagrain.operators import maintain as mn
from vitagrain.operators import stages as sg
from vitagrain.sources import derived as dv
from vitagrain.sources.tables import owner_check, read_table, stage_map

catalog = Catalog()
query = catalog.query

CTE = {"records": f"records AS ({dv.RECORDS})", "users": f"users AS ({dv.USERS})",
       "templates": f"templates AS ({dv.TEMPLATES})"}
R, U, T = CTE["records"], CTE["users"], CTE["templates"]


def rel(name):
    return lambda spark, sf: dv.relation(spark, sf, name)


records, users, templates = rel("records"), rel("users"), rel("templates")

# Host, key and domain tests of the checking engine.
HOST = ("regexp_replace(lower(regexp_extract(CASE WHEN contains(trim({0}), '://') THEN trim({0}) "
        "ELSE 'https://' || trim({0}) END, '^[A-Za-z]+://([^/:?#]*)', 1)), '^www\\.', '')")
KEY = "lower(rtrim(trim({0}), '/'))"
LIVE = f"""{R}, live AS (SELECT *, {KEY.format('job_link')} AS link_key, {HOST.format('job_link')} AS host
FROM records WHERE NOT is_fake AND trim(job_link) <> '')"""
NOT_EXCLUDED = "NOT (host = 't.me' OR suffix(host, '.t.me'))"
RANK = ("CASE WHEN host = 'djinni.co' OR suffix(host, '.djinni.co') THEN 0 "
        "WHEN host = 'dou.ua' OR suffix(host, '.dou.ua') THEN 1 "
        "WHEN host = 'linkedin.com' OR suffix(host, '.linkedin.com') OR host = 'lnkd.in' THEN 2 ELSE 3 END")


# --- scans, lookups, exports -----------------------------------------------------
@query("scan_activity_s1", f"WITH {R} SELECT * EXCLUDE (value, created_at), strftime(created_at, '%Y-%m-%d %H:%M') AS created_at FROM records")
def scan_activity(spark, sf):
    return records(spark, sf).drop("value").withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm"))


@query("scan_corpus_s2", "SELECT doc_id, lang, length(text) AS n_read FROM documents")
def scan_corpus(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", "lang", F.length("text").alias("n_read"))


@query("nested_json_roundtrip_s3_s4_n7", f"""WITH {U}
SELECT id, trim(lower(email)) AS email, role, is_active FROM users""")
def nested_json(spark, sf):
    """Encode each member as a nested JSON document, then read it back."""
    doc = users(spark, sf).select(
        F.to_json(F.struct("id", F.struct(F.trim(F.lower("email")).alias("email"), "role")
                           .alias("contact"), F.array("is_active").alias("flags"))).alias("doc"))
    schema = "id BIGINT, contact STRUCT<email STRING, role STRING>, flags ARRAY<BOOLEAN>"
    return doc.select(F.from_json("doc", schema).alias("d")).select(
        "d.id", "d.contact.email", "d.contact.role", F.col("d.flags")[0].alias("is_active"))


@query("activity_days_s5", f"""WITH {R} SELECT strftime(created_at, '%Y-%m-%d') AS day,
count(*) AS n_rows, count(DISTINCT file_id) AS n_files FROM records GROUP BY 1""")
def activity_days(spark, sf):
    """Row and file counts per append partition."""
    return records(spark, sf).groupBy(F.to_date("created_at").cast("string").alias("day")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("file_id").alias("n_files"))


@query("attach_payload_s6_w2", f"""WITH {R}, newest AS (SELECT file_id, max(id) AS id FROM records GROUP BY 1)
SELECT r.id, r.file_id, CASE WHEN n.id IS NOT NULL AND p.html IS NOT NULL THEN md5(p.html) END AS payload_md5,
(n.id IS NOT NULL AND p.html IS NOT NULL) OR r.cv_saved AS cv_saved
FROM records r LEFT JOIN newest n ON n.id = r.id
LEFT JOIN pages p ON n.id IS NOT NULL AND 'f' || p.page_id = r.file_id""")
def attach_payload(spark, sf):
    payloads = read_table(spark, sf, "pages").select(
        F.concat(F.lit("f"), F.col("page_id").cast("string")).alias("file_id"),
        F.encode("html", "UTF-8").alias("payload"))
    return ac.attach_payload(records(spark, sf), payloads).select(
        "id", "file_id", F.md5("payload").alias("payload_md5"), "cv_saved")


@query("point_lookup_s7", f"WITH {R} SELECT id, file_id, user_id, job_link FROM records WHERE id = 42")
def point_lookup(spark, sf):
    return records(spark, sf).filter(F.col("id") == 42).select(
        "id", "file_id", "user_id", "job_link")


@query("listing_without_blob_s8", "SELECT page_id, url FROM pages")
def listing_without_blob(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", "url")


@query("link_export_s9", f"""WITH {LIVE}
SELECT strftime(max(created_at), '%Y-%m-%d %H:%M') AS created, arg_max(main_stack, id) AS main_stack,
arg_max(trim(job_link), id) AS job_link FROM live GROUP BY link_key""")
def link_export(spark, sf):
    """The three exported columns of the unique-link report."""
    return ac.unique_links(records(spark, sf)).select(
        F.expr(dt.minute_stamp("created_at")).alias("created"), "main_stack", "job_link")


@query("owner_check_s10", f"""WITH {R}, owners AS (SELECT 'f' || c_custkey AS file_id, CAST(c_nationkey AS BIGINT) AS owner_id FROM customer)
SELECT id, file_id, user_id, owner_id, coalesce(owner_id = user_id, false) AS allowed
FROM records LEFT JOIN owners USING (file_id)""")
def owner_decisions(spark, sf):
    owners = read_table(spark, sf, "customer").select(
        F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file_id"),
        F.col("c_nationkey").cast("bigint").alias("user_id"))
    return owner_check(records(spark, sf), owners).select(
        "id", "file_id", "user_id", "owner_id", "allowed")


@query("stage_map_roundtrip_s11", """SELECT event_id,
CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events""")
def stage_map_roundtrip(spark, sf):
    return read_table(spark, sf, "events").select(
        "event_id", stage_map(F.to_json(stage_map(F.col("props"))))["k"].alias("k"))


# --- predicates --------------------------------------------------------------------
@query("text_filters_p1", f"""WITH {R} SELECT id, candidate_name, company_name FROM records
WHERE contains(lower(candidate_name), 'person 1') AND contains(lower(company_name), 'bank')""")
def text_filters(spark, sf):
    return ac.contains_all(records(spark, sf), candidate_name=" Person 1 ", company_name="BANK",
                           main_stack=" ").select("id", "candidate_name", "company_name")


NULLED = "CASE WHEN event_type = 'view' THEN NULL ELSE ts END"


@query("day_range_p2", f"""SELECT event_id, true AS blank_passes FROM events
WHERE coalesce(CAST({NULLED} AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12', true)
UNION ALL SELECT event_id, false FROM events
WHERE coalesce(CAST({NULLED} AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12', false)""")
def day_range(spark, sf):
    """Both treatments of rows without a day."""
    rows = read_table(spark, sf, "events").selectExpr("event_id", f"{NULLED} AS ts")
    parts = [
        ac.day_between(rows, "ts", "2024-01-05", "2024-01-12", passes)
        .select("event_id", F.lit(passes).alias("blank_passes")) for passes in (True, False)
    ]
    return parts[0].unionByName(parts[1])


@query("stack_filter_p3", f"WITH {R} SELECT id, main_stack FROM records WHERE contains(lower(main_stack), 'lara')")
def stack_filter(spark, sf):
    return ac.contains_all(records(spark, sf), main_stack="LaRa").select("id", "main_stack")


@query("live_rows_p4_p5", f"WITH {R} SELECT id, user_id FROM records WHERE NOT is_fake AND user_id = 7")
def live_rows(spark, sf):
    return ac.scope_owner(records(spark, sf).filter(~F.col("is_fake")), 7).select("id", "user_id")


@query("excluded_hosts_p6_t9", f"""WITH {R} SELECT id, {HOST.format('job_link')} AS host,
{HOST.format('job_link')} = 't.me' OR suffix({HOST.format('job_link')}, '.t.me') AS excluded FROM records""")
def excluded_hosts(spark, sf):
    return records(spark, sf).select(
        "id", F.expr(tx.host("job_link")).alias("host"),
        F.expr(tx.on_domain(tx.host("job_link"), "t.me")).alias("excluded"))


@query("page_hosts_t9_t10", f"SELECT page_id, {HOST.format('url')} AS host, {KEY.format('url')} AS link_key FROM pages")
def page_hosts(spark, sf):
    return read_table(spark, sf, "pages").select(
        "page_id", F.expr(tx.host("url")).alias("host"), F.expr(tx.link_key("url")).alias("link_key"))


@query("active_owned_p7", f"""WITH {T}, {U} SELECT t.id, t.slug, t.user_id FROM templates t
WHERE t.is_active AND t.user_id IN (SELECT id FROM users WHERE is_approved)""")
def active_owned(spark, sf):
    owners = users(spark, sf).filter("is_approved").select(F.col("id").alias("user_id"))
    return templates(spark, sf).filter("is_active").join(owners, "user_id", "left_semi").select(
        "id", "slug", "user_id")


@query("status_p8_p9", f"""WITH {U} SELECT id, CASE WHEN NOT is_active THEN 'Blocked' WHEN role = 'admin' THEN 'Administrator'
WHEN NOT is_approved THEN 'Waiting' ELSE 'Allowed' END AS status,
(role = 'admin' OR is_approved) AND is_active AS eligible FROM users""")
def status(spark, sf):
    return users(spark, sf).select(
        "id", ac.status_label().alias("status"), ac.eligible().alias("eligible"))


SUBMISSION = """SELECT event_id AS id,
CASE WHEN event_id % 11 = 0 THEN '  ' ELSE event_type END AS posting,
CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS main_stack,
CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS company_name,
CASE WHEN event_id % 5 = 0 THEN 'ftp://x.example.com' WHEN event_id % 7 = 0 THEN ' '
     WHEN event_id % 19 = 0 THEN concat('https://x.example.com/', repeat('a', 2000))
     ELSE 'https://x.example.com' END AS job_link,
CASE WHEN event_id % 23 = 0 THEN '' ELSE 'classic' END AS template_slug FROM events"""


@query("submission_gate_p10", f"""WITH s AS ({SUBMISSION}) SELECT id, CASE
WHEN trim(coalesce(posting, '')) = '' THEN 'empty posting'
WHEN trim(coalesce(main_stack, '')) = '' THEN 'empty stack'
WHEN trim(coalesce(company_name, '')) = '' THEN 'empty company'
WHEN trim(job_link) = '' THEN 'empty link'
WHEN NOT (starts_with(trim(job_link), 'http://') OR starts_with(trim(job_link), 'https://')) THEN 'bad scheme'
WHEN length(trim(job_link)) > 2000 THEN 'too long'
WHEN trim(template_slug) = '' THEN 'empty template' ELSE '' END AS reason FROM s""")
def submission_gate(spark, sf):
    source = read_table(spark, sf, "events")
    rows = spark.sql(SUBMISSION.replace("FROM events", "FROM {events}"), events=source)
    return ac.submissions(rows).select("id", "reason")


FILE_NAME = dv.pick(["cv.pdf", "cv.DOCX", "cv.doc", "cv.txt", "noext"], "doc_id")


@query("upload_gate_p11", f"""SELECT doc_id, CASE
WHEN NOT lower(regexp_extract({FILE_NAME}, '\\.([^.]*)$', 1)) IN ('pdf', 'doc', 'docx') THEN 'unsupported type'
WHEN n_chars * 1000 > 10485760 THEN 'too large' WHEN n_chars = 0 THEN 'empty file' ELSE '' END AS reason FROM documents""")
def upload_gate(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", F.expr(tx.upload_reason(FILE_NAME, "n_chars * 1000")).alias("reason"))


@query("emails_p12", f"""WITH {U} SELECT id, lower(trim(email)) AS email,
contains(email, '@') AND contains(split_part(lower(trim(email)), '@', -1), '.') AND NOT contains(trim(email), ' ') AS valid FROM users""")
def emails(spark, sf):
    return users(spark, sf).withColumn("email", F.expr(tx.email("email"))).select(
        "id", "email", F.expr(tx.email_valid("email")).alias("valid"))


@query("report_defaults_p13", f"""WITH {R} SELECT id, coalesce(nullif(main_stack, 'Java'), '') AS main_stack,
coalesce(CASE WHEN is_fake THEN NULL ELSE job_link END, '') AS job_link,
strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM records""")
def report_defaults(spark, sf):
    return records(spark, sf).select(
        "id", F.expr("coalesce(nullif(main_stack, 'Java'), '')").alias("main_stack"),
        F.coalesce(F.when(~F.col("is_fake"), F.col("job_link")), F.lit("")).alias("job_link"),
        F.expr(dt.iso_z("created_at")).alias("created_at"))


# --- joins ---------------------------------------------------------------------------
@query("history_c7_j1_o1_p5", f"""WITH {R}, {T} SELECT r.id, r.user_id, r.main_stack, coalesce(t.slug, 'unknown') AS template_slug
FROM records r LEFT JOIN templates t ON t.id = r.template_id ORDER BY r.id DESC LIMIT 500""")
def history(spark, sf):
    return ac.history(records(spark, sf), templates(spark, sf), limit=500).select(
        "id", "user_id", "main_stack", "template_slug")


@query("unique_links_w1_j2_t10", f"""WITH {LIVE}, {U}, newest AS (
SELECT * FROM live WHERE {NOT_EXCLUDED}
QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY id DESC) = 1)
SELECT n.link_key, n.id, n.main_stack, n.user_id, coalesce(u.name, '') AS user_name, coalesce(u.email, '') AS user_email
FROM newest n LEFT JOIN users u ON u.id = n.user_id""")
def unique_links(spark, sf):
    return ac.unique_links(records(spark, sf), users(spark, sf), drop_excluded=True).select(
        "link_key", "id", "main_stack", "user_id", "user_name", "user_email")


@query("unique_links_per_owner_w1", f"""WITH {LIVE}
SELECT link_key, user_id, max(id) AS id FROM live GROUP BY 1, 2""")
def unique_links_per_owner(spark, sf):
    return ac.unique_links(records(spark, sf), per_owner=True).select("link_key", "user_id", "id")


@query("record_counts_j3_a5", f"""WITH {R}, {U} SELECT u.id, u.name, count(r.id) AS n_records
FROM users u LEFT JOIN records r ON r.user_id = u.id GROUP BY 1, 2""")
def record_counts(spark, sf):
    return ac.record_counts(users(spark, sf), records(spark, sf)).select("id", "name", "n_records")


@query("member_templates_j4_o4", f"""WITH {U}, {T} SELECT u.id AS user_id, t.slug, t.is_default
FROM users u LEFT JOIN templates t ON t.user_id = u.id""")
def member_templates(spark, sf):
    """One row per member and template; long form keeps hot owners splittable."""
    owned = templates(spark, sf).select("user_id", "slug", "is_default")
    return (users(spark, sf).select(F.col("id").alias("user_id")).join(owned, "user_id", "left")
            .orderBy("user_id", F.col("is_default").desc(), "slug"))


@query("member_detail_j5", f"""WITH {R}, {U} SELECT u.id AS user_id, u.name, r.id, r.company_name
FROM users u JOIN records r ON r.user_id = u.id""")
def member_detail(spark, sf):
    rows = records(spark, sf).select("user_id", "id", "company_name")
    return (users(spark, sf).select(F.col("id").alias("user_id"), "name").join(rows, "user_id")
            .orderBy("user_id", F.col("id").desc()))


FIX = "SELECT CAST(n_nationkey AS BIGINT) AS user_id, n_regionkey AS pos, n_name AS company_name FROM nation"


@query("overrides_j15_n5", f"""WITH {R}, fixes AS ({FIX}), r AS (SELECT id, user_id, CAST(id % 5 AS INT) AS pos, company_name FROM records)
SELECT r.id, r.user_id, r.pos, coalesce(f.company_name, r.company_name) AS company_name FROM r LEFT JOIN fixes f ON f.user_id = r.user_id AND f.pos = r.pos""")
def overrides(spark, sf):
    fixes = spark.read.parquet(f"{sf}/nation.parquet").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS user_id", "n_regionkey AS pos", "n_name AS company_name")
    rows = records(spark, sf).selectExpr("id", "user_id", "CAST(id % 5 AS INT) AS pos", "company_name")
    return mn.override(rows, fixes, ["user_id", "pos"], "company_name").select(
        "id", "user_id", "pos", "company_name")


PROFILE = """SELECT s_suppkey AS profile_id, CASE WHEN s_suppkey % 2 = 0 THEN CONCAT('g', CAST(s_suppkey AS STRING)) END AS external_id,
lower(CONCAT('customer#', lpad(CAST(s_suppkey * 20 AS STRING), 9, '0'), '@example.com')) AS email FROM supplier"""


@query("identity_match_j17", f"""WITH {U}, p AS ({PROFILE}), u AS (SELECT id, lower(trim(email)) AS email, external_id FROM users)
SELECT p.profile_id, coalesce(a.id, b.id) AS user_id FROM p
LEFT JOIN u a ON a.external_id = p.external_id LEFT JOIN u b ON b.email = p.email""")
def identity_match(spark, sf):
    source = read_table(spark, sf, "supplier")
    profiles = spark.sql(PROFILE.replace("FROM supplier", "FROM {s}"), s=source)
    accounts = users(spark, sf).withColumn("email", F.expr(tx.email("email")))
    return ac.identity_match(profiles, accounts).select("profile_id", "user_id")


# --- aggregates -------------------------------------------------------------------------
@query("facet_a6", "SELECT DISTINCT trim(p_type) AS p_type FROM part WHERE trim(p_type) <> '' ORDER BY 1")
def facet(spark, sf):
    return ac.facet(read_table(spark, sf, "part"), "p_type")


STAGES = list(lx.STAGE_TARGETS) + ["Warm Up"]
STAGE_ROWS = f"""SELECT CAST(user_id AS STRING) AS file_id, {dv.pick(STAGES, "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)")} AS stage,
CAST(value AS DECIMAL(12, 2)) AS seconds FROM events"""
STAGE_DIM = "dim(stage, stage_order, target) AS (VALUES " + ", ".join(
    f"('{s}', {i}, {t}::DOUBLE)" for i, (s, t) in enumerate(lx.STAGE_TARGETS.items(), 1)) + ")"


def stage_rows(spark, sf):
    source = read_table(spark, sf, "events")
    return spark.sql(STAGE_ROWS.replace("FROM events", "FROM {e}"), e=source)


@query("stage_report_a12_c8", f"""WITH rows AS ({STAGE_ROWS}), {STAGE_DIM},
known AS (SELECT file_id, stage, sum(seconds) AS seconds, stage_order FROM rows JOIN dim USING (stage) GROUP BY ALL)
SELECT file_id, stage, CAST(seconds AS DOUBLE) AS seconds, stage_order FROM known
UNION ALL SELECT file_id, 'TOTAL', CAST(sum(seconds) AS DOUBLE), 99 FROM known GROUP BY 1""")
def stage_report(spark, sf):
    return sg.stage_report(stage_rows(spark, sf)).withColumn(
        "seconds", F.col("seconds").cast("double"))


@query("slow_stages_a13", f"""WITH rows AS ({STAGE_ROWS}), {STAGE_DIM}
SELECT file_id, stage, CAST(sum(seconds) AS DOUBLE) AS seconds, target FROM rows JOIN dim USING (stage)
GROUP BY file_id, stage, target HAVING sum(seconds) > target""")
def slow_stages(spark, sf):
    totals = sg.stage_totals(stage_rows(spark, sf)).withColumn(
        "seconds", F.col("seconds").cast("double"))
    return sg.slow_stages(totals).select("file_id", "stage", "seconds", "target")


@query("stage_seed_a14", """SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, value AS extra FROM events""")
def stage_seed(spark, sf):
    first = stage_map(F.col("props"))
    earlier = F.create_map(F.lit("k"), F.lit(-1.0), F.lit("extra"), F.col("value"))
    return read_table(spark, sf, "events").select("event_id", sg.seed(first, earlier).alias("m")) \
        .select("event_id", F.col("m")["k"].alias("k"), F.col("m")["extra"].alias("extra"))


BERLIN = "timezone('Europe/Berlin', timezone('UTC', created_at))"
DAYS = f"""{R}, days AS (SELECT user_id, CAST({BERLIN} AS DATE) AS local_day, count(*) FILTER (is_fake) AS n_flagged,
count(*) FILTER (NOT is_fake) AS n_live FROM records GROUP BY 1, 2)"""


@query("local_day_counts_a15_d4", f"WITH {DAYS} SELECT * REPLACE (strftime(local_day, '%Y-%m-%d') AS local_day) FROM days")
def local_day_counts(spark, sf):
    return ac.local_day_counts(records(spark, sf), "Europe/Berlin").withColumn(
        "local_day", F.col("local_day").cast("string"))


@query("week_earlier_d6", f"""WITH {DAYS} SELECT d.* REPLACE (strftime(d.local_day, '%Y-%m-%d') AS local_day), coalesce(e.n_live, 0) AS n_week_earlier FROM days d
LEFT JOIN days e ON e.user_id = d.user_id AND e.local_day + 7 = d.local_day""")
def week_earlier(spark, sf):
    return ac.week_earlier(ac.local_day_counts(records(spark, sf), "Europe/Berlin")).withColumn(
        "local_day", F.col("local_day").cast("string"))


@query("day_tiers_d5", f"""WITH {R}, l AS (SELECT id, {BERLIN} AS t FROM records)
SELECT id, CASE WHEN isodow(t) >= 6 THEN NULL WHEN hour(t) < 13 THEN 20 WHEN hour(t) < 20 THEN 50 ELSE 80 END AS tier FROM l""")
def day_tiers(spark, sf):
    local = dt.local_time("created_at", "Europe/Berlin")
    return records(spark, sf).selectExpr("id", f"{local} AS t").select(
        "id", F.expr(dt.day_tier("t")).alias("tier"))


@query("time_stamps_d7", f"""WITH {R} SELECT id, strftime(created_at, '%Y-%m-%d') AS day,
strftime(created_at, '%Y-%m-%d %H:%M') AS minute, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM records""")
def time_stamps(spark, sf):
    return records(spark, sf).select(
        "id", F.expr(dt.day_stamp("created_at")).alias("day"),
        F.expr(dt.minute_stamp("created_at")).alias("minute"),
        F.expr(dt.iso_z("created_at")).alias("iso"))


@query("admin_guard_a17", f"""WITH {U} SELECT count(*) AS n_users, count(*) FILTER (role = 'admin' AND is_active) AS n_active_admins,
count(*) FILTER (role = 'admin' AND is_active) <= 1 AS only_one_left, count(*) = 0 AS next_is_first FROM users""")
def admin_guard(spark, sf):
    return mn.admin_guard(users(spark, sf))


@query("members_without_template_a18", f"""WITH {U}, {T} SELECT id, NOT EXISTS (
SELECT 1 FROM templates t WHERE t.user_id = users.id AND t.is_active) AS first_is_default FROM users""")
def members_without_template(spark, sf):
    owning = templates(spark, sf).filter("is_active").select(F.col("user_id").alias("id")) \
        .distinct().withColumn("has_any", F.lit(True))
    return users(spark, sf).select("id").join(owning, "id", "left").select(
        "id", F.col("has_any").isNull().alias("first_is_default"))


@query("report_counts_a20", f"""WITH {LIVE}, newest AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY id DESC) = 1)
SELECT count(*) AS n_links, count(*) FILTER (contains(lower(main_stack), 'java')) AS n_matching FROM newest""")
def report_counts(spark, sf):
    return ac.unique_links(records(spark, sf)).agg(
        F.count("*").alias("n_links"),
        F.count_if(F.lower("main_stack").contains("java")).alias("n_matching"))


@query("default_per_owner_w20", f"""WITH {T} SELECT id, user_id, slug, row_number() OVER (
PARTITION BY user_id ORDER BY is_default DESC, slug) = 1 AS is_default FROM templates WHERE is_active""")
def default_per_owner(spark, sf):
    return ac.default_per_owner(templates(spark, sf).filter("is_active")).select(
        "id", "user_id", "slug", "is_default")


# --- order and paging ------------------------------------------------------------------------
@query("newest_per_file_w2", f"""WITH {R} SELECT file_id, id, company_name FROM records
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY id DESC) = 1""")
def newest_per_file(spark, sf):
    return ac.newest_per(records(spark, sf).select("file_id", "id", "company_name"), "file_id")


@query("link_sources_o2", f"""WITH {LIVE}, newest AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY id DESC) = 1)
SELECT id, link_key, {RANK} AS source_rank FROM newest ORDER BY source_rank, id DESC""")
def link_sources(spark, sf):
    return ac.unique_links(records(spark, sf)).select(
        "id", "link_key", F.expr(tx.link_rank("job_link")).alias("source_rank")
    ).orderBy("source_rank", F.col("id").desc())


@query("activity_page_o3", f"WITH {R} SELECT id, company_name FROM records ORDER BY id DESC LIMIT 10 OFFSET 20")
def activity_page(spark, sf):
    return ac.page_slice(records(spark, sf).select("id", "company_name"),
                         [F.col("id").desc()], page=3, size=10, clamp=True)


@query("link_page_o3", f"""WITH {LIVE}, newest AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY id DESC) = 1)
SELECT id, link_key FROM newest ORDER BY {RANK}, id DESC LIMIT 20 OFFSET 20""")
def link_page(spark, sf):
    ranked = ac.unique_links(records(spark, sf)).withColumn(
        "source_rank", F.expr(tx.link_rank("job_link")))
    return ac.page_slice(ranked, [F.col("source_rank"), F.col("id").desc()], 2, 20) \
        .select("id", "link_key")


@query("link_report_c7", f"""WITH {LIVE}, newest AS (SELECT * FROM live WHERE {NOT_EXCLUDED}
QUALIFY row_number() OVER (PARTITION BY link_key ORDER BY id DESC) = 1)
SELECT id, link_key, CAST({RANK} AS INT) AS source_rank FROM newest
WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND contains(lower(main_stack), 'a')
ORDER BY source_rank, id DESC LIMIT 15 OFFSET 15""")
def link_report(spark, sf):
    return ac.link_report(records(spark, sf), first="2024-01-03", last="2024-01-20", stack=" A ", page=2, size=15) \
        .select("id", "link_key", "source_rank")


@query("users_by_id_o7", f"WITH {U} SELECT id, name FROM users ORDER BY id")
def users_by_id(spark, sf):
    return users(spark, sf).select("id", "name").orderBy("id")


# --- names --------------------------------------------------------------------------------------
CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[^A-Za-z0-9 _.-]', '', 'g'), '\\s+', ' ', 'g'), '_+', '_', 'g'), '_. ')"


@query("export_names_t11", f"""WITH {R} SELECT id, coalesce(nullif(concat_ws('_', nullif({CLEAN.format('candidate_name')}, ''),
nullif(lower({CLEAN.format('main_stack')}), ''), nullif(lower({CLEAN.format('company_name')}), '')), ''), 'Tailored_Resume') || '.zip' AS export_name,
{CLEAN.format('candidate_name')} AS stem FROM records""")
def export_names(spark, sf):
    base = tx.export_name("candidate_name", "main_stack", "company_name")
    return records(spark, sf).select(
        "id", F.expr(tx.with_extension(base, "' .zip '")).alias("export_name"),
        F.expr(tx.file_stem("candidate_name")).alias("stem"))


@query("name_keys_t40", f"""WITH {U} SELECT id, split_part(lower(name), ' ', 1) AS first_name, lower(name) AS name_key FROM users""")
def name_keys(spark, sf):
    return users(spark, sf).select(
        "id", F.expr(tx.first_name("concat(' ', name, ', Jr')")).alias("first_name"),
        F.expr(tx.name_key("concat('  ', name, ' ')")).alias("name_key"))


# --- maintenance -----------------------------------------------------------------------------------
@query("schema_evolution_m1_g7", """SELECT o_orderkey AS id, o_orderstatus AS status, false AS is_fake FROM orders
UNION ALL SELECT event_id, event_type, event_type = 'error' FROM events""")
def schema_evolution(spark, sf):
    old = read_table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status")
    new = read_table(spark, sf, "events").selectExpr(
        "event_id AS id", "event_type AS status", "event_type = 'error' AS is_fake")
    return mn.evolve(old, new, {"is_fake": False})


@query("cascade_erase_m2", f"""WITH {R}, {U}, gone AS (SELECT id FROM users WHERE NOT is_active)
SELECT r.id, r.user_id FROM records r WHERE r.user_id NOT IN (SELECT id FROM gone)""")
def cascade_erase(spark, sf):
    gone = users(spark, sf).filter(~F.col("is_active"))
    return mn.erase(records(spark, sf), gone, "user_id").select("id", "user_id")


@query("erase_members_m2", f"""WITH {R}, {U}, {T}, gone AS (SELECT id FROM users WHERE NOT is_active)
SELECT 'records' AS part, id FROM records WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'templates', id FROM templates WHERE user_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'users', id FROM users WHERE is_active""")
def erase_members(spark, sf):
    """Records, templates and the members themselves."""
    held = mn.erase_members({"records": records(spark, sf), "templates": templates(spark, sf)}, users(spark, sf),
                            users(spark, sf).filter(~F.col("is_active")))
    parts = [df.select(F.lit(name).alias("part"), "id") for name, df in held.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


CHANGES = """SELECT o_custkey AS id, CASE WHEN max(o_orderkey) % 2 = 0 THEN true WHEN max(o_orderkey) % 3 = 0 THEN false END AS is_approved,
CASE WHEN max(o_orderkey) % 5 = 0 THEN false END AS is_active FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey"""


@query("access_update_m3", f"""WITH {U}, c AS ({CHANGES}) SELECT u.id, coalesce(c.is_approved, u.is_approved) AS is_approved,
coalesce(c.is_active, CASE WHEN c.is_approved THEN true END, u.is_active) AS is_active FROM users u LEFT JOIN c USING (id)""")
def access_update(spark, sf):
    changes = spark.sql(CHANGES.replace("FROM orders", "FROM {o}"), o=read_table(spark, sf, "orders"))
    return mn.update_access(users(spark, sf), changes).select("id", "is_approved", "is_active")


@query("template_upsert_m4", f"""WITH {T}, listing AS (SELECT 'layout-' || n_nationkey AS slug, n_name AS title FROM nation)
SELECT coalesce(t.slug, l.slug) AS slug, t.id, l.title, l.slug IS NOT NULL AS is_active
FROM templates t FULL JOIN listing l ON l.slug = t.slug""")
def template_upsert(spark, sf):
    listing = spark.read.parquet(f"{sf}/nation.parquet").selectExpr(
        "concat('layout-', n_nationkey) AS slug", "n_name AS title")
    current = templates(spark, sf).select("slug", "id").withColumn("title", F.lit(None).cast("string"))
    return mn.upsert(current, listing, "slug").select("slug", "id", "title", "is_active")


@query("repair_pass_m5", """SELECT p_partkey AS id, upper(split_part(p_name, ' ', 1)) AS layout,
upper(split_part(p_name, ' ', 1)) <> upper(p_type) AS changed FROM part""")
def repair_pass(spark, sf):
    rows = read_table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name", "upper(p_type) AS layout")
    return mn.repair(rows, "layout", F.upper(F.split("p_name", " ")[0])).select("id", "layout", "changed")


@query("assert_admin_m6", f"""WITH {U} SELECT id, CASE WHEN suffix(lower(name), '7') THEN 'admin' ELSE role END AS role,
suffix(lower(name), '7') OR is_approved AS is_approved, suffix(lower(name), '7') AS affected FROM users""")
def assert_admin(spark, sf):
    hit = F.expr(tx.name_key("name")).endswith("7")
    return mn.assert_attributes(users(spark, sf), hit, role="admin", is_approved=True).select(
        "id", "role", "is_approved", "affected")
