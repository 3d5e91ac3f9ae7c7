"""Activity reports: history, link dedupe, filters, counts, paging.

Keys such as owner, file or link may be very hot, so "newest per key" is an
aggregate that combines before the shuffle, never a window over whole groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagrain.functions import dates as dt
from vitagrain.functions import text as tx

EXCLUDED_HOST = "t.me"


def scope_owner(df: DataFrame, user_id: int | None) -> DataFrame:
    """One owner's rows, or all rows when no owner is named."""
    return df if user_id is None else df.filter(F.col("user_id") == user_id)


def newest_per(df: DataFrame, *keys: str, by: str = "id") -> DataFrame:
    """The newest row of each key, null keys included; ``by`` is unique.

    Only the ids are grouped, by hash; the rows themselves meet their winners by id.
    """
    newest = df.groupBy(*keys).agg(F.max(by).alias(by)).select(by)
    return df.join(newest, by, "left_semi").select(*keys, *[c for c in df.columns if c not in keys])


def unique_links(records: DataFrame, users: DataFrame | None = None,
                 user_id: int | None = None, per_owner: bool = False,
                 drop_excluded: bool = False) -> DataFrame:
    """Unique links, newest row's attributes; flagged and blank rows never count."""
    live = scope_owner(records.filter(~F.col("is_fake")), user_id)
    if drop_excluded:
        live = live.filter(~F.expr(tx.on_domain(tx.host("job_link"), EXCLUDED_HOST)))
    keyed = (
        live.select("id", "user_id", F.trim("job_link").alias("job_link"), "main_stack",
                    "created_at", F.expr(tx.link_key("job_link")).alias("link_key"))
        .filter(F.col("link_key") != "")
    )
    newest = newest_per(keyed, *(["link_key", "user_id"] if per_owner else ["link_key"]))
    if users is None:
        return newest
    owner = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"),
                         F.col("email").alias("user_email"))
    return newest.join(owner, "user_id", "left").fillna("", ["user_name", "user_email"])


def history(records: DataFrame, templates: DataFrame, user_id: int | None = None,
            limit: int | None = None) -> DataFrame:
    """Records with their template slug, newest first."""
    newest = F.col("id").desc()
    rows = scope_owner(records, user_id)
    if limit is not None:  # the join keeps every record once, so cut first
        rows = rows.orderBy(newest).limit(limit)
    slugs = templates.select(F.col("id").alias("template_id"), F.col("slug"))
    return (
        rows.join(slugs, "template_id", "left")
        .withColumn("template_slug", F.coalesce("slug", F.lit("unknown")))
        .drop("slug")
        .orderBy(newest)
    )


def record_counts(users: DataFrame, records: DataFrame) -> DataFrame:
    """Every user with a record count, zero kept."""
    counts = records.groupBy("user_id").agg(F.count("*").alias("n_records"))
    return (
        users.join(counts.withColumnRenamed("user_id", "id"), "id", "left")
        .fillna(0, ["n_records"])
    )


def status_label() -> Column:
    """Blocked, then administrator, then waiting, then allowed."""
    return (
        F.when(~F.col("is_active"), "Blocked")
        .when(F.col("role") == "admin", "Administrator")
        .when(~F.col("is_approved"), "Waiting")
        .otherwise("Allowed")
    )


def eligible() -> Column:
    return ((F.col("role") == "admin") | F.col("is_approved")) & F.col("is_active")


def contains_all(df: DataFrame, **needles: str) -> DataFrame:
    """Case-insensitive contains on each column whose needle is not blank."""
    for column, needle in needles.items():
        if needle.strip():
            df = df.filter(F.lower(column).contains(needle.strip().lower()))
    return df


def day_between(df: DataFrame, column: str, first: str = "", last: str = "",
                blank_passes: bool = True) -> DataFrame:
    """Inclusive day range; rows without a day pass or fail by choice.

    The column itself is compared, so that file statistics and day folders prune.
    """
    for bound, test in ((first, F.col(column) >= F.lit(first).cast("date")),
                        (last, F.col(column) < F.date_add(F.lit(last).cast("date"), 1))):
        if bound:
            df = df.filter(test | F.col(column).isNull() if blank_passes else test)
    return df


def page_slice(df: DataFrame, order: list[Column], page: int, size: int,
               clamp: bool = False) -> DataFrame:
    """One page of an ordered report; ``clamp`` pulls the page back into range."""
    if clamp:
        page = max(1, min(page, -(-df.count() // size)))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def link_report(records: DataFrame, users: DataFrame | None = None, first: str = "", last: str = "",
                stack: str = "", page: int = 1, size: int = 20) -> DataFrame:
    """One page of the job-link report: unique links, filters on their newest rows, source rank."""
    rows = day_between(unique_links(records, users, drop_excluded=True), "created_at", first, last)
    rows = contains_all(rows, main_stack=stack).withColumn("source_rank", F.expr(tx.link_rank("job_link")))
    return page_slice(rows, [F.col("source_rank"), F.col("id").desc()], page, size)


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-blank values in order."""
    return (
        df.select(F.trim(column).alias(column)).filter(F.col(column) != "").distinct()
        .orderBy(column)
    )


def submissions(df: DataFrame) -> DataFrame:
    """Attach the first reason a submission is rejected, blank when valid."""
    def blank(column: str) -> Column:
        return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""

    return df.withColumn(
        "reason",
        F.when(blank("posting"), "empty posting").when(blank("main_stack"), "empty stack")
        .when(blank("company_name"), "empty company")
        .when(F.expr(tx.link_reason("job_link")) != "", F.expr(tx.link_reason("job_link")))
        .when(blank("template_slug"), "empty template").otherwise(""),
    )


def attach_payload(records: DataFrame, payloads: DataFrame, key: str = "file_id") -> DataFrame:
    """Attach each key's payload to the newest row of that key only.

    The newest ids are found by an aggregate on the key, then joined back by
    row id, so a hot key is never gathered.
    """
    newest = records.groupBy(key).agg(F.max("id").alias("id"))
    marked = newest.join(payloads, key).select("id", "payload")
    return (
        records.join(marked, "id", "left")
        .withColumn("cv_saved", F.col("payload").isNotNull() | F.col("cv_saved"))
    )


def identity_match(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Match by external id, else by e-mail; null marks a new account.

    Profiles without an external id would all meet in one task; each gets a key
    of its own that no account can carry.
    """
    own_key = F.concat(F.lit("\u0000"), F.xxhash64("email").cast("string"))
    keyed = profiles.withColumn("external_key", F.coalesce("external_id", own_key))
    by_external = users.filter(F.col("external_id").isNotNull()).select(
        F.col("external_id").alias("external_key"), F.col("id").alias("id_by_external"))
    by_email = users.select("email", F.col("id").alias("id_by_email"))
    return (
        keyed.join(by_external, "external_key", "left").join(by_email, "email", "left")
        .withColumn("user_id", F.coalesce("id_by_external", "id_by_email"))
        .drop("external_key", "id_by_external", "id_by_email")
    )


def local_day_counts(records: DataFrame, zone: str) -> DataFrame:
    """Flagged and live rows per owner and local calendar day."""
    day = F.to_date(F.expr(dt.local_time("created_at", zone)))
    return records.groupBy("user_id", day.alias("local_day")).agg(
        F.count_if("is_fake").alias("n_flagged"), F.count_if(~F.col("is_fake")).alias("n_live"))


def week_earlier(day_counts: DataFrame, column: str = "n_live") -> DataFrame:
    """Each owner-day beside the count seven days before."""
    earlier = day_counts.select(
        "user_id", F.date_add("local_day", 7).alias("local_day"),
        F.col(column).alias("n_week_earlier"))
    return day_counts.join(earlier, ["user_id", "local_day"], "left").fillna(
        0, ["n_week_earlier"])


def default_per_owner(rows: DataFrame, owner: str = "user_id", key: str = "id") -> DataFrame:
    """Exactly one default per owner: a wanted one, else the lowest slug; equal ones by key.

    The winners are found by an aggregate on the owner that combines ahead of its
    shuffle, and marked by row id, so that no owner's rows meet in one task.
    """
    first = F.struct((~F.col("is_default")).cast("int").alias("unwanted"), "slug", key)
    chosen = rows.groupBy(owner).agg(F.min_by(key, first).alias(key)).select(key, F.lit(True).alias("chosen"))
    return (
        rows.join(chosen, key, "left")
        .withColumn("is_default", F.coalesce("chosen", F.lit(False))).drop("chosen")
    )
