"""Batch rewrites of tables: erase, update, upsert, repair, evolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evolve(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Union old and new row shapes; columns absent on one side take a default."""
    return old.unionByName(new, allowMissingColumns=True).fillna(defaults)


def erase(table: DataFrame, keys: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Rows that survive the erasure of a key set."""
    return table.join(keys.select(F.col(key).alias(column)), column, "left_anti")


def erase_members(tables: dict[str, DataFrame], users: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Every table that names a member by user_id, and the members, without the erased ones."""
    return {n: erase(t, gone, "user_id") for n, t in tables.items()} | {"users": erase(users, gone, "id")}


def update_access(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply optional approve/active changes; approval implies active."""
    asked = changes.select("id", F.col("is_approved").alias("new_approved"),
                           F.col("is_active").alias("new_active"))
    implied = F.when(F.col("new_approved"), F.lit(True))
    return (
        users.join(asked, "id", "left")
        .withColumn("is_active", F.coalesce("new_active", implied, "is_active"))
        .withColumn("is_approved", F.coalesce("new_approved", "is_approved"))
        .drop("new_approved", "new_active")
    )


def upsert(current: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Take listed values, keep the rest inactive, add what is new."""
    values = [c for c in listing.columns if c != key]
    fresh = listing.select(key, *[F.col(c).alias(f"new_{c}") for c in values],
                           F.lit(True).alias("listed"))
    joined = current.join(fresh, key, "full_outer")
    out = joined.withColumn("is_active", F.coalesce("listed", F.lit(False)))
    for c in values:
        out = out.withColumn(c, F.coalesce(F.col(f"new_{c}"), F.col(c)))
    return out.drop("listed", *[f"new_{c}" for c in values])


def repair(table: DataFrame, column: str, desired: Column) -> DataFrame:
    """Recompute a derived column and mark the rows it changes."""
    return (
        table.withColumn("desired", desired)
        .withColumn("changed", ~F.col("desired").eqNullSafe(F.col(column)))
        .withColumn(column, F.col("desired"))
        .drop("desired")
    )


def assert_attributes(table: DataFrame, where: Column, **values) -> DataFrame:
    """Set attributes on the rows a predicate selects, marking them affected."""
    out = table.withColumn("affected", where)
    for column, value in values.items():
        out = out.withColumn(
            column, F.when(F.col("affected"), F.lit(value)).otherwise(F.col(column)))
    return out


def override(rows: DataFrame, fixes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Replace a value by (key, position); unmatched rows stay as they are."""
    new = fixes.select(*keys, F.col(column).alias("replacement"))
    return (
        rows.join(new, keys, "left")
        .withColumn(column, F.coalesce("replacement", column))
        .drop("replacement")
    )


def admin_guard(users: DataFrame) -> DataFrame:
    """Counts that guard deletion and blocking, as one row."""
    active_admin = (F.col("role") == "admin") & F.col("is_active")
    return users.agg(
        F.count("*").alias("n_users"),
        F.count_if(active_admin).alias("n_active_admins"),
    ).withColumn("only_one_left", F.col("n_active_admins") <= 1).withColumn(
        "next_is_first", F.col("n_users") == 0)
