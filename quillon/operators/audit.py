"""Audit relations: tasks, assignments and audits, in joins and conditional sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dashboard(tasks: DataFrame, assignments: DataFrame, audits: DataFrame, email: str, split: str | None = None, status: str | None = None) -> DataFrame:
    """An auditor's tasks with their audits, if any, by assignment order."""
    rows = assignments.filter(F.col("email") == email).join(tasks, "task_id").join(audits, ["email", "task_id"], "left")
    if split is not None:
        rows = rows.filter(F.col("split") == split)
    if status == "pending":
        rows = rows.filter(F.col("assessment").isNull())
    elif status == "completed":
        rows = rows.filter(F.col("assessment").isNotNull())
    return rows.orderBy("assignment_order")


def is_assigned(assignments: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted ``(email, task_id)`` pairs that are assigned."""
    return wanted.join(assignments, ["email", "task_id"], "left_semi")


def auditor_stats(tasks: DataFrame, assignments: DataFrame, audits: DataFrame) -> DataFrame:
    rows = assignments.join(tasks, "task_id").join(audits, ["email", "task_id"], "left")
    return rows.groupBy("email", "split").agg(F.count("*").alias("assigned"), F.count("assessment").alias("completed"))


def densify(stats: DataFrame, auditors: DataFrame, splits: list[str]) -> DataFrame:
    """Every auditor of the whitelist in every split, zeros where there is nothing."""
    every = auditors.select("email").withColumn("split", F.explode(F.array(*[F.lit(s) for s in splits])))
    return every.join(stats, ["email", "split"], "left").fillna(0, ["assigned", "completed"])


def progress(stats: DataFrame) -> DataFrame:
    out = stats.groupBy("split").agg(F.sum("assigned").alias("assigned"), F.sum("completed").alias("completed"))
    return out.withColumn("remaining", F.col("assigned") - F.col("completed"))


def pivot_totals(stats: DataFrame, splits: list[str]) -> DataFrame:
    """Completed per auditor by split, and in total."""
    out = stats.groupBy("email").pivot("split", splits).sum("completed").fillna(0)
    return out.withColumn("total", sum((F.col(f"`{s}`") for s in splits), F.lit(0)))


def task_stats(tasks: DataFrame, assignments: DataFrame, audits: DataFrame) -> DataFrame:
    """Counts of assignments, audits and answers by task, with null-safe rates."""
    rows = tasks.join(assignments, "task_id").join(audits, ["email", "task_id"], "left")
    is_ = lambda v: F.count_if(F.col("assessment") == v)
    out = rows.groupBy("task_id").agg(
        F.count("email").alias("assigned"), F.count("assessment").alias("completed"),
        is_("yes").alias("yes"), is_("almost").alias("almost"), is_("no").alias("no"),
        F.count_if(F.col("reasonable") == 1).alias("reasonable"), F.count_if(F.col("reasonable") == 0).alias("unreasonable"),
    )
    return out.withColumn("yes_rate", F.try_divide("yes", "completed")).withColumn("match_rate", F.try_divide(F.col("reasonable"), F.col("reasonable") + F.col("unreasonable")))


def matches_query(query: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns; an empty query matches all."""
    query = query.strip().lower()
    if not query:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(query)), F.lit(False))
    return hit


def audit_error(split: Column, assessment: Column, reasonable: Column, description: Column) -> Column:
    """The first rule an answer breaks, null if none."""
    n = F.length(F.trim(F.coalesce(description, F.lit(""))))
    return (
        F.when(~F.coalesce(assessment.isin("yes", "almost", "no"), F.lit(False)), "assessment")
        .when((split == "domain") & reasonable.isNull(), "reasonable missing")
        .when((split != "domain") & reasonable.isNotNull(), "reasonable not asked")
        .when((n < 5) & ((assessment != "yes") | F.coalesce(reasonable == 0, F.lit(False))), "description too short")
        .when(n > 4000, "description too long")
    )


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write per key: an upsert over append-only rows."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, *[c for c in others if c != order])).alias("_x")).select(*keys, "_x.*")


def eligible(members: DataFrame, required: list[str]) -> DataFrame:
    """Directories (with a row per member) that hold all required members."""
    sets = members.groupBy("dir").agg(F.collect_set(F.when(F.col("member").isin(required), F.col("member"))).alias("m"))
    return sets.filter(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "m")) == 0).select("dir")


def assign(pool: DataFrame, omitted: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The pool without what is omitted, in the order of a seeded hash."""
    return pool.join(omitted, key, "left_anti").orderBy(F.xxhash64(F.lit(seed), key), key)
