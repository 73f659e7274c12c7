"""Governance: status summary, queue, decisions and their log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(edges: DataFrame) -> DataFrame:
    """Edges by status, and the share with evidence."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    one = edges.agg(F.count(F.lit(1)).alias("total"), *(F.coalesce(n(s), F.lit(0)).alias(s) for s in ("pending", "approved", "rejected")), F.sum(F.col("has_evidence").cast("long")).alias("e"))
    return one.select("total", "pending", "approved", "rejected", F.round(F.when(F.col("total") > 0, F.col("e") / F.col("total")).otherwise(0.0), 4).alias("evidence_coverage"))


def queue(edges: DataFrame, jobs: DataFrame, skills: DataFrame, limit: int) -> DataFrame:
    """Pending edges, the most certain first; at most 200."""
    rows = edges.filter("status = 'pending'").join(skills.select("skill_id", "term"), "skill_id").join(jobs.select("job_id", "company"), "job_id")
    return rows.orderBy(F.desc("confidence"), "job_id", "skill_id").limit(min(limit, 200)).select(F.concat_ws("|", "job_id", "skill_id").alias("target_id"), "company", "term", "confidence")


def decide(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Edges after decisions (target_id, turn, action): the last one counts, whatever came before."""
    last = decisions.groupBy("target_id").agg(F.max_by("action", "turn").alias("action"))
    keyed = edges.withColumn("target_id", F.concat_ws("|", "job_id", "skill_id")).join(last, "target_id", "left")
    new = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    return keyed.select("job_id", "skill_id", "confidence", "status", new.alias("new_status"))


def unknown(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions about edges that do not exist."""
    return decisions.join(edges.select(F.concat_ws("|", "job_id", "skill_id").alias("target_id")), "target_id", "left_anti")


def log(decisions: DataFrame, limit: int) -> DataFrame:
    return decisions.orderBy(F.desc("turn"), F.desc("target_id")).limit(min(limit, 500))


def waiting(rows: DataFrame, ident: str, order: list, limit: int) -> DataFrame:
    """Pending rows of a queue of clusters or definitions, in its order."""
    return rows.filter("status = 'pending'").orderBy(*order).limit(limit).withColumnRenamed(ident, "target_id")


def pending(queues: dict[str, DataFrame], decisions: DataFrame) -> DataFrame:
    """How many rows wait in each queue, and how many decisions there are: one row."""
    out = decisions.agg(F.count(F.lit(1)).alias("decided"))
    for name, rows in queues.items():
        out = out.crossJoin(rows.agg(F.coalesce(F.sum((F.col("status") == "pending").cast("long")), F.lit(0)).alias(name)))  # single rows
    return out
