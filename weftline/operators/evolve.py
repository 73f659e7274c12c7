"""Snapshots of postings' skills and the differences between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import scalar as S


def payload(edges: DataFrame) -> DataFrame:
    """(job_id, payload): the posting's skills sorted by id, as JSON."""
    item = F.struct("skill_id", F.format_string("%.2f", "confidence").alias("confidence"), "status")
    return edges.groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"), F.count(F.lit(1)).alias("n"))


def difference(base: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and modified skills between two snapshots (job_id, skill_id, confidence, evidence)."""
    b = base.select("job_id", "skill_id", F.col("confidence").alias("cb"), F.coalesce("evidence", F.lit("")).alias("eb"), F.lit(True).alias("in_base"))
    n = new.select("job_id", "skill_id", F.col("confidence").alias("cn"), F.coalesce("evidence", F.lit("")).alias("en"), F.lit(True).alias("in_new"))
    rows = b.join(n, ["job_id", "skill_id"], "full_outer")
    kind = F.when(F.col("in_base").isNull(), "added").when(F.col("in_new").isNull(), "removed").when((F.abs(F.col("cb") - F.col("cn")) > 1e-6) | (F.col("eb") != F.col("en")), "modified")
    return rows.select("job_id", "skill_id", kind.alias("change"), "cb", "cn").filter("change IS NOT NULL")


def notes(changes: DataFrame) -> DataFrame:
    """One line of text for each posting that changed."""

    def items(k: str):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("change") == k, F.col("skill_id")))), lambda x: x.cast("string"))

    return changes.groupBy("job_id").agg(S.note(items("added"), items("removed"), items("modified")).alias("note"), F.count(F.lit(1)).alias("n"))


def replace_partition(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose keys ``new`` does not have, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def history(snapshots: DataFrame, job_id: int, limit: int) -> DataFrame:
    """The last snapshots of a posting: filtered first, then cut."""
    return snapshots.filter(F.col("job_id") == job_id).orderBy(F.desc("snapshot_id")).limit(limit)
