"""The skill graph's relations, read from the star schema (the mapping of SURVEY 7.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalar as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill_id"), F.col("p_name").alias("term"), F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("company"),
        S.level(F.col("o_orderpriority")).alias("level"),
        F.col("o_totalprice").alias("salary_max"),
        F.to_date("o_orderdate").alias("collect_date"),
        F.col("o_orderpriority").alias("experience"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of a skill in a job with its confidence; the best of them is that of ``edges``."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"), S.rounded(0.95 - F.col("l_discount"), 2).alias("confidence"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each job and skill: the best confidence, the least status, any evidence."""
    li = read(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "N", "pending").otherwise("rejected")
    rows = li.select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"), F.round(0.95 - F.col("l_discount"), 2).alias("confidence"), state.alias("status"), (F.col("l_linestatus") == "F").alias("evidence"))
    return rows.groupBy("job_id", "skill_id").agg(F.max("confidence").alias("confidence"), F.min("status").alias("status"), F.max("evidence").alias("has_evidence"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resume_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("resume_id"))


def resume_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of a skill in a posting that a customer ordered; the best of them is that of ``resume_skills``."""
    return mentions(spark, sf_dir).join(_orders(spark, sf_dir).hint("shuffle_hash"), "job_id").select("resume_id", "skill_id", "confidence")


def resume_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of the postings that a customer ordered, with the best confidence."""
    rows = edges(spark, sf_dir).join(_orders(spark, sf_dir), "job_id").select("resume_id", "skill_id", "confidence")
    return rows.groupBy("resume_id", "skill_id").agg(F.max("confidence").alias("confidence"))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as clusters: the orders that they supplied."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), F.col("l_orderkey").alias("job_id")).distinct()


#: The same relations for the SQL that checks the queries.
SQL = r"""
skills AS (SELECT p_partkey AS skill_id, p_name AS term, p_type AS l1, p_brand AS l2 FROM part),
jobs AS (SELECT o_orderkey AS job_id, o_custkey AS company, o_totalprice AS salary_max, CAST(o_orderdate AS DATE) AS collect_date, o_orderpriority AS experience,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) < 3 THEN 'junior' WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) < 5 THEN 'mid' ELSE 'senior' END AS level FROM orders),
edges AS (SELECT l_orderkey AS job_id, l_partkey AS skill_id, max(round(0.95 - l_discount, 2)) AS confidence,
          min(CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'pending' ELSE 'rejected' END) AS status, bool_or(l_linestatus = 'F') AS has_evidence
          FROM lineitem GROUP BY 1, 2),
resumes AS (SELECT c_custkey AS resume_id, c_name AS name, c_mktsegment AS title FROM customer),
resume_skills AS (SELECT o_custkey AS resume_id, skill_id, max(confidence) AS confidence FROM edges JOIN orders ON o_orderkey = job_id GROUP BY 1, 2),
members AS (SELECT DISTINCT l_suppkey AS cluster_id, l_orderkey AS job_id FROM lineitem)
"""


def sql(body: str) -> str:
    """``body`` is either a SELECT, or further named relations that end with one."""
    text = body.strip()
    return f"WITH {SQL}" + (text if text.upper().startswith("SELECT") else f", {text}")
