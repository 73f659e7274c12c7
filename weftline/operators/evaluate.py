"""Precision, recall and match evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def micro(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of predicted keys; both sides are sets."""
    t = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    rows = t.join(p, keys, "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    one = rows.agg(n(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), n(F.col("t").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.select("tp", "fp", "fn", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(ratio(2 * precision * recall, precision + recall), 6).alias("f1"))


def upper_median(rows: DataFrame, value: str) -> DataFrame:
    """The value at place n div 2 (from 0) of the sorted values, from counts of distinct values."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(value))).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    return upto.filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min(value).alias("median"))


def hits(matches: DataFrame, resumes: DataFrame) -> DataFrame:
    """Résumés, those with any match, their share, and the median and largest of their best scores."""
    best = matches.filter("place = 1").select("resume_id", "score")
    n = resumes.select("resume_id").distinct().agg(F.count(F.lit(1)).alias("sample"))
    top = best.agg(F.count(F.lit(1)).alias("match_hit"), F.max("score").alias("top1_max"))
    rows = n.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(upper_median(best, "score").withColumnRenamed("median", "top1_median")))  # one row each
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select("sample", "match_hit", F.round(ratio(F.col("match_hit"), F.col("sample")), 6).alias("hit_rate"), zero("top1_median"), zero("top1_max"))
