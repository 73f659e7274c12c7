"""Questions about the bipartite graph of postings and skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalar as S

# Quotas of the embodied domains; their sum is 190.
QUOTAS = {"T1": 80, "T7": 40, "T3": 30, "T6": 15, "T4": 10, "T5": 8, "T2": 7}


def degree(edges: DataFrame, status: str = "approved") -> DataFrame:
    """Approved skills of each posting."""
    return edges.filter(F.col("status") == status).groupBy("job_id").agg(F.count(F.lit(1)).alias("degree"))


def skill_demand(edges: DataFrame, status: str = "approved") -> DataFrame:
    """Postings that ask for each skill, and a display weight of 40 to 100."""
    n = edges.filter(F.col("status") == status).groupBy("skill_id").agg(F.countDistinct("job_id").alias("jobs"))
    most = n.agg(F.max("jobs").alias("most"))  # one row
    return n.crossJoin(F.broadcast(most)).select("skill_id", "jobs", F.floor(40 + 60 * F.col("jobs") / F.col("most")).cast("long").alias("weight"))


def dominant_domain(edges: DataFrame, skills: DataFrame) -> DataFrame:
    """The domain with most edges of any status; of equals, the first by name."""
    n = edges.join(skills.select("skill_id", "l1"), "skill_id").filter(F.col("l1").isNotNull()).groupBy("job_id", "l1").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("job_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "l1")).alias("top")).select("job_id", F.col("top.l1").alias("l1"), (-F.col("top.less")).alias("n"))


def quota_table(quotas: dict[str, int], limit: int) -> dict[str, int]:
    """Each domain's places among ``limit`` (at least one), rounded half to even."""
    total = sum(quotas.values())
    return {k: max(1, round(v * limit / total)) for k, v in quotas.items()}


def stratified(nodes: DataFrame, quotas: dict[str, int], limit: int) -> DataFrame:
    """The best ``degree`` nodes of each domain up to its quota, at most ``limit`` in the quotas' order."""
    places = quota_table(quotas, limit)
    spark = nodes.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(places.items())], "l1 string, places int, turn int"))
    rank = F.row_number().over(Window.partitionBy("l1").orderBy(F.desc("degree"), "job_id"))
    chosen = nodes.join(table, "l1").withColumn("place", rank.cast("long")).filter("place <= places")
    return chosen.orderBy("turn", "place").limit(limit)


def job_nodes(jobs: DataFrame, edges: DataFrame, skills: DataFrame, quotas: dict[str, int], limit: int) -> DataFrame:
    """Posting nodes of the default view."""
    most = jobs.agg(F.max("salary_max").alias("most"))  # one row
    base = jobs.join(degree(edges), "job_id").join(dominant_domain(edges, skills).select("job_id", "l1"), "job_id")
    return stratified(base, quotas, limit).crossJoin(F.broadcast(most)).select("job_id", "l1", "degree", "level", S.category(F.col("l1")).alias("category"), S.demand(F.col("salary_max"), F.col("most")).alias("demand"), "place")


def top_skills(edges: DataFrame, n: int = 8) -> DataFrame:
    """Approved skills of each posting by confidence, as one text."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("confidence"), "skill_id"))
    best = edges.filter("status = 'approved'").withColumn("place", rank).filter(F.col("place") <= n)
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("skill_id").cast("string").alias("id"))))
    return best.groupBy("job_id").agg(F.array_join(F.transform(listed, lambda x: x["id"]), ",").alias("skills"), F.count(F.lit(1)).alias("n"))


def selected_edges(edges: DataFrame, nodes: DataFrame, top: int = 120) -> DataFrame:
    """Approved edges between chosen postings and the skills that most of them ask for."""
    own = edges.filter("status = 'approved'").join(nodes.select("job_id"), "job_id", "left_semi")
    best = own.groupBy("skill_id").agg(F.countDistinct("job_id").alias("jobs")).orderBy(F.desc("jobs"), "skill_id").limit(top)
    return own.join(best.select("skill_id"), "skill_id", "left_semi").select("job_id", "skill_id", "confidence")


def heatmap(jobs: DataFrame, edges: DataFrame, skills: DataFrame, today: Column, days: int, domains: str) -> DataFrame:
    """Postings of the last ``days`` by category of their approved skills and level, for domains like a pattern (any case)."""
    recent = jobs.filter((F.col("collect_date") >= F.date_sub(today, days)) | F.col("collect_date").isNull())
    own = skills.filter(F.col("l1").ilike(domains)).select("skill_id", "l1", "l2")
    pairs = edges.filter("status = 'approved'").join(own, "skill_id").join(recent.select("job_id", "level"), "job_id").select("l1", "l2", "job_id", "level").distinct()
    return pairs.groupBy("l1", "l2").agg(*(F.sum((F.col("level") == v).cast("long")).alias(v) for v in ("junior", "mid", "senior")), F.count(F.lit(1)).alias("total"))


def scaled(table: DataFrame) -> DataFrame:
    """Heat of each cell against the largest cell."""
    cells = table.select("l1", "l2", F.explode(F.create_map(*[x for v in ("junior", "mid", "senior") for x in (F.lit(v), F.col(v))])).alias("level", "n"))
    most = cells.agg(F.max("n").alias("most"))  # one row
    return cells.crossJoin(F.broadcast(most)).select("l1", "l2", "level", "n", F.round(S.heat(F.col("n"), F.col("most")), 6).alias("heat"))


def anchors(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Each skill at the mean of its postings' places (job_id, x, y)."""
    return edges.join(points, "job_id").groupBy("skill_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def sharing_pairs(rows: DataFrame, owner: str, item: str, least: int = 2, most_frequent: int | None = None) -> DataFrame:
    """Pairs of owners with at least ``least`` items in common.

    An item of k owners gives k (k - 1) / 2 pairs; ``most_frequent`` leaves out items of more
    owners, as a stop list would.
    """
    own = rows.select(owner, item).distinct()
    if most_frequent is not None:
        own = own.join(own.groupBy(item).count().filter(F.col("count") <= most_frequent).select(item), item)
    a, b = own.select(F.col(owner).alias("a"), item), own.select(F.col(owner).alias("b"), item)
    return a.join(b, item).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)


def facets(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
