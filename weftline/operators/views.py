"""Nodes, searches and filters of the graph's pages, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalar as S

ALL = "all"
# The order of the embodied domains, and of the kinds of skills.
DOMAINS = ("T1", "T2", "T3", "T4", "T5", "T6", "T7")
KINDS = ("hard", "soft", "domain", "tool")


def _ordered_terms(rows: DataFrame, n: int) -> DataFrame:
    """(job_id, skills): the terms of each posting's ``n`` most certain approved skills, in order."""
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("confidence"), "skill_id"))
    best = rows.withColumn("_at", rank).filter(F.col("_at") <= n)
    return best.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "term"))), lambda x: x["term"]).alias("skills"))


def posting_nodes(nodes: DataFrame, jobs: DataFrame, edges: DataFrame, skills: DataFrame) -> DataFrame:
    """Chosen postings (job_id, l1, level, category, demand) with name, description, company and their first eight skills.

    ``jobs`` has job_id, title, company, text.
    """
    own = edges.filter("status = 'approved'").join(nodes.select("job_id"), "job_id", "left_semi").join(skills.select("skill_id", "term"), "skill_id")
    some = jobs.join(nodes.select("job_id"), "job_id", "left_semi")
    named = some.select("job_id", F.trim(F.substring_index(F.coalesce(F.col("title").cast("string"), F.lit("")), "\n", 1)).alias("name"), F.coalesce(F.col("company").cast("string"), F.lit("")).alias("company"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("description"))
    none = F.array().cast("array<string>")
    return nodes.join(named, "job_id").join(_ordered_terms(own, 8), "job_id", "left").withColumn("skills", F.coalesce("skills", none))


def skill_nodes(nodes: DataFrame, edges: DataFrame, skills: DataFrame, limit: int = 120) -> DataFrame:
    """The skills that most of the chosen postings ask for: id, name, type, weight (40 to 100), category, postings."""
    own = edges.filter("status = 'approved'").join(nodes.select("job_id"), "job_id", "left_semi")
    counted = own.groupBy("skill_id").agg(F.countDistinct("job_id").alias("job_count"), F.sort_array(F.collect_set("job_id")).alias("jobs"))
    best = counted.join(skills.select("skill_id", "term", "l1"), "skill_id").orderBy(F.desc("job_count"), "skill_id").limit(limit)
    most = best.agg(F.max("job_count").alias("most"))  # one row
    weight = F.floor(40 + 60 * F.col("job_count") / F.col("most")).cast("int")
    return best.crossJoin(F.broadcast(most)).select(F.concat(F.lit("s"), F.col("skill_id").cast("string")).alias("id"), F.col("term").alias("name"), S.skill_type(F.col("term")).alias("type"), weight.alias("weight"), S.category(F.coalesce("l1", F.lit(""))).alias("category"), "job_count", "jobs")


def _any_contains(columns: list[str], text: str) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text))
    return found


def search(rows: DataFrame, columns: list[str], keyword: str, order: list, limit: int = 30) -> DataFrame:
    """The first rows that hold the keyword in one of the columns, in any case; all count for a blank one."""
    word = keyword.strip().lower()
    kept = rows.filter(_any_contains(columns, word)) if word else rows
    return kept.orderBy(*order).limit(limit)


def filtered_postings(nodes: DataFrame, category: str = ALL, level: str = ALL, query: str = "") -> DataFrame:
    """Posting nodes of a category and level whose name or a skill contains the query."""
    if category != ALL:
        nodes = nodes.filter(F.col("category") == category)
    if level != ALL:
        nodes = nodes.filter(F.col("level") == level)
    if query:
        nodes = nodes.filter(F.contains("name", F.lit(query)) | F.exists("skills", lambda s: F.contains(s, F.lit(query))))
    return nodes


def filtered_skills(nodes: DataFrame, postings: DataFrame, kind: str = ALL, query: str = "") -> DataFrame:
    """Skill nodes of a kind whose name contains the query and that some of ``postings`` ask for."""
    if kind != ALL:
        nodes = nodes.filter(F.col("type") == kind)
    if query:
        nodes = nodes.filter(F.contains("name", F.lit(query)))
    asked = nodes.select("id", F.explode("jobs").alias("job_id")).join(postings.select("job_id"), "job_id", "left_semi").select("id").distinct()
    return nodes.join(asked, "id", "left_semi")


def filtered_companies(companies: DataFrame, equal: dict[str, str], columns: list[str], query: str = "") -> DataFrame:
    """Companies that have the wanted values (``all`` wants nothing) and hold the query in one of the columns."""
    for c, v in equal.items():
        if v != ALL:
            companies = companies.filter(F.col(c) == v)
    if not query:
        return companies
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(query))
    return companies.filter(found)


def facet(rows: DataFrame, column: str) -> DataFrame:
    """Values by how many rows have them, most first."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def top_items(rows: DataFrame, column: str, n: int = 20) -> DataFrame:
    return facet(rows, column).limit(n)


def by_kind(skills: DataFrame) -> DataFrame:
    """Skills of each kind, every kind once, in the kinds' order."""
    kinds = skills.sparkSession.createDataFrame([(k, i) for i, k in enumerate(KINDS)], "type string, turn int")
    n = skills.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(kinds).join(n, "type", "left").select("type", "turn", F.coalesce("n", F.lit(0)).alias("n")).orderBy("turn")


def grouped_heat(heat: DataFrame, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """Heat rows under their domain, in the fixed order of domains; others and empty groups go."""
    order = heat.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(domains)], "l1 string, turn int")
    return heat.join(F.broadcast(order), "l1").groupBy("l1", "turn").agg(F.sort_array(F.collect_list("l2")).alias("categories"), F.sum("total").alias("total")).orderBy("turn")


def sharing_postings(companies: DataFrame, postings: DataFrame) -> DataFrame:
    """(company, job_id): postings that share a skill with a company; both have a row for each skill."""
    return companies.select("company", "skill_id").distinct().join(postings.select("job_id", "skill_id").distinct(), "skill_id").select("company", "job_id").distinct()


def discoveries(clusters: DataFrame) -> DataFrame:
    """Clusters (job_count, name_source, shared_skills, keywords) as found roles: signal, confidence, growth, bonus."""
    n = F.col("job_count")
    return clusters.withColumns(
        {
            "signal": F.when(n >= 5, "high").when(n >= 3, "medium").otherwise("low"),
            "confidence": F.when(F.col("name_source") == "llm", 78).otherwise(92),
            "growth": F.least(n * 15, F.lit(350)),
            "skills": F.slice("shared_skills", 1, 8),
            "bonus": F.slice(F.filter("keywords", lambda k: ~F.array_contains("shared_skills", k)), 1, 6),
        }
    )


def looked_up(terms: DataFrame, skills: DataFrame) -> DataFrame:
    """``terms`` (owner, term) with the skill whose normalised name equals the term's; null where there is none."""
    index = skills.select(S.normalize_text(F.col("term")).alias("norm"), "skill_id").filter("norm != ''").groupBy("norm").agg(F.max("skill_id").alias("skill_id"))
    return terms.withColumn("norm", S.normalize_text(F.col("term"))).join(index, "norm", "left").drop("norm")


def gold_in_text(texts: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, skill_id, in_text) of gold terms (doc_id, skill_id, term): whether the whole term, or two of its
    parts, stand in the text, bounded where they have an ASCII letter or digit."""
    edge = "[A-Za-z0-9_]"
    plain = texts.select("doc_id", S.normalize_text(F.col("text")).alias("norm_text"))
    bounded = lambda x: F.when(x.rlike("[A-Za-z0-9_]"), F.concat(F.lit(rf"(?<!{edge})\Q"), x, F.lit(rf"\E(?!{edge})"))).otherwise(F.concat(F.lit(r"\Q"), x, F.lit(r"\E")))
    stands = lambda x: (x != "") & F.regexp_like(F.col("norm_text"), bounded(x))
    atoms = F.array_distinct(F.filter(F.transform(F.split("term", r"[/,，;；+、\\|]"), lambda a: S.normalize_text(a)), lambda a: a != ""))
    rows = gold.select("doc_id", "skill_id", S.normalize_text(F.col("term")).alias("whole"), atoms.alias("atoms")).join(plain, "doc_id")
    return rows.select("doc_id", "skill_id", (stands(F.col("whole")) | (F.size(F.filter("atoms", stands)) >= 2)).alias("in_text"))
