"""Emerging roles: entity linking, maturity, coverage gaps and candidate scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalar as S
from weftline.operators.cluster import checkpointed
from weftline.operators.match import title_ratio

DECAY, SATURATION, MOST = 0.11, 0.12, 0.98


def maturity(events: DataFrame, today: Column, weights: Mapping[str, float] = S.EVENT_WEIGHTS, missing: str = "其他") -> DataFrame:
    """Maturity of each technology from dated events (technology, date, type, relevance), future ones left out."""
    years = F.datediff(today, F.col("date")) / 365.25
    past = events.filter(F.col("date") <= today)
    part = S.lookup(F.col("type"), weights, 0.40, missing) * F.col("relevance") * F.exp(-DECAY * years)
    total = past.groupBy("technology").agg(F.sum(part).alias("s"), F.count(F.lit(1)).alias("n_events"))
    return total.select("technology", "n_events", F.round(F.least(F.lit(MOST), 1 - F.exp(-SATURATION * F.col("s"))), 4).alias("maturity"))


def contributions(events: DataFrame, today: Column, n: int = 12, weights: Mapping[str, float] = S.EVENT_WEIGHTS) -> DataFrame:
    """The ``n`` events that add most to each technology's maturity."""
    years = F.datediff(today, F.col("date")) / 365.25
    part = F.round(S.lookup(F.col("type"), weights, 0.40, "其他") * F.col("relevance") * F.exp(-DECAY * years), 4)
    rank = F.row_number().over(Window.partitionBy("technology").orderBy(F.desc("part"), "event_id"))
    return events.filter(F.col("date") <= today).select("technology", "event_id", part.alias("part")).withColumn("place", rank.cast("long")).filter(F.col("place") <= n)


#: Terms that are sent to every task; more are met through their first two characters.
BROADCAST_TERMS = 10_000
#: Recalled rows that are sent to every task, so that texts stay where they are; more are met by a shuffle.
BROADCAST_RECALLED = 100_000
# Grades of a candidate by overlap, and horizons by maturity.
EXISTING, EVOLVING, EMERGING = "已有岗位", "岗位演化", "新兴岗位"
NEAR, FAR = "1-3年", "3-5年"
# Skills of a root technology and of a task group, and their defaults.
ROOT_SKILLS = {"T1.02": ("世界模型", "多模态学习", "环境动力学", "机器人规划"), "T1.01": ("VLA", "多模态学习", "模仿学习", "机器人控制"), "T4.04": ("Sim-to-Real", "域随机化", "机器人仿真", "策略迁移")}
ANY_SKILLS = ("具身智能", "数据分析", "系统工程")
GROUP_SKILL = {"data": "数据工程", "model": "模型训练", "evaluation": "评测体系设计", "planning": "运动规划", "deployment": "推理部署"}
ANY_GROUP_SKILL = "技术研发"


def contained(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of ``texts`` (with ``x``) and ``terms`` (with ``term``) where x contains the term; empty terms match nothing.

    A list of terms that is short by count is broadcast.  A longer one is joined by equality on the
    terms' first two characters (the first, for terms of one), so no text is held against every term.
    """
    terms = terms.filter("term != ''")
    holds = F.expr("contains(x, term)")
    if terms.count() <= BROADCAST_TERMS:
        return texts.join(F.broadcast(terms), holds)
    led = terms.withColumn("_gram", F.substring("term", 1, 2))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("x")))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(F.substring(F.col("x"), i, F.lit(2)), F.substring(F.col("x"), i, F.lit(1))))))
    return texts.withColumn("_gram", F.explode(grams)).join(led, "_gram").filter(holds).drop("_gram")


def terms_of(technologies: DataFrame, aliases: int, split: bool = False) -> DataFrame:
    """(technology, term): normalised names and the first ``aliases`` aliases, and the name's parts if ``split``."""
    listed = F.concat(F.array("name"), F.slice(F.coalesce("aliases", F.array().cast("array<string>")), 1, aliases))
    if split:
        listed = F.concat(listed, F.split("name", "与|及|和|、|/"))
    return technologies.select("technology", F.explode(listed).alias("term")).select("technology", S.squeeze(F.col("term")).alias("term")).distinct()


def linked(milestones: DataFrame, technologies: DataFrame) -> DataFrame:
    """(event_id, technology, relevance) to three digits: the largest weight of a linked code of which
    one begins with the other (a third-level technology counts as its parent's code), or 0.72 where the
    event's text names the technology.

    ``milestones``: event_id, links (code, weight), text.  ``technologies``: technology, level, name, aliases.
    Codes meet by equality: each side's code with all prefixes of the other's.
    """
    prefixes = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.substring(c, F.lit(1), i))
    code = F.when(F.col("level") == "L3", S.root_code(F.col("technology"))).otherwise(F.col("technology"))
    codes = technologies.select("technology", code.alias("own"))
    links = milestones.select("event_id", F.explode("links").alias("link")).select("event_id", F.col("link.code").alias("code"), F.col("link.weight").cast("double").alias("weight"))
    up = links.join(codes.select("technology", F.explode(prefixes(F.col("own"))).alias("code")), "code")
    down = links.withColumn("own", F.explode(prefixes(F.col("code")))).join(codes, "own")
    bridges = up.select("event_id", "technology", "weight").unionByName(down.select("event_id", "technology", "weight"))
    told = contained(milestones.select("event_id", S.squeeze(F.col("text")).alias("x")), terms_of(technologies, 12)).select("event_id", "technology", F.lit(0.72).alias("weight"))
    both = bridges.unionByName(told).groupBy("event_id", "technology").agg(F.round(F.max("weight"), 3).alias("relevance"))
    return both.filter("relevance > 0")


def milestones_of(links: DataFrame, milestones: DataFrame, n: int) -> DataFrame:
    """The last ``n`` milestones of each technology, by date and then relevance."""
    rank = F.row_number().over(Window.partitionBy("technology").orderBy(F.desc(F.coalesce("date", F.lit("0001-01-01").cast("date"))), F.desc("relevance"), "event_id"))
    return links.join(milestones.select("event_id", "date"), "event_id").withColumn("place", rank.cast("long")).filter(F.col("place") <= n)


def recalled(texts: DataFrame, technologies: DataFrame, most: int = 600) -> DataFrame:
    """(technology, doc_id, n_terms, matched, confidence, place): postings that name a technology by a term
    of two or more characters, the best ``most`` of each by confidence, then id."""
    terms = terms_of(technologies, 20, split=True).filter(F.length("term") >= 2)
    hits = contained(texts.select("doc_id", S.squeeze(F.col("text")).alias("x")), terms).groupBy("doc_id", "technology").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    confidence = F.round(F.least(F.lit(1.0), 0.5 + 0.12 * F.size("terms")), 3)
    rows = hits.select("technology", "doc_id", F.size("terms").alias("n_terms"), F.array_join(F.slice("terms", 1, 5), ",").alias("matched"), confidence.alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("technology").orderBy(F.desc("confidence"), "doc_id"))
    return rows.withColumn("place", rank.cast("long")).filter(F.col("place") <= most)


def covering(related: DataFrame, texts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Recalled postings (at 0.45 or more) that name keywords of a task of their technology: technology, task,
    doc_id, company, title, place, evidence.  ``tasks``: technology, task, keywords."""
    own = related.filter("confidence >= 0.45").join(texts.select("doc_id", F.coalesce(F.col("company").cast("string"), F.lit("")).alias("company"), "title", F.lower(F.coalesce("text", F.lit(""))).alias("low")), "doc_id")
    found = F.size(F.filter("keywords", lambda k: F.contains(F.col("low"), F.lower(k))))
    rows = own.join(tasks.select("technology", "task", "keywords"), "technology").withColumn("found", found).filter("found > 0")
    evidence = F.round(F.least(F.lit(0.98), 0.55 + 0.08 * F.col("found") + 0.2 * F.col("confidence")), 3)
    return rows.select("technology", "task", "doc_id", "company", "title", "place", evidence.alias("evidence"))


def covered(hits: DataFrame) -> DataFrame:
    """Postings (m) and companies (c) of each task, and its first four postings."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("turn") <= 4, F.struct("turn", "doc_id", "evidence")))), 1, 4)
    turn = F.row_number().over(Window.partitionBy("technology", "task").orderBy("place"))
    return hits.withColumn("turn", turn).groupBy("technology", "task").agg(F.count(F.lit(1)).alias("m"), F.countDistinct("company").alias("c"), F.transform(first, lambda x: x["doc_id"]).alias("jobs"))


def gap(m: Column, c: Column, milestones: Column, relevance: Column, factor: Column) -> dict[str, Column]:
    """coverage, cross, evidence and gap of a task from its postings, companies and the technology's milestones."""
    coverage = F.least(F.lit(0.88), (1 - F.exp(-m / 8)) * 0.86)
    cross = F.least(F.lit(1.0), c / 7)
    evidence = F.least(F.lit(1.0), 0.52 + F.least(F.lit(0.24), milestones / 120) + F.least(F.lit(0.2), m / 35))
    return {"coverage": coverage, "cross": cross, "evidence": evidence, "gap": relevance * factor * (1 - coverage) * evidence * (0.58 + 0.42 * cross)}


def grade(maturity_: Column, ablation: str | None = None) -> Column:
    """The factor that maturity has in gap and score."""
    return F.lit(1.0) if ablation == "no_maturity" else F.greatest(F.lit(0.35), maturity_)


def cohesion(n: Column) -> Column:
    return F.least(F.lit(0.96), 0.70 + 0.08 * n)


def candidate_score(relevance: Column, gap_: Column, cohesion_: Column, cross: Column, factor: Column, evidence: Column, overlap: Column) -> Column:
    """0 to 100 from seven factors."""
    return 100 * (0.20 * relevance + 0.25 * gap_ + 0.15 * cohesion_ + 0.10 * cross + 0.10 * factor + 0.10 * evidence + 0.10 * (1 - overlap))


def job_kind(overlap: Column) -> Column:
    return F.when(overlap >= 0.76, EXISTING).when(overlap >= 0.56, EVOLVING).otherwise(EMERGING)


def horizon(maturity_: Column) -> Column:
    return F.when(maturity_ >= 0.55, NEAR).otherwise(FAR)


def skills_for(root: Column, group: Column) -> Column:
    """Required skills of a candidate: those of its root technology, and its group's."""
    listed = lambda names: F.array(*(F.lit(n) for n in names))
    common = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in ROOT_SKILLS.items() for x in (F.lit(k), listed(v))]), root), listed(ANY_SKILLS))
    own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUP_SKILL.items() for x in kv]), group), F.lit(ANY_GROUP_SKILL))
    return F.concat(common, F.array(own))


def search(technologies: DataFrame, query: str, fuzzy: bool = True, limit: int = 8, least: float = 0.34) -> DataFrame:
    """Technologies (technology, name, level, text) by how well a query names them."""
    q = S.squeeze(F.lit(query))
    name, text = S.squeeze(F.col("name")), S.squeeze(F.col("text"))
    close = title_ratio(name, q) * 0.72 if fuzzy else F.lit(0.0)
    score = F.when(name == q, 1.0).when(F.contains(name, q) | F.contains(q, name), 0.94).when(F.contains(text, q), 0.86).otherwise(close)
    return technologies.withColumn("score", F.round(score, 4)).filter(F.col("score") >= least).orderBy(F.desc("score"), "level", "technology").limit(limit)


def with_fallback(codes: DataFrame, library: DataFrame, fallback: str = "fallback") -> DataFrame:
    """Library rows of each root code; a code without any gets the fallback rows."""
    own = codes.join(library, "code")
    bare = codes.join(library.select("code").distinct(), "code", "left_anti")
    spare = library.filter(F.col("code") == fallback).drop("code")
    return own.unionByName(bare.crossJoin(F.broadcast(spare)).select(*own.columns))


def valid_tasks(tasks: DataFrame, groups: list[str], most: int = 5) -> DataFrame:
    """Provider tasks that can be used: named, with keywords; group and relevance put right; the first few."""
    group = F.when(F.col("task_group").isin(groups), F.col("task_group")).otherwise("model")
    relevance = F.greatest(F.lit(0.7), F.least(F.lit(0.95), F.coalesce(F.col("relevance").try_cast("double"), F.lit(0.85))))
    good = tasks.filter((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.size("keywords") > 0))
    return good.withColumns({"task_group": group, "relevance": relevance}).orderBy("place").limit(most)


Provider = Callable[[DataFrame], DataFrame]


def tasks_from(provider: Provider | None, library: DataFrame) -> DataFrame:
    """A provider's tasks, or the library's where there is no provider, it cannot answer, or it has none.

    A provider says that it cannot answer by ``ConnectionError`` or ``TimeoutError``; other errors are faults and pass.
    """
    if provider is not None:
        try:
            found = provider(library)
            if not found.isEmpty():
                return found
        except (ConnectionError, TimeoutError):
            return library
    return library


def overlaps(titles: DataFrame, related: DataFrame, texts: DataFrame, ratio: Callable[[str, str], Column] = title_ratio, most: int = 300) -> DataFrame:
    """technology, task_group and the largest similarity of its title to one of the first ``most`` recalled postings' titles."""
    existing = related.filter(F.col("place") <= most).join(texts.select("doc_id", F.col("title").alias("existing")), "doc_id").filter("existing != ''").select("technology", "existing").distinct()
    return titles.join(existing, "technology").groupBy("technology", "task_group").agg(F.max(ratio("title", "existing")).alias("overlap"))


def candidates(graded: DataFrame, overlap: DataFrame, top_k: int) -> DataFrame:
    """Task groups of each technology, ranked as candidate roles.

    ``graded``: technology, root, name, task_group, task_index, task_name, title, maturity, factor, gap, cross, evidence,
    relevance and jobs of each task; ``overlap``: technology, task_group, overlap.  Candidates are numbered in the
    order in which their groups first appear.
    """
    keys = ["technology", "task_group"]
    own = F.struct("task_index", "task_name", F.slice("jobs", 1, 2).alias("jobs"))
    groups = graded.groupBy(*keys).agg(
        F.min("task_index").alias("turn"),
        *(F.first(c).alias(c) for c in ("root", "name", "title", "maturity", "factor")),
        *(F.avg(c).alias(c) for c in ("gap", "cross", "evidence", "relevance")),
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(own)).alias("tasks"),
    )
    rows = groups.join(overlap, keys, "left").withColumns({"overlap": F.coalesce("overlap", F.lit(0.0)), "cohesion": cohesion(F.col("n"))})
    score = F.round(candidate_score(F.col("relevance"), F.col("gap"), F.col("cohesion"), F.col("cross"), F.col("factor"), F.col("evidence"), F.col("overlap")), 1)
    order = F.row_number().over(Window.partitionBy("technology").orderBy("turn"))
    rank = F.row_number().over(Window.partitionBy("technology").orderBy(F.desc("score"), "order"))
    found = rows.withColumn("score", score).withColumn("order", order.cast("long")).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top_k)
    return found.select(
        "technology",
        "task_group",
        "rank",
        F.concat(F.lit("CAND-"), F.replace("technology", F.lit("."), F.lit("")), F.lit("-"), F.lpad(F.col("order").cast("string"), 2, "0")).alias("candidate_id"),
        "title",
        "score",
        job_kind(F.col("overlap")).alias("kind"),
        horizon(F.col("maturity")).alias("horizon"),
        *(F.round(c, 4).alias(c) for c in ("relevance", "gap", "cohesion", "cross", "factor", "evidence", "overlap")),
        "n",
        "order",
        F.transform("tasks", lambda x: x["task_name"]).alias("responsibilities"),
        skills_for(F.col("root"), F.col("task_group")).alias("required_skills"),
        F.slice(F.flatten(F.transform("tasks", lambda x: x["jobs"])), 1, 4).alias("jobs"),
        F.concat(F.col("name"), F.lit("正在形成"), F.col("task_group"), F.lit("类独立任务集合，现有岗位覆盖度不足。")).alias("reason"),
        "name",
    )


def with_path(found: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Candidates with their evidence path (technology, capability, task, candidate) and at most four scenarios.

    ``capabilities``: technology, place (from 0), name, scenario; a few rows for each technology.
    """
    c = capabilities.groupBy("technology").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("caps"), F.slice(F.array_sort(F.collect_set(F.when(F.coalesce("scenario", F.lit("")) != "", F.col("scenario")))), 1, 4).alias("scenarios"))
    step = lambda kind, label: F.struct(F.lit(kind).alias("type"), label.alias("label"))
    picked = F.get("caps", (F.pmod(F.col("order") - 1, F.size("caps"))).cast("int"))["name"]
    path = F.array(step("technology", F.col("name")), step("capability", picked), step("task", F.get("responsibilities", F.lit(0))), step("candidate", F.col("title")))
    return found.join(c, "technology", "left").withColumn("path", path).drop("caps")


def run(technologies: DataFrame, milestones: DataFrame, texts: DataFrame, tasks: DataFrame, titles: DataFrame, capabilities: DataFrame, today: Column, top_k: int = 5, ablation: str | None = None, weights: Mapping[str, float] = S.EVENT_WEIGHTS, ratio: Callable[[str, str], Column] = title_ratio) -> DataFrame:
    """Candidate roles of all ``technologies`` at once, from milestones and postings.

    ``technologies``: technology, level, parent, name, aliases; ``milestones``: event_id, date, type, links, text;
    ``texts``: doc_id, company, title, text; ``tasks``: code, place, name, task_group, keywords, relevance;
    ``titles``: code, task_group, title; ``capabilities``: code, place, name, scenario.  Tasks and capabilities
    of a code that has none are those of ``fallback``; a group without a title is named after the technology.
    """
    base = technologies.withColumn("root", F.coalesce(F.nullif("parent", F.lit("")), "technology")).select("technology", "root", "name")
    # What several later steps read is computed once: as one plan, each would scan the texts and keep its broadcasts anew.
    links = checkpointed(linked(milestones, technologies))
    dated = links.join(milestones.select("event_id", "date", "type"), "event_id")
    n = links.groupBy("technology").agg(F.count(F.lit(1)).alias("milestones"))
    grown = base.join(n, "technology", "left").join(maturity(dated, today, weights).select("technology", "maturity"), "technology", "left")
    grown = grown.withColumns({"milestones": F.coalesce("milestones", F.lit(0)), "maturity": F.coalesce("maturity", F.lit(0.0))}).withColumn("factor", grade(F.col("maturity"), ablation))

    def library(rows: DataFrame) -> DataFrame:
        own = with_fallback(base.select(F.col("root").alias("code")).distinct(), rows)
        return base.select("technology", F.col("root").alias("code"), F.col("name").alias("standard")).join(own, "code").drop("code")

    specs = library(tasks).select("technology", F.col("place").alias("task"), S.fill(F.col("name"), F.col("standard")).alias("task_name"), "task_group", "keywords", "relevance")
    related = checkpointed(recalled(texts, technologies))
    if related.count() <= BROADCAST_RECALLED:
        related = F.broadcast(related)
    cover = covered(covering(related, texts, specs))
    rows = specs.join(cover, ["technology", "task"], "left").join(grown, "technology").withColumns({"m": F.coalesce("m", F.lit(0)), "c": F.coalesce("c", F.lit(0)), "jobs": F.coalesce("jobs", F.array().cast("array<bigint>"))})
    rows = rows.withColumns(gap(F.col("m"), F.col("c"), F.col("milestones"), F.col("relevance"), F.col("factor")))
    rows = rows.join(titles.select(F.col("code").alias("root"), "task_group", "title"), ["root", "task_group"], "left")
    rows = rows.withColumn("title", F.coalesce("title", F.concat("name", F.initcap("task_group"), F.lit("工程师")))).withColumnRenamed("task", "task_index")
    rows = checkpointed(rows)
    named = rows.select("technology", "task_group", "title").distinct()
    rounded = rows.withColumns({c: F.round(c, 4) for c in ("gap", "cross", "evidence")})
    found = candidates(rounded, overlaps(named, related, texts, ratio), top_k)
    return with_path(found, library(capabilities).select("technology", "place", S.fill(F.col("name"), F.col("standard")).alias("name"), "scenario"))


def means(found: DataFrame) -> DataFrame:
    """Mean evidence, cohesion and overlap of each technology's candidates."""
    return found.groupBy("technology").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("evidence", "cohesion", "overlap")), F.count(F.lit(1)).alias("candidates"))


def parsed_title(text: Column) -> dict[str, Column]:
    """title and definition in a model's answer: the line 岗位名称, if 2 to 24 characters stand there, and what follows it."""
    line = F.regexp_extract(text, r"岗位名称[：:]\s*(.+?)(?:\n|$)", 1)
    rest = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, r"(?s)岗位名称[：:]\s*.+?(?:\n|$)(.*)", 1)), "^岗位定义[：:]?\\s*", ""))
    title = F.btrim(F.trim(line), F.lit("'\"“”『』「」"))
    return {"title": F.when(F.length(title).between(2, 24), title), "definition": F.when(rest != "", rest).otherwise(F.trim(text))}
