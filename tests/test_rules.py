"""Rules with numbers worked out by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalar as S
from weftline.operators import cluster, emerging, evaluate, extract, graph, match, review

SKILLS = [(i, f"s{i}", "T1" if i < 3 else "T2", "a" if i < 3 else None) for i in range(1, 7)]


@pytest.fixture(scope="module")
def skills(spark):
    return spark.createDataFrame(SKILLS, "skill_id long, term string, l1 string, l2 string")


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "job_id string, skill_id long, confidence double, status string")


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_coverage_counts_the_resumes_skills_and_titles_break_ties(spark, skills):
    edges = edges_of(spark, [(j, s, 0.9, "approved") for j in ("J1", "J2") for s in (1, 2, 3, 4)])
    resume = spark.createDataFrame([("R", 1, 0.9), ("R", 2, 0.9)], "resume_id string, skill_id long, confidence double")
    titles = spark.createDataFrame([("J1", "b"), ("J2", "a")], "job_id string, title string")
    got = match.top_n(match.scored(match.components(resume, edges, skills, titles=titles))).orderBy("place").collect()
    assert [r["job_id"] for r in got] == ["J2", "J1"] and {r["coverage"] for r in got} == {0.25}
    # cosine 2 / (sqrt 2 * 2), domains 2 / (2 * sqrt 8 / 2), Jaccard 2 / 4
    assert got[0]["score"] == round((0.5 / math.sqrt(2) + 0.2 / math.sqrt(2) + 0.2 * 0.5) / 0.9, 4)


def test_only_approved_edges_count(spark, skills):
    edges = edges_of(spark, [("J1", 1, 0.9, "approved"), ("J1", 2, 0.95, "pending"), ("J1", 3, 0.9, "rejected")])
    assert graph.top_skills(edges).first()["skills"] == "1"
    jobs = spark.createDataFrame([("J1", "mid", None)], "job_id string, level string, collect_date date")
    heat = graph.heatmap(jobs, edges, skills, F.current_date(), 180, "t%").collect()
    assert [(r["l1"], r["l2"], r["total"]) for r in heat] == [("T1", "a", 1)]


def test_queue_begins_with_the_most_certain(spark, skills):
    edges = edges_of(spark, [("J1", 1, 0.5, "pending"), ("J2", 1, 0.8, "pending"), ("J3", 1, 0.9, "approved")])
    jobs = spark.createDataFrame([("J1", "x"), ("J2", "x"), ("J3", "x")], "job_id string, company string")
    assert [r["target_id"] for r in review.queue(edges, jobs, skills, 9).collect()] == ["J2|1", "J1|1"]


def test_scores_of_candidates(spark):
    lit = F.lit
    score = emerging.candidate_score(lit(0.9), lit(0.3), lit(0.78), lit(0.5), lit(0.6), lit(0.7), lit(0.2))
    parts = emerging.gap(lit(7), lit(7), lit(12), lit(0.9), lit(0.5))
    r = one(spark, score=F.round(score, 1), kind=emerging.job_kind(lit(0.56)), horizon=emerging.horizon(lit(0.55)), **parts)
    assert r["score"] == 63.2 and (r["kind"], r["horizon"]) == ("岗位演化", "1-3年")
    coverage = (1 - math.exp(-7 / 8)) * 0.86
    assert r["evidence"] == pytest.approx(0.52 + 0.1 + 0.2) and r["cross"] == 1 and r["coverage"] == pytest.approx(coverage)
    assert r["gap"] == pytest.approx(0.9 * 0.5 * (1 - coverage) * 0.82)


def tech(spark, rows):
    return spark.createDataFrame(rows, "technology string, level string, name string, aliases array<string>")


def test_codes_meet_by_prefix_and_texts_by_name(spark):
    m = spark.createDataFrame([("E1", [("T1", 0.9)], "none"), ("E2", [("T9", 0.5)], "about World-Model X"), ("E3", [("T10.2", 0.4)], "")], "event_id string, links array<struct<code:string,weight:double>>, text string")
    got = {(r["event_id"], r["technology"]): r["relevance"] for r in emerging.linked(m, tech(spark, [("T10", "L2", "world model", []), ("T10.2.1", "L3", "y", None)])).collect()}
    # T10 begins with T1, and T10.2 with T10; the third-level code counts as T10.2.  "y" is in no text.
    assert got == {("E1", "T10"): 0.9, ("E3", "T10"): 0.4, ("E2", "T10"): 0.72, ("E1", "T10.2.1"): 0.9, ("E3", "T10.2.1"): 0.4}


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_recall_is_normalised(spark, monkeypatch, broadcast):
    monkeypatch.setattr(emerging, "BROADCAST_TERMS", broadcast)
    texts = spark.createDataFrame([(1, "用 World - Model 与 RL"), (2, "worldmodel"), (3, "R L only"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_terms"], r["confidence"], r["place"]) for r in emerging.recalled(texts, tech(spark, [("T", "L2", "World Model", ["RL", "x"])])).collect()}
    assert got == {1: (2, 0.74, 1), 2: (2, 0.74, 2), 3: (1, 0.62, 3)}  # "worldmodel" holds "rl" as well


def test_whole_run(spark):
    day = datetime.date
    technologies = spark.createDataFrame([("T9.01", "L2", None, "世界模型", ["WM"])], "technology string, level string, parent string, name string, aliases array<string>")
    milestones = spark.createDataFrame([("E1", day(2025, 6, 1), "产品发布", [("T9", 1.0)], ""), ("E2", day(2099, 1, 1), "产品发布", [("T9", 1.0)], "")], "event_id string, date date, type string, links array<struct<code:string,weight:double>>, text string")
    texts = spark.createDataFrame([(1, "A", "世界模型工程师", "世界模型 训练"), (2, "B", "x", "WM 评测 训练")], "doc_id long, company string, title string, text string")
    tasks = spark.createDataFrame([("T9.01", 1, "{技术}训练", "model", ["训练"], 0.95), ("T9.01", 2, "{技术}评测", "evaluation", ["评测"], 0.9)], "code string, place int, name string, task_group string, keywords array<string>, relevance double")
    titles = spark.createDataFrame([("T9.01", "model", "世界模型工程师")], "code string, task_group string, title string")
    caps = spark.createDataFrame([("fallback", 0, "{技术}感知", "工厂")], "code string, place int, name string, scenario string")
    got = {r["task_group"]: r for r in emerging.run(technologies, milestones, texts, tasks, titles, caps, F.lit("2026-08-01").cast("date")).collect()}
    maturity = round(1 - math.exp(-0.12 * 0.84 * math.exp(-0.11 * 426 / 365.25)), 4)
    factor = max(0.35, maturity)
    cover = (1 - math.exp(-2 / 8)) * 0.86
    evidence = 0.52 + 2 / 120 + 2 / 35
    gap = round(0.95 * factor * (1 - cover) * evidence * (0.58 + 0.42 * 2 / 7), 4)
    score = 100 * (0.2 * 0.95 + 0.25 * gap + 0.15 * 0.78 + 0.1 * round(2 / 7, 4) + 0.1 * factor + 0.1 * round(evidence, 4) + 0.1 * (1 - 1.0))
    r = got["model"]
    assert r["score"] == round(score, 1) and r["kind"] == "已有岗位" and r["candidate_id"] == "CAND-T901-01" and r["jobs"] == [1, 2]
    assert got["evaluation"]["title"] == "世界模型Evaluation工程师" and got["evaluation"]["candidate_id"] == "CAND-T901-02"
    assert [s["label"] for s in r["path"]] == ["世界模型", "世界模型感知", "世界模型训练", "世界模型工程师"] and r["scenarios"] == ["工厂"]
    assert r["required_skills"] == ["具身智能", "数据分析", "系统工程", "模型训练"]


def test_clusters(spark, skills):
    members = spark.createDataFrame([("C", "J1"), ("C", "J2")], "cluster_id string, job_id string")
    edges = edges_of(spark, [("J1", 1, 0.9, "approved"), ("J1", 2, 0.9, "approved"), ("J2", 4, 0.9, "approved")])
    r = cluster.classify(members, edges, skills).first()
    assert (r["l1"], r["l2"], r["coverage"], r["ratio"]) == ("T1", "a", 1.0, 0.5)
    words = spark.createDataFrame([("J1", f"k{i:02d}") for i in range(20)], "job_id string, kw string")
    named = cluster.profile(members, spark.createDataFrame([("J1", "t1"), ("J2", "t2")], "job_id string, title string"), words)
    d = cluster.definition(named, cluster.classify(members, edges, skills)).first()
    assert d["required"] == ",".join(f"k{i:02d}" for i in range(8)) and d["bonus"] == ",".join(f"k{i:02d}" for i in range(10, 16))
    assert d["scenarios"] == "t1；t2" and d["duties"].startswith("围绕a方向")


def test_hit_rate(spark):
    rows = spark.createDataFrame([("A", 0.9, 1), ("A", 0.8, 2), ("B", 0.5, 1)], "resume_id string, score double, place int")
    r = evaluate.hits(rows, spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "resume_id string")).first()
    assert tuple(r) == (4, 2, 0.5, 0.9, 0.9)


def test_texts(spark):
    pay = lambda t: tuple(one(spark, s=S.salary(F.lit(t)))["s"])
    assert pay("20至30k") == (30000, 30000) and pay("20~30K") == (20000, 30000) and pay("8-9千") == (8000, 9000) and pay("1.5-2万") == (None, None)
    whole = S.note(F.array(*map(F.lit, "abcdef")), F.array().cast("array<string>"), F.array(F.lit("x"), F.lit("y")))
    empty = F.array().cast("array<string>")
    r = one(spark, a=whole, b=S.note(empty, empty, empty), c=S.snippet(F.lit("x" * 50 + " key " + "y" * 200), ["KEY"], 60))
    assert r["a"] == "新增能力 6 项（a、b、c、d、e等）；置信度/证据更新 2 项" and r["b"] == "能力结构无变化"
    assert r["c"] == "x" * 39 + " key " + "y" * 16 + "…"
    metric = spark.createDataFrame([(7, "精度mm")], "skill_id long, term string")
    texts = spark.createDataFrame([(1, "a3mm2"), (2, "mm 3"), (3, "3  m")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in extract.metrics(texts, metric).collect()) == [1, 3]
    parsed = emerging.parsed_title(F.lit("岗位名称：「具身工程师」\n岗位定义：负责训练"))
    assert tuple(one(spark, **parsed)) == ("具身工程师", "负责训练")
    assert tuple(one(spark, **emerging.parsed_title(F.lit(" 没有名称 ")))) == (None, "没有名称")
