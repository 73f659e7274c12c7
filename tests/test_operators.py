import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.operators import cluster, emerging, evaluate, evolve, extract, graph, ingest, match, review, vectors


@pytest.fixture(scope="module")
def seed(spark):
    skills = spark.createDataFrame([(1, "强化学习", "AI", "a"), (2, "SLAM", "T1", "b"), (3, "ROS", "T1", "b"), (4, "PyTorch", "AI", "a")], "skill_id long, term string, l1 string, l2 string")
    edges = spark.createDataFrame([("J1", 1, 0.95, "approved", True), ("J1", 2, 0.95, "approved", True), ("J2", 3, 0.95, "approved", True)], "job_id string, skill_id long, confidence double, status string, has_evidence boolean")
    return skills, edges


def test_match_gaps(spark, seed):
    skills, edges = seed
    resume = spark.createDataFrame([("R", 2, 0.85), ("R", 3, 0.85)], "resume_id string, skill_id long, confidence double")
    got = match.top_n(match.scored(match.components(resume, edges, skills)))
    by = {r["job_id"]: r for r in got.collect()}
    assert by["J1"]["severity"] == "moderate" and by["J2"]["severity"] == "minor"
    gaps = {r["job_id"]: (r["shared"], r["missing"], r["extra"]) for r in match.gaps(got, resume, edges).collect()}
    assert gaps == {"J1": ("2", "1", "3"), "J2": ("3", "", "2")}
    assert match.components(resume.limit(0), edges, skills).count() == 0


@pytest.fixture(scope="module")
def sides(spark):
    """Résumés and postings whose skills lie far apart in two ranges, one skill that all have, a skill and weights that count for nothing."""
    rng = random.Random(3)
    skills = spark.createDataFrame([(s, ("AI", "T1", "", None, "B")[s % 5]) for s in range(60)], "skill_id long, l1 string")
    draw = lambda i: {0} | {rng.randrange(1, 30) + 30 * (i % 2) for _ in range(rng.randrange(1, 9))}
    rows = lambda n: [(i, s, rng.choice([0.0, 0.85, 0.9, 0.95])) for i in range(n) for s in draw(i)] + [(n, None, 0.9), (n + 1, 7, None)]
    resume = spark.createDataFrame(rows(60), "resume_id long, skill_id long, confidence double")
    job = spark.createDataFrame(rows(90), "job_id long, skill_id long, confidence double")
    return resume, job, skills, spark.createDataFrame([(j, "xyz"[j % 3]) for j in range(80)], "job_id long, title string")


def test_pairs_meet_without_a_shuffle_of_pairs(sides, monkeypatch):
    resume, job, skills, titles = sides
    for name, value in (("BLOCK_ENTRIES", 40), ("PIECE", 50), ("KEPT_ROWS", 30), ("DENSE_CELLS", 0)):
        monkeypatch.setattr(match, name, value)
    domain = {r["skill_id"]: r["l1"] for r in skills.collect()}
    title = {r["job_id"]: r["title"] for r in titles.collect()}

    def vectors_of(rows):
        out = {}
        for owner, skill, w in rows.collect():
            if w and w > 0:
                out.setdefault(owner, {})[skill] = w
        return out

    def cosine(a, b):
        dot = sum(w * b.get(k, 0.0) for k, w in a.items() if k is not None)
        return dot / (sum(w * w for w in a.values()) * sum(w * w for w in b.values())) ** 0.5 if dot else 0.0

    def domains(v):
        out = {}
        for s, w in v.items():
            if domain.get(s):
                out[domain[s]] = out.get(domain[s], 0.0) + w
        return out

    r, j = vectors_of(resume), vectors_of(job)
    want = {}
    for a, x in r.items():
        for b, y in j.items():
            n = len((set(x) & set(y)) - {None})
            if n and b in title:
                want[a, b] = (n, len(x), len(y), cosine(x, y), cosine(domains(x), domains(y)), n / (len(x) + len(y) - n))
    parts = match.components(resume, job, skills, titles=titles)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("\n")[1] + plan.split("\n")[2] and "n_shared" not in plan[plan.index("Exchange") :]  # pairs are made after the last shuffle
    got = {(p["resume_id"], p["job_id"]): tuple(p)[2:8] for p in parts.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    plain = lambda df: sorted(tuple(x) for x in df.collect())
    scored = match.scored(parts)
    cols = ["resume_id", "job_id", "score", "capability", "l1_score", "jaccard"]
    assert plain(match.scores(*sides[:3], titles=titles)) == plain(scored.select(cols))
    top = match.top_n(scored, 3)
    assert plain(match.best(*sides[:3], titles, 3).select(top.columns)) == plain(top)
    assert plain(match.best_gaps(*sides[:3], titles, 3)) == plain(match.gaps(top, resume, job))
    assert plain(match.severities(*sides[:3], titles)) == plain(scored.groupBy("severity").count())
    led = {b for b, y in j.items() if (d := domains(y)) and min((-round(w, 9), k) for k, w in d.items())[1] == "T1"}
    assert {(x["resume_id"], x["job_id"]) for x in match.scores(*sides[:3], "T1", titles).collect()} == {k for k in want if k[1] in led}


@pytest.fixture(scope="module")
def far(spark):
    """Each résumé has skills from the whole range, so that every block meets every posting."""
    skills = spark.createDataFrame([(s, "ABC"[s % 3]) for s in range(40)], "skill_id long, l1 string")
    resume = spark.createDataFrame([(i, s, 0.9) for i in range(30) for s in (i % 5, 20 + i % 7, 39 - i % 3)], "resume_id long, skill_id long, confidence double")
    job = spark.createDataFrame([(i, s, 0.8 + i / 1000) for i in range(50) for s in (i % 6, 20 + i % 9, 39 - i % 4)], "job_id long, skill_id long, confidence double")
    return resume, job, skills


def test_no_posting_is_shuffled_to_the_blocks(far, monkeypatch):
    monkeypatch.setattr(match, "BLOCK_ENTRIES", 20)
    counts = match.severities(*far)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    product = plan[plan.index("CartesianProduct") :]
    assert product.count("Exchange") == 1 and "job_blob" not in product[product.index("Exchange") :].split("\n")[0]  # only the blocks' own side is dealt
    want = far[0].join(far[1].withColumnRenamed("confidence", "c"), "skill_id").select("resume_id", "job_id").distinct().count()
    assert sum(r["n"] for r in counts.collect()) == want


def test_best_of_a_block_that_several_tasks_met(far, monkeypatch):
    monkeypatch.setattr(match, "BLOCK_ENTRIES", 30)
    schema = match._types(*far[:2]) + match.PARTS + ", title string, place bigint"
    cells, *rest = match._cells(*far, None)
    plain = lambda df: sorted(tuple(x) for x in df.collect())
    want = plain(match.top_n(match.scored(match.components(*far)), 3).drop("title"))
    assert plain(match.scored(match._met((cells.repartition(5), *rest), "best", schema, n=3), "place").drop("title").select(*match.top_n(match.scored(match.components(*far)), 3).drop("title").columns)) == want


def test_texts_as_ids(spark, far):
    texts = [df.withColumns({c: df[c].cast("string") for c in df.columns if c.endswith("_id")}) for df in far]
    rows = lambda df: {(str(x["resume_id"]), str(x["job_id"]), x["score"], x["jaccard"]) for x in df.collect()}
    assert rows(match.scores(*texts)) == rows(match.scores(*far))


def test_rounding_is_that_of_spark(spark):
    x = [k / m for m in range(1, 161) for k in range(m + 1)]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", F.round("x", 4).alias("y")).collect()
    assert match.half_up(np.array([r["x"] for r in rows]), 4).tolist() == [r["y"] for r in rows]
    x = [k / 1000 for k in range(-2000, 2001)] + [0.95 - k / 100 for k in range(120)] + [1e300, -7e12, float("inf"), float("nan"), None]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 2).alias("a"), scalar.rounded(F.col("x"), 2).alias("b")).collect()
    assert [repr(r["a"]) for r in rows] == [repr(r["b"]) for r in rows]


def test_unit_vector(spark):
    rows = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (1, "c", 0.0)], "id int, k string, w double")
    assert {r["k"]: r["w"] for r in vectors.unit(rows, "id").collect()} == pytest.approx({"a": 0.6, "b": 0.8})


def test_title_ratio(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", "x"), (None, "x")], "a string, b string").select(match.title_ratio("a", "b").alias("r"))
    assert [r["r"] for r in rows.collect()] == [0.75, 0.0, 0.0]


def test_nested_terms(spark):
    texts = spark.createDataFrame([(1, "熟悉深度强化学习，PyTorch；PyTorch2 不算"), (2, None), (3, "pytorch")], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "强化学习"), (2, "深度强化学习"), (3, "PyTorch"), (4, "pytorch")], "skill_id long, term string")
    got = {(r["doc_id"], r["skill_id"]) for r in extract.occurrences(texts, terms).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (3, 3)}
    exact = {(r["doc_id"], r["skill_id"]) for r in extract.exact(texts, terms).collect()}
    assert exact == got


def test_combination_and_metric(spark):
    texts = spark.createDataFrame([(1, "会 SLAM 导航"), (2, "精度 3.5 mm 以内")], "doc_id long, text string")
    combos = spark.createDataFrame([(1, "SLAM/ROS"), (2, "视觉、触觉")], "skill_id long, term string")
    assert [(r["doc_id"], r["skill_id"], r["is_whole"]) for r in extract.combinations(texts, combos).collect()] == [(1, 1, False)]
    metric = spark.createDataFrame([(7, "精度mm")], "skill_id long, term string")
    assert [r["doc_id"] for r in extract.metrics(texts, metric).collect()] == [2]


def test_quota(spark):
    assert graph.quota_table(graph.QUOTAS, 250) == {"T1": 105, "T7": 53, "T3": 39, "T6": 20, "T4": 13, "T5": 11, "T2": 9}


def test_snapshot(spark):
    base = spark.createDataFrame([("J1", 1, 0.95, None), ("J1", 2, 0.95, "x")], "job_id string, skill_id long, confidence double, evidence string")
    new = spark.createDataFrame([("J1", 1, 0.95, ""), ("J1", 3, 0.95, "y")], "job_id string, skill_id long, confidence double, evidence string")
    diff = evolve.difference(base, new)
    assert {(r["skill_id"], r["change"]) for r in diff.collect()} == {(3, "added"), (2, "removed")}
    assert evolve.notes(diff).first()["note"] == "新增能力 1 项（3）；移除能力 1 项（2）"


def test_maturity(spark):
    day = datetime.date
    events = spark.createDataFrame([("T", "E1", day(2025, 6, 1), "产品发布", 1.0), ("T", "E2", day(2099, 1, 1), "产品发布", 1.0), ("U", "E3", day(2099, 1, 1), None, 1.0)], "technology string, event_id string, date date, type string, relevance double")
    got = {r["technology"]: (r["n_events"], r["maturity"]) for r in emerging.maturity(events, F.lit("2026-08-01").cast("date")).collect()}
    assert list(got) == ["T"] and got["T"][0] == 1 and 0 < got["T"][1] <= 0.98


def test_search_and_providers(spark):
    tech = spark.createDataFrame([("T1", "强化学习", 1, "RL"), ("T2", "SLAM", 1, "mapping")], "technology string, name string, level int, text string")
    assert [r["technology"] for r in emerging.search(tech, "slam").collect()] == ["T2"]

    def unreachable(_):
        raise ConnectionError

    def faulty(_):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        emerging.tasks_from(faulty, tech)
    assert emerging.tasks_from(unreachable, tech) is tech and emerging.tasks_from(None, tech) is tech
    raw = spark.createDataFrame([("a", ["k"], "odd", "2", 1), ("", ["k"], "model", "0.8", 2), ("b", [], "model", "0.8", 3)], "name string, keywords array<string>, task_group string, relevance string, place int")
    assert [(r["task_group"], r["relevance"]) for r in emerging.valid_tasks(raw, ["model"]).collect()] == [("model", 0.95)]


def test_clusters_hold_every_posting_once(spark):
    rng = random.Random(3)
    jobs = list(range(160))
    pairs = [(a, b, rng.choice([0.1, 0.4, 0.6, 0.9])) for a in jobs for b in jobs if a < b and rng.random() < 0.3]
    got = cluster.greedy(spark.createDataFrame([(j,) for j in jobs], "job_id long"), spark.createDataFrame(pairs, "a long, b long, cosine double"), capacity=10)
    rows = got.collect()
    assert sorted(r["job_id"] for r in rows) == jobs
    sizes = {}
    for r in rows:
        sizes[r["cluster_id"]] = sizes.get(r["cluster_id"], 0) + 1
    assert max(sizes.values()) <= 10


def test_clusters_from_vectors_follow_the_pairwise_rule(spark):
    rng = random.Random(8)
    postings = {j: {rng.randrange(14): rng.uniform(0.5, 3) for _ in range(rng.randint(1, 5))} for j in range(150)}
    postings |= {200: {90: 1.0, 91: 2.0}, 201: {91: 1.0}, 202: {95: 0.0}}
    norm = {j: sum(w * w for w in v.values()) ** 0.5 for j, v in postings.items()}
    cosine = lambda a, b: sum(w * postings[b].get(k, 0) for k, w in postings[a].items()) / (norm[a] * norm[b]) if norm[a] and norm[b] else 0.0
    pairs = {(a, b): c for a in postings for b in postings if a < b and (c := cosine(a, b)) > 0}
    want = cluster.assign(sorted(postings), pairs, 0.35, 6, 3)
    rows = spark.createDataFrame([(j, k, w) for j, v in postings.items() for k, w in v.items()], "job_id long, kw long, w double")
    got = {r["job_id"]: r["cluster_id"] for r in cluster.greedy_vectors(rows, capacity=6).collect()}
    first = {}
    for j in sorted(postings):
        first.setdefault(want[j], j)
    assert got == {j: first[k] for j, k in want.items()}


def _plainly_clustered(units, capacity, threshold=0.35, depth=3):
    """The clusters that ``assign_vectors`` must give, each mean read from all members."""
    clusters, where = [], {}
    dots = {}

    def sim(a, b):
        if (a, b) not in dots:
            dots[a, b] = sum(w * units[b].get(f, 0.0) for f, w in units[a].items())
        return dots[a, b]

    def mean(job, members):
        return round(sum(sim(job, m) for m in members) / len(members), 9)

    def place(job, turn):
        scores = [mean(job, c) for c in clusters]
        best = max(range(len(scores)), key=lambda k: (scores[k], -k), default=-1)
        if best >= 0 and scores[best] >= threshold:
            own = clusters[best]
            if len(own) < capacity:
                own.append(job)
                where[job] = best
                return
            fits = [mean(m, [x for x in own if x != m]) for m in own]
            i = fits.index(min(fits))
            if turn < depth and scores[best] > fits[i]:
                out = own.pop(i)
                own.append(job)
                where[job] = best
                place(out, turn + 1)
                return
        where[job] = len(clusters)
        clusters.append([job])

    for job in range(len(units)):
        place(job, 0)
    return [where[j] for j in range(len(units))]


def test_many_equal_postings_are_clustered_by_the_same_rule(spark):
    rng = random.Random(3)
    weight = [rng.uniform(1, 5) for _ in range(60)]
    kinds = [sorted(rng.sample(range(60), 1)) for _ in range(12)] + [sorted(rng.sample(range(60), rng.randint(2, 4))) for _ in range(90)]
    sets = [rng.choice(kinds[:12] if rng.random() < 0.4 else kinds) for _ in range(420)]
    units = [{f: weight[f] / sum(weight[x] ** 2 for x in s) ** 0.5 for f in s} for s in sets]
    want = _plainly_clustered(units, 4)
    arrays = [(np.array(list(u), np.int32), np.array(list(u.values()))) for u in units]
    for apart in (False, True):
        assert cluster.assign_vectors(arrays, 0.35, 4, 3, apart) == want
    # The same postings from a table, in groups that share features; a feature of another group beside them.
    rows = [(j, f"f{f:02d}", weight[f]) for j, s in enumerate(sets) for f in s] + [(1000, "z", 1.0), (1001, "z", 2.0), (1002, "none", 0.0)]
    got = {r["job_id"]: r["cluster_id"] for r in cluster.greedy_vectors(spark.createDataFrame(rows, "job_id long, kw string, w double"), capacity=4).collect()}
    first = {}
    for j, k in enumerate(want):
        first.setdefault(k, j)
    assert got == {j: first[k] for j, k in enumerate(want)} | {1000: 1000, 1001: 1000, 1002: 1002}


def test_clusters_that_nothing_can_join_are_not_compared(monkeypatch):
    kept = []
    add = cluster._Sums.add
    monkeypatch.setattr(cluster._Sums, "add", lambda self, k, *a: (kept.append(k), add(self, k, *a))[1])
    equal = [(np.array([0, 1]), np.array([0.6, 0.8]))] * 300
    assert cluster.assign_vectors(equal, 0.35, 6, 3) == [0] * 6 + list(range(1, 295))
    assert set(kept) == {0}


def test_features_that_became_rare_take_little_room():
    sums = cluster._Sums()
    for k in range(2100):
        own = ([0, 1 + k], [0.6, 0.8]) if k < 40 else ([1 + k], [1.0])
        assert sums.open() == k
        sums.add(k, *own, 1)
        if k == 39:
            assert 0 not in sums.slot and len(sums.near[0]) == 64
    assert len(sums.near[0]) < 64
    assert sums.best([0], [1.0], 0.35) == (0, 0.6)
    sums.add(7, [0], [1.0], 1)
    sums.add(2000, [0], [1.0], 1)
    assert sums.best([0], [1.0], 0.35) == (7, 0.8)
    sums.add(7, [0], [1.0], -1)
    assert sums.best([0, 2001], [0.6, 0.8], 0.35) == (2000, 0.7)


def test_registered_clusters_use_terms_and_categories(spark, tmp_path):
    lines = [(1, 1), (1, 2), (2, 3), (2, 4), (3, 5)]
    spark.createDataFrame([(o, p, 0.0, "A", "F") for o, p in lines], "l_orderkey long, l_partkey long, l_discount double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    names = {1: ("red nut", "A"), 2: ("tin cap", "B"), 3: ("red nut", "A"), 4: ("tin cap", "B"), 5: ("oak peg", "C")}
    spark.createDataFrame([(p, t, "x", b) for p, (t, b) in names.items()], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    from weftline import catalogue

    # Postings 1 and 2 share every term and category, and no skill id.
    assert {r["job_id"]: r["cluster_id"] for r in catalogue.QUERIES["greedy_cluster"](spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 3}


def test_review(spark, seed):
    _, edges = seed
    decisions = spark.createDataFrame([("J1|1", 1, "approve"), ("J1|1", 2, "reject"), ("J9|9", 1, "approve")], "target_id string, turn int, action string")
    got = {(r["job_id"], r["skill_id"]): r["new_status"] for r in review.decide(edges, decisions).collect()}
    assert got[("J1", 1)] == "rejected" and got[("J1", 2)] == "approved"
    assert review.unknown(edges, decisions).count() == 1
    assert review.summary(edges.limit(0)).first()["evidence_coverage"] == 0.0


def test_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b")], "id long, t string")
    from weftline.functions import scalar as S

    once = ingest.first_wins(rows, S.dedup_key(F.col("t")), "id")
    assert sorted(r["id"] for r in once.collect()) == [1, 3]
    assert ingest.first_wins(once, S.dedup_key(F.col("t")), "id").count() == 2
    assert ingest.orphans(rows, once, "id", "id").count() == 1


def test_numbering(spark):
    rows = spark.createDataFrame([(f"t{i:03d}",) for i in range(100)], "t string").repartition(7)
    got = {r["t"]: r["id"] for r in ingest.numbered(rows, "id", ["t"]).collect()}
    assert got == {f"t{i:03d}": i + 1 for i in range(100)}


def test_evaluation(spark):
    t = spark.createDataFrame([(1,), (2,)], "k int")
    p = spark.createDataFrame([(2,), (3,)], "k int")
    assert tuple(evaluate.micro(t, p, ["k"]).first()) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(evaluate.micro(t.limit(0), p.limit(0), ["k"]).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
    v = spark.createDataFrame([(float(i),) for i in range(4)], "v double")
    assert evaluate.upper_median(v, "v").first()["median"] == 2.0


def test_fallback(spark):
    lib = spark.createDataFrame([("T1", "a"), ("fallback", "x")], "code string, name string")
    codes = spark.createDataFrame([("T1",), ("T9",)], "code string")
    assert sorted(map(tuple, emerging.with_fallback(codes, lib).collect())) == [("T1", "a"), ("T9", "x")]
