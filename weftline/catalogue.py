"""Every query of the skill-graph operators over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import scalar as S
from weftline.operators import cluster, emerging, evaluate, evolve, extract, graph, ingest, match, review, vectors, views
from weftline.plans import roles as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Our choices for the driver's tables.
QUOTAS = {"ECONOMY": 80, "LARGE": 40, "MEDIUM": 30, "PROMO": 15, "SMALL": 10, "STANDARD": 8}
WEIGHTS = {"view": 0.45, "click": 0.55, "signup": 0.76, "purchase": 0.84}
TODAY, DAYS = "2001-08-01", 180
EVENT_DAY = "2024-02-01"
STOPWORDS = ["blue bolt", "Brand#7"]
TERMS = [(1, "the"), (2, "then"), (3, "and the"), (4, "that"), (5, "General Public License"), (6, "all rights reserved"), (7, "de la"), (8, "und"), (9, "The")]
COMBOS = [(1, "apache/license"), (2, "reserved、rights"), (3, "the+xyzzy"), (4, "nosuch,absent")]
METRICS = [(1, "length mm"), (2, "speed ms"), (3, "version v"), (4, "share %")]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = R.sql(sql)
        return f

    return add


def values(rows: list[tuple]) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return R.read(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("company"))


def terms(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "skill_id long, term string")


NORM = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(translate({x}, '，。！？；：“”‘’（）【】、', ',.!?;:""''''()[] '), '[\s\-/\\|]+', ' ', 'g'), '[^一-龥A-Za-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')))"""


def norm(x: str) -> str:
    return NORM.format(x=f"coalesce({x}, '')")


# -- counts


@query("""SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM skills) AS skills, (SELECT count(*) FROM edges) AS edges,
       (SELECT count(*) FROM supplier) AS clusters, (SELECT count(*) FROM resumes) AS resumes""")
def stats_counts(spark, sf):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(R.jobs(spark, sf), "jobs")
    for df, name in ((R.skills(spark, sf), "skills"), (R.edges(spark, sf), "edges"), (R.read(spark, sf, "supplier"), "clusters"), (R.resumes(spark, sf), "resumes")):
        out = out.crossJoin(n(df, name))  # single rows
    return out


@query("SELECT r_name AS domain, count(s_suppkey) AS clusters FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")
def l1_distribution(spark, sf):
    r, n, s = (R.read(spark, sf, t) for t in ("region", "nation", "supplier"))
    return r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("r_name").alias("domain")).agg(F.count("s_suppkey").alias("clusters"))


@query("""SELECT job_id, skill_id, round(confidence, 6) AS confidence, has_evidence,
       CASE WHEN confidence >= 0.9 AND has_evidence THEN 'approved' ELSE 'pending' END AS status FROM edges""")
def edge_dedup_status(spark, sf):
    rule = S.status(F.lit("dictionary"), F.col("confidence"), F.col("has_evidence"))
    return R.edges(spark, sf).select("job_id", "skill_id", F.round("confidence", 6).alias("confidence"), "has_evidence", rule.alias("status"))


# -- graph


@query("SELECT job_id, count(*) AS degree FROM edges WHERE status = 'approved' GROUP BY 1")
def job_degree_approved(spark, sf):
    return graph.degree(R.edges(spark, sf))


@query("""n AS (SELECT skill_id, count(DISTINCT job_id) AS jobs FROM edges WHERE status = 'approved' GROUP BY 1)
SELECT skill_id, jobs, CAST(floor(40 + 60 * jobs / (SELECT max(jobs) FROM n)) AS BIGINT) AS weight FROM n""")
def skill_demand_weight(spark, sf):
    return graph.skill_demand(R.edges(spark, sf))


DOMINANT = """n AS (SELECT job_id, l1, count(*) AS n FROM edges JOIN skills USING (skill_id) GROUP BY 1, 2),
dominant AS (SELECT job_id, l1, n FROM n QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC, l1) = 1)"""


@query(DOMINANT + " SELECT job_id, l1, n FROM dominant")
def dominant_l1(spark, sf):
    return graph.dominant_domain(R.edges(spark, sf), R.skills(spark, sf))


LIMIT_JOBS = 250
NODES = (
    DOMINANT
    + f""", degree AS (SELECT job_id, count(*) AS degree FROM edges WHERE status = 'approved' GROUP BY 1),
quota AS (SELECT * FROM ({values([(k, n, i) for i, (k, n) in enumerate(graph.quota_table(QUOTAS, LIMIT_JOBS).items())])}) q(l1, places, turn)),
ranked AS (SELECT job_id, l1, degree, level, salary_max, turn, places, row_number() OVER (PARTITION BY l1 ORDER BY degree DESC, job_id) AS place
           FROM jobs JOIN degree USING (job_id) JOIN dominant USING (job_id) JOIN quota USING (l1)),
nodes AS (SELECT * FROM ranked WHERE place <= places ORDER BY turn, place LIMIT {LIMIT_JOBS})"""
)


@query(NODES + """ SELECT job_id, l1, degree, level, 'embodied' AS category, CAST(least(99, floor(50 + 49 * salary_max / (SELECT max(salary_max) FROM jobs))) AS INT) AS demand, place FROM nodes""")
def graph_job_nodes_quota(spark, sf):
    return graph.job_nodes(R.jobs(spark, sf), R.edges(spark, sf), R.skills(spark, sf), QUOTAS, LIMIT_JOBS)


@query("""best AS (SELECT job_id, skill_id, row_number() OVER (PARTITION BY job_id ORDER BY confidence DESC, skill_id) AS place FROM edges WHERE status = 'approved')
SELECT job_id, string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY place) AS skills, count(*) AS n FROM best WHERE place <= 8 GROUP BY 1""")
def job_top8_skills(spark, sf):
    return graph.top_skills(R.edges(spark, sf))


@query(NODES + """, own AS (SELECT * FROM edges WHERE status = 'approved' AND job_id IN (SELECT job_id FROM nodes)),
best AS (SELECT skill_id, count(DISTINCT job_id) AS jobs FROM own GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 120)
SELECT job_id, skill_id, round(confidence, 6) AS confidence FROM own WHERE skill_id IN (SELECT skill_id FROM best)""")
def graph_edges_selected(spark, sf):
    nodes = graph_job_nodes_quota(spark, sf).select("job_id")
    return graph.selected_edges(R.edges(spark, sf), nodes).select("job_id", "skill_id", F.round("confidence", 6).alias("confidence"))


HEAT = f"""pairs AS (SELECT DISTINCT l1, l2, job_id, level FROM edges JOIN skills USING (skill_id) JOIN jobs USING (job_id)
 WHERE status = 'approved' AND l1 ILIKE 's%' AND (collect_date >= DATE '{TODAY}' - {DAYS} OR collect_date IS NULL)),
heat AS (SELECT l1, l2, count(*) FILTER (level = 'junior') AS junior, count(*) FILTER (level = 'mid') AS mid, count(*) FILTER (level = 'senior') AS senior, count(*) AS total FROM pairs GROUP BY 1, 2)"""


@query(HEAT + " SELECT * FROM heat")
def heatmap(spark, sf):
    return graph.heatmap(R.jobs(spark, sf), R.edges(spark, sf), R.skills(spark, sf), F.lit(TODAY).cast("date"), DAYS, "s%")


@query(HEAT + """, cells AS (UNPIVOT (SELECT l1, l2, junior, mid, senior FROM heat) ON junior, mid, senior INTO NAME level VALUE n)
SELECT l1, l2, level, n, round(CASE WHEN n = 0 THEN 0.0 ELSE 0.12 + 0.88 * n / (SELECT max(n) FROM cells) END, 6) AS heat FROM cells""")
def heatmap_scaled(spark, sf):
    return graph.scaled(heatmap(spark, sf))


@query("SELECT skill_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM edges JOIN (SELECT job_id, job_id % 100 AS x, year(collect_date) AS y FROM jobs) USING (job_id) GROUP BY 1")
def skill_anchors(spark, sf):
    points = R.jobs(spark, sf).select("job_id", (F.col("job_id") % 100).alias("x"), F.year("collect_date").alias("y"))
    return graph.anchors(R.edges(spark, sf), points).select("skill_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# -- pages, lists, lookups


@query("""size AS (SELECT cluster_id, count(*) AS jobs FROM members GROUP BY 1)
SELECT cluster_id, jobs, s_name AS name, n_name AS l2 FROM size JOIN supplier ON s_suppkey = cluster_id LEFT JOIN nation ON n_nationkey = s_nationkey WHERE jobs >= 5 ORDER BY jobs DESC, cluster_id LIMIT 50 OFFSET 10""")
def clusters_page(spark, sf):
    size = R.cluster_members(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("jobs"))
    s, n = R.read(spark, sf, "supplier"), R.read(spark, sf, "nation")
    rows = size.join(s, F.col("s_suppkey") == F.col("cluster_id")).join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return rows.filter("jobs >= 5").orderBy(F.desc("jobs"), "cluster_id").offset(10).limit(50).select("cluster_id", "jobs", F.col("s_name").alias("name"), F.col("n_name").alias("l2"))


@query("SELECT cluster_id, count(*) AS n, md5(string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id)) AS members FROM members JOIN jobs USING (job_id) GROUP BY 1")
def cluster_members(spark, sf):
    rows = R.cluster_members(spark, sf).join(R.jobs(spark, sf).select("job_id"), "job_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("job_id")), lambda x: x.cast("string")), ",")
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.md5(listed).alias("members"))


@query("SELECT job_id, company, level, CAST(collect_date AS VARCHAR) AS collected FROM jobs ORDER BY collect_date DESC, job_id LIMIT 100 OFFSET 20")
def jobs_page(spark, sf):
    return R.jobs(spark, sf).orderBy(F.desc("collect_date"), "job_id").offset(20).limit(100).select("job_id", "company", "level", F.col("collect_date").cast("string").alias("collected"))


@query("SELECT job_id, skill_id, term, l1, round(confidence, 6) AS confidence FROM edges JOIN skills USING (skill_id) WHERE job_id = 7")
def job_detail(spark, sf):
    return R.edges(spark, sf).filter("job_id = 7").join(R.skills(spark, sf), "skill_id").select("job_id", "skill_id", "term", "l1", F.round("confidence", 6).alias("confidence"))


@query("SELECT resume_id, name, title, count(skill_id) AS n_skills FROM resumes LEFT JOIN resume_skills USING (resume_id) GROUP BY 1, 2, 3")
def resume_list_counts(spark, sf):
    n = R.resume_skills(spark, sf).groupBy("resume_id").agg(F.count(F.lit(1)).alias("n_skills"))
    return R.resumes(spark, sf).join(n, "resume_id", "left").withColumn("n_skills", F.coalesce("n_skills", F.lit(0)))


# -- deduplication and scalar functions

KEY = "concat_ws('|', lower(regexp_replace(coalesce({0}, ''), '\\s+', '', 'g')), lower(regexp_replace(coalesce({1}, ''), '\\s+', '', 'g')), lower(regexp_replace(coalesce({2}, ''), '\\s+', '', 'g')))"
DOC_KEY = KEY.format("lang", "text", "source")


def _doc_key():
    return F.md5(S.dedup_key(F.col("lang"), F.col("text"), F.col("source")))


@query(f"SELECT page_id, md5({KEY.format('url', 'html', 'NULL')}) AS key FROM pages")
def dedup_key(spark, sf):
    return R.read(spark, sf, "pages").select("page_id", F.md5(S.dedup_key(F.col("url"), F.col("html"), F.lit(None))).alias("key"))


@query(f"SELECT min(doc_id) AS doc_id, md5(k) AS key FROM (SELECT doc_id, {DOC_KEY} AS k FROM documents) GROUP BY k")
def dedup_first_wins(spark, sf):
    return ingest.first_wins(R.read(spark, sf, "documents"), _doc_key(), "doc_id").select("doc_id", _doc_key().alias("key"))


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS survivor, count(*) OVER (PARTITION BY k) AS group_size FROM (SELECT doc_id, {DOC_KEY} AS k FROM documents)")
def survivor_map(spark, sf):
    return ingest.survivors(R.read(spark, sf, "documents"), _doc_key(), "doc_id")


PAY = """CASE p_partkey % 5 WHEN 0 THEN p_size || '-' || (p_size + 10) || 'k' WHEN 1 THEN p_size || '-' || (p_size + 5) || 'K·13薪' WHEN 2 THEN p_size || '.5K' WHEN 3 THEN p_size || 'k-' || (p_size + 10) || 'k' ELSE '1.5-2万' END"""


@query(f"""t AS (SELECT p_partkey AS skill_id, {PAY} AS pay FROM part)
SELECT skill_id, CASE WHEN skill_id % 5 = 4 THEN NULL WHEN skill_id % 5 IN (2, 3) THEN CAST(floor(CAST(regexp_extract(pay, '^([0-9.]+)', 1) AS DOUBLE) * 1000) AS BIGINT) ELSE CAST(floor(CAST(regexp_extract(pay, '^([0-9]+)-', 1) AS DOUBLE) * 1000) AS BIGINT) END AS low,
 CASE WHEN skill_id % 5 = 4 THEN NULL WHEN skill_id % 5 IN (2, 3) THEN CAST(floor(CAST(regexp_extract(pay, '^([0-9.]+)', 1) AS DOUBLE) * 1000) AS BIGINT) ELSE CAST(floor(CAST(regexp_extract(pay, '-([0-9]+)', 1) AS DOUBLE) * 1000) AS BIGINT) END AS high FROM t""")
def parse_salary(spark, sf):
    size = F.col("p_size")
    k = F.col("p_partkey") % 5
    pay = F.when(k == 0, F.concat(size, F.lit("-"), size + 10, F.lit("k"))).when(k == 1, F.concat(size, F.lit("-"), size + 5, F.lit("K·13薪"))).when(k == 2, F.concat(size, F.lit(".5K"))).when(k == 3, F.concat(size, F.lit("k-"), size + 10, F.lit("k"))).otherwise("1.5-2万")
    return R.read(spark, sf, "part").select(F.col("p_partkey").alias("skill_id"), S.salary(pay).alias("s")).select("skill_id", "s.low", "s.high")


@query("SELECT level, count(*) AS n FROM jobs GROUP BY 1")
def derive_level(spark, sf):
    return R.jobs(spark, sf).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT skill_id, CASE WHEN term LIKE '%bolt%' OR term LIKE '%widget%' THEN 'tool' WHEN term LIKE '%small%' THEN 'soft' WHEN term LIKE '%ring%' THEN 'domain' ELSE 'hard' END AS type FROM skills""")
def skill_type(spark, sf):
    return R.skills(spark, sf).select("skill_id", S.skill_type(F.col("term"), ("bolt", "widget"), ("small",), ("ring",)).alias("type"))


@query("""SELECT skill_id, CASE WHEN skill_id % 3 = 0 THEN l1 || '|' || l2 WHEN skill_id % 3 = 1 THEN l1 || '|' || l2 || '|x' ELSE '[' || l1 || '|' || l2 END AS items FROM skills""")
def parse_list(spark, sf):
    k = F.col("skill_id") % 3
    raw = F.when(k == 0, F.to_json(F.array("l1", "l2"))).when(k == 1, F.concat("l1", F.lit(", "), "l2", F.lit("，x,,"))).otherwise(F.concat(F.lit("["), "l1", F.lit(","), "l2"))
    return R.skills(spark, sf).select("skill_id", F.array_join(S.list_field(raw), "|").alias("items"))


@query(f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents")
def normalize_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(S.normalize_text(F.col("text"))).alias("digest"))


@query("SELECT resume_id, substr(name, 1, 3) || '***' || right(name, 2) AS masked FROM resumes")
def mask_key(spark, sf):
    return R.resumes(spark, sf).select("resume_id", S.mask_key(F.col("name")).alias("masked"))


@query(r"""t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS t FROM documents),
p AS (SELECT doc_id, t, nullif(strpos(lower(t), 'license'), 0) - 1 AS a, nullif(strpos(lower(t), 'reserved'), 0) - 1 AS b FROM t),
s AS (SELECT doc_id, t, greatest(0, coalesce(least(a, b), 0) - 40) AS s FROM p)
SELECT doc_id, substr(t, s + 1, 170) || CASE WHEN s + 170 < length(t) THEN '…' ELSE '' END AS snippet FROM s""")
def snippet(spark, sf):
    return documents(spark, sf).select("doc_id", S.snippet(F.col("text"), ["license", "Reserved"]).alias("snippet"))


# -- extraction

TERM_SQL = f"""dict AS (SELECT min(id) AS skill_id, n AS norm FROM (SELECT id, {norm('term')} AS n FROM ({values(TERMS)}) t(id, term)) GROUP BY n),
plain AS (SELECT doc_id, {norm('text')} AS t FROM documents),
hits AS (SELECT doc_id, skill_id, norm, t, strpos(' ' || t || ' ', ' ' || norm || ' ') AS pos FROM plain, dict WHERE contains(' ' || t || ' ', ' ' || norm || ' '))"""


@query(TERM_SQL + " SELECT doc_id, CAST(skill_id AS BIGINT) AS skill_id FROM hits")
def extract_terms(spark, sf):
    return extract.occurrences(documents(spark, sf), terms(spark, TERMS)).select("doc_id", "skill_id")


@query(TERM_SQL + ' SELECT doc_id, CAST(skill_id AS BIGINT) AS skill_id, CAST(pos AS BIGINT) AS pos, trim(substr(t, greatest(1, pos - 40), pos - greatest(1, pos - 40) + length(norm) + 40)) AS evidence FROM hits')
def extract_evidence(spark, sf):
    docs = documents(spark, sf)
    return extract.evidence(docs, extract.occurrences(docs, terms(spark, TERMS)))


@query()
def extract_exact(spark, sf):
    """Nested evidence in Python: rows only."""
    return extract.exact(documents(spark, sf), terms(spark, TERMS))


@query(f"""combos AS (SELECT * FROM ({values(COMBOS)}) t(id, term)),
atoms AS (SELECT id, {norm("unnest(regexp_split_to_array(term, '[/,，;；+、|]'))")} AS atom FROM combos),
parts AS (SELECT id, atom, FALSE AS w FROM atoms WHERE length(atom) >= 2 UNION ALL SELECT id, {norm('term')}, TRUE FROM combos),
plain AS (SELECT doc_id, {norm('text')} AS t FROM documents)
SELECT doc_id, CAST(id AS BIGINT) AS skill_id, bool_or(w) AS is_whole, count(*) AS parts FROM plain, parts WHERE contains(' ' || t || ' ', ' ' || atom || ' ') GROUP BY 1, 2""")
def extract_combination(spark, sf):
    return extract.combinations(documents(spark, sf), terms(spark, COMBOS))


METRIC_SQL = f"""plain AS (SELECT doc_id, {norm('text')} AS t FROM documents), units AS (SELECT unnest(['m', 'mm', 'cm', 'km', 'um', 'nm', 'inch', 'g', 'kg', 'mg', 't', 'lb', 'ms', 'us', 'ns', 'min', 'h', 'hz', 'khz', 'mhz', 'ghz', 'pa', 'kpa', 'mpa', 'bar', 'psi', 'n', 'kn', 'j', 'kj', 'w', 'kw', 'mw', 'v', 'kv', 'a', 'ma', 'ah', 'deg', 'rad', 'rpm', 'lux', 'k', 'lm', 'db', 'dbm', 'ppm']) AS unit),
wanted AS (SELECT id, string_agg(unit, '|') AS any_unit FROM (SELECT id, {norm('term')} AS n FROM ({values(METRICS)}) m(id, term)), units WHERE contains(n, unit) GROUP BY id)
SELECT doc_id, CAST(id AS BIGINT) AS skill_id FROM plain, wanted WHERE regexp_matches(t, '[0-9]+(\\.[0-9]+)?\\s*(' || any_unit || ')')"""


@query(METRIC_SQL)
def extract_metric(spark, sf):
    return extract.metrics(documents(spark, sf), terms(spark, METRICS))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def extract_incremental(spark, sf):
    return extract.incremental(documents(spark, sf), R.read(spark, sf, "labels")).select("doc_id")


# -- review


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected,
 round(count(*) FILTER (has_evidence) / count(*), 4) AS evidence_coverage FROM edges""")
def review_summary(spark, sf):
    return review.summary(R.edges(spark, sf))


@query("""SELECT job_id || '|' || skill_id AS target_id, company, term, round(confidence, 6) AS confidence FROM edges JOIN skills USING (skill_id) JOIN jobs USING (job_id)
 WHERE status = 'pending' ORDER BY edges.confidence DESC, job_id, skill_id LIMIT 200""")
def review_queue(spark, sf):
    return review.queue(R.edges(spark, sf), R.jobs(spark, sf), R.skills(spark, sf), 500).withColumn("confidence", F.round("confidence", 6))


DECISIONS = "decisions AS (SELECT job_id || '|' || skill_id AS target_id, 1 AS turn, 'approve' AS action FROM edges WHERE status = 'pending' UNION ALL SELECT job_id || '|' || skill_id, 2, 'reject' FROM edges WHERE status = 'pending' AND NOT has_evidence)"


def _decisions(spark, sf):
    pending = R.edges(spark, sf).filter("status = 'pending'")
    target = F.concat_ws("|", "job_id", "skill_id").alias("target_id")
    one = pending.select(target, F.lit(1).alias("turn"), F.lit("approve").alias("action"))
    return one.unionByName(pending.filter("NOT has_evidence").select(target, F.lit(2).alias("turn"), F.lit("reject").alias("action")))


@query(DECISIONS + """, last AS (SELECT target_id, max_by(action, turn) AS action FROM decisions GROUP BY 1)
SELECT job_id, skill_id, round(confidence, 6) AS confidence, status, CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE status END AS new_status
FROM edges LEFT JOIN last ON target_id = job_id || '|' || skill_id""")
def review_decide(spark, sf):
    return review.decide(R.edges(spark, sf), _decisions(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query(DECISIONS + " SELECT target_id, turn, action FROM decisions ORDER BY turn DESC, target_id DESC LIMIT 100")
def review_log(spark, sf):
    return review.log(_decisions(spark, sf), 100)


# -- vectors and clusters

FEATS = """feats AS (SELECT DISTINCT job_id, kw FROM (SELECT job_id, unnest([term, l2]) AS kw FROM edges JOIN skills USING (skill_id) WHERE status != 'rejected') WHERE kw NOT IN ('blue bolt', 'Brand#7')),
njobs AS (SELECT count(DISTINCT job_id) AS n FROM feats),
idf AS (SELECT kw, count(*) AS df, ln((SELECT n FROM njobs) / count(*)) AS idf FROM feats GROUP BY 1),
vecs AS (SELECT job_id, kw, idf AS w FROM feats JOIN idf USING (kw)),
norms AS (SELECT job_id, sqrt(sum(w * w)) AS norm, count(*) AS n FROM vecs GROUP BY 1)"""


def _features(spark, sf):
    return vectors.features(R.edges(spark, sf), R.skills(spark, sf), STOPWORDS)


@query(FEATS + " SELECT job_id, kw FROM feats")
def job_features(spark, sf):
    return _features(spark, sf)


@query(FEATS + " SELECT job_id, kw FROM feats WHERE kw NOT IN (SELECT kw FROM idf WHERE df > 0.08 * (SELECT n FROM njobs))")
def max_df_filter(spark, sf):
    return vectors.below_frequency(_features(spark, sf), 0.08).select("job_id", "kw")


@query(FEATS + " SELECT kw, df, round(idf, 6) AS idf FROM idf")
def idf(spark, sf):
    return vectors.idf(_features(spark, sf)).withColumn("idf", F.round("idf", 6))


@query(FEATS + " SELECT job_id, round(norm, 6) AS norm, n FROM norms")
def tfidf_norm(spark, sf):
    return vectors.norms(vectors.weighted(_features(spark, sf))).withColumn("norm", F.round("norm", 6))


#: Skills themselves are the features here: each stands in some thirty postings.
SKILL_VECS = """feats AS (SELECT job_id, skill_id AS kw FROM edges WHERE status != 'rejected'), njobs AS (SELECT count(DISTINCT job_id) AS n FROM feats),
idf AS (SELECT kw, ln((SELECT n FROM njobs) / count(*)) AS w FROM feats GROUP BY 1), vecs AS (SELECT job_id, kw, w FROM feats JOIN idf USING (kw)), norms AS (SELECT job_id, sqrt(sum(w * w)) AS norm FROM vecs GROUP BY 1)"""


def _skill_vectors(spark, sf):
    return vectors.weighted(R.edges(spark, sf).filter("status != 'rejected'").select("job_id", F.col("skill_id").alias("kw")))


@query(SKILL_VECS + """, dots AS (SELECT x.job_id AS a, y.job_id AS b, sum(x.w * y.w) AS dot, count(*) AS shared FROM vecs x JOIN vecs y ON x.kw = y.kw AND x.job_id < y.job_id GROUP BY 1, 2)
SELECT a, b, shared, round(dot / (na.norm * nb.norm), 6) AS cosine FROM dots JOIN norms na ON na.job_id = a JOIN norms nb ON nb.job_id = b WHERE round(dot / (na.norm * nb.norm), 9) >= 0.5""")
def pair_cosine(spark, sf):
    return vectors.pair_cosine(_skill_vectors(spark, sf), 0.5 - 5e-10).withColumn("cosine", F.round("cosine", 6))


@query()
def greedy_cluster(spark, sf):
    """Order-dependent rule: rows only."""
    return cluster.greedy_vectors(vectors.weighted(_features(spark, sf)))


PROFILE = """named AS (SELECT cluster_id, experience AS title, count(*) AS n FROM members JOIN jobs USING (job_id) GROUP BY 1, 2),
top AS (SELECT cluster_id, title FROM named QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length(title) DESC, title) = 1),
titles AS (SELECT cluster_id, array_to_string(list_sort(list(title))[1:3], '、') AS titles, sum(n)::BIGINT AS jobs FROM named GROUP BY 1),
kws AS (SELECT DISTINCT cluster_id, term AS kw FROM members JOIN edges USING (job_id) JOIN skills USING (skill_id) WHERE status = 'approved'),
words AS (SELECT cluster_id, list_sort(list(kw))[1:10] AS kw, list_sort(list(kw))[11:16] AS further, count(*) AS n_keywords FROM kws GROUP BY 1)"""


def _profile(spark, sf):
    kws = R.edges(spark, sf).filter("status = 'approved'").join(R.skills(spark, sf), "skill_id").select("job_id", F.col("term").alias("kw")).distinct()
    return cluster.profile(R.cluster_members(spark, sf), R.jobs(spark, sf).select("job_id", F.col("experience").alias("title")), kws)


@query(PROFILE + " SELECT cluster_id, title AS name, titles, jobs, array_to_string(kw, ',') AS keywords, n_keywords FROM top JOIN titles USING (cluster_id) LEFT JOIN words USING (cluster_id)")
def cluster_profile(spark, sf):
    return _profile(spark, sf).drop("further")


@query(PROFILE + " SELECT cluster_id, '以' || title || '为代表的岗位集合，核心技能包括' || coalesce(array_to_string(kw[1:5], ', '), '无明确关键词') || '。' AS description FROM top LEFT JOIN words USING (cluster_id)")
def cluster_description(spark, sf):
    return cluster.described(_profile(spark, sf))


CLASSES = """rows AS (SELECT cluster_id, job_id, l1, l2 FROM members JOIN edges USING (job_id) JOIN skills USING (skill_id) WHERE status != 'rejected'),
size AS (SELECT cluster_id, count(*) AS jobs FROM members GROUP BY 1),
t1 AS (SELECT cluster_id, l1 FROM rows GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, l1) = 1),
t2 AS (SELECT cluster_id, l2, count(*) AS n FROM rows GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, l2) = 1),
al AS (SELECT cluster_id, count(DISTINCT job_id) AS n FROM rows WHERE l2 != '' GROUP BY 1)"""


@query(PROFILE + ", " + CLASSES + """ SELECT cluster_id, title, '围绕' || coalesce(l2, '该领域') || '方向开展专业工作；完成岗位相关的技术方案落地与交付；与团队协作推进项目迭代优化' AS duties, coalesce(array_to_string(kw[1:8], ','), '') AS required, coalesce(array_to_string(further, ','), '') AS bonus,
 replace(titles, '、', '；') AS scenarios, 'pending' AS review_status FROM top JOIN titles USING (cluster_id) LEFT JOIN words USING (cluster_id) LEFT JOIN t2 USING (cluster_id)""")
def definition_heuristic(spark, sf):
    return cluster.definition(_profile(spark, sf), cluster.classify(R.cluster_members(spark, sf), R.edges(spark, sf), R.skills(spark, sf)))


@query(CLASSES + """ SELECT cluster_id, jobs, coalesce(l1, '') AS l1, coalesce(l2, '') AS l2, round(coalesce(t2.n / jobs, 0.0), 4) AS coverage, round(coalesce(al.n / jobs, 0.0), 4) AS ratio
FROM size LEFT JOIN t1 USING (cluster_id) LEFT JOIN t2 USING (cluster_id) LEFT JOIN al USING (cluster_id)""")
def cluster_classify(spark, sf):
    return cluster.classify(R.cluster_members(spark, sf), R.edges(spark, sf), R.skills(spark, sf))


@query("""rows AS (SELECT cluster_id, l2, count(*) AS n FROM members JOIN edges USING (job_id) JOIN skills USING (skill_id) WHERE status != 'rejected' GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, l2) AS place FROM rows)
SELECT cluster_id, '{' || string_agg('"' || l2 || '":' || n, ',' ORDER BY place) || '}' AS distribution FROM best WHERE place <= 10 GROUP BY 1""")
def cluster_distribution(spark, sf):
    return cluster.distribution(R.cluster_members(spark, sf), R.edges(spark, sf), R.skills(spark, sf), "l2")


# -- matching

MATCH = """rv AS (SELECT resume_id, skill_id, confidence AS w FROM resume_skills WHERE confidence > 0), rl AS (SELECT resume_id, sqrt(sum(w * w)) AS len, count(*) AS nr FROM rv GROUP BY 1),
jv AS (SELECT job_id, skill_id, confidence AS w FROM edges WHERE confidence > 0), jl AS (SELECT job_id, sqrt(sum(w * w)) AS len, count(*) AS nj FROM jv GROUP BY 1),
rd AS (SELECT resume_id, l1, sum(w) AS w FROM rv JOIN skills USING (skill_id) GROUP BY 1, 2), rdl AS (SELECT resume_id, sqrt(sum(w * w)) AS len FROM rd GROUP BY 1),
jd AS (SELECT job_id, l1, sum(w) AS w FROM jv JOIN skills USING (skill_id) GROUP BY 1, 2), jdl AS (SELECT job_id, sqrt(sum(w * w)) AS len FROM jd GROUP BY 1),
pairs AS (SELECT resume_id, job_id, sum(rv.w * jv.w) AS dot, count(*) AS n_shared FROM rv JOIN jv USING (skill_id) GROUP BY 1, 2),
doms AS (SELECT pairs.resume_id, pairs.job_id, sum(rd.w * jd.w) AS dot FROM pairs JOIN rd USING (resume_id) JOIN jd ON jd.job_id = pairs.job_id AND jd.l1 = rd.l1 GROUP BY 1, 2),
parts AS (SELECT resume_id, job_id, coalesce(jobs.experience, '') AS title, n_shared, nr, nj, greatest(0, least(1, pairs.dot / (rl.len * jl.len))) AS capability, greatest(0, least(1, coalesce(doms.dot / (rdl.len * jdl.len), 0))) AS l1_score, n_shared / (nr + nj - n_shared) AS jaccard
 FROM pairs JOIN rl USING (resume_id) JOIN jl USING (job_id) JOIN rdl USING (resume_id) JOIN jdl USING (job_id) JOIN jobs USING (job_id) LEFT JOIN doms USING (resume_id, job_id)),
scored AS (SELECT resume_id, job_id, round((0.5 * capability + 0.2 * l1_score + 0.2 * jaccard) / 0.9, 4) AS score, round(capability, 4) AS capability, round(l1_score, 4) AS l1_score, round(jaccard, 4) AS jaccard,
 round(least(1.0, nr / 8), 2) AS coverage, title, n_shared, nj - n_shared AS n_missing, CASE WHEN nj <= 0 THEN 'minor' WHEN (nj - n_shared) / nj >= 0.6 THEN 'severe' WHEN (nj - n_shared) / nj >= 0.3 THEN 'moderate' ELSE 'minor' END AS severity FROM parts),
best AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY score DESC, title, job_id) AS place FROM scored QUALIFY place <= 10)"""


def _sides(spark, sf):
    """Résumés' skills, postings' skills, skills; the matching takes the best confidence of each itself."""
    return R.resume_mentions(spark, sf), R.mentions(spark, sf), R.skills(spark, sf)


def _titles(spark, sf):
    return R.jobs(spark, sf).select("job_id", F.col("experience").alias("title"))


@query(MATCH + " SELECT resume_id, job_id, score, capability, l1_score, jaccard FROM scored")
def match_components(spark, sf):
    return match.scores(*_sides(spark, sf), titles=_titles(spark, sf))


@query(MATCH + " SELECT resume_id, job_id, place, score, coverage, n_shared, n_missing, severity FROM best")
def match_top_n(spark, sf):
    return match.best(*_sides(spark, sf), _titles(spark, sf)).select("resume_id", "job_id", "place", "score", "coverage", "n_shared", "n_missing", "severity")


@query(MATCH + """, top3 AS (SELECT resume_id, job_id FROM best WHERE place <= 3),
mixed AS (SELECT resume_id, job_id, skill_id, r.confidence AS cr, NULL AS cj FROM top3 JOIN resume_skills r USING (resume_id) UNION ALL SELECT resume_id, job_id, skill_id, NULL, e.confidence FROM top3 JOIN edges e USING (job_id)),
rows AS (SELECT resume_id, job_id, skill_id, max(cr) AS cr, max(cj) AS cj FROM mixed GROUP BY 1, 2, 3),
ranked AS (SELECT *, CASE WHEN cr IS NULL THEN 'missing' WHEN cj IS NULL THEN 'extra' ELSE 'shared' END AS kind, row_number() OVER (PARTITION BY resume_id, job_id, kind ORDER BY coalesce(cj, cr) DESC, skill_id) AS place FROM rows)
SELECT resume_id, job_id, coalesce(string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY place) FILTER (kind = 'shared'), '') AS shared, coalesce(string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY place) FILTER (kind = 'missing'), '') AS missing,
 coalesce(string_agg(CAST(skill_id AS VARCHAR), ',' ORDER BY place) FILTER (kind = 'extra'), '') AS extra FROM ranked WHERE place <= 10 GROUP BY 1, 2""")
def match_gaps(spark, sf):
    return match.best_gaps(*_sides(spark, sf), _titles(spark, sf), 3)


@query(MATCH + " SELECT severity, count(*) AS n FROM scored GROUP BY 1")
def match_severity(spark, sf):
    return match.severities(*_sides(spark, sf), _titles(spark, sf))


@query(MATCH + """, dom AS (SELECT job_id FROM (SELECT job_id, l1, row_number() OVER (PARTITION BY job_id ORDER BY round(w / len, 9) DESC, l1) AS p FROM jd JOIN jdl USING (job_id)) WHERE p = 1 AND l1 = 'PROMO')
SELECT resume_id, job_id, score FROM scored WHERE job_id IN (SELECT job_id FROM dom)""")
def match_l1_filter(spark, sf):
    return match.scores(*_sides(spark, sf), "PROMO", _titles(spark, sf), ())


@query("SELECT resume_id, 'no skills' AS warning FROM resumes WHERE resume_id NOT IN (SELECT resume_id FROM resume_skills)")
def match_empty(spark, sf):
    return match.without_skills(R.resumes(spark, sf), R.resume_skills(spark, sf))


@query()
def title_ratio(spark, sf):
    """difflib's ratio: rows only."""
    names = R.skills(spark, sf).select("term").distinct()
    other = names.select(F.col("term").alias("other"))
    pairs = names.join(other, (F.substring_index("term", " ", -1) == F.substring_index("other", " ", -1)) & (F.col("term") < F.col("other")))
    return pairs.select("term", "other", F.round(match.title_ratio("term", "other"), 6).alias("ratio"))


@query(MATCH + """, first AS (SELECT score FROM best WHERE place = 1), n AS (SELECT count(*) AS sample FROM resumes), hit AS (SELECT count(*) AS match_hit FROM first),
med AS (SELECT score AS top1_median FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS k FROM first) WHERE i = k // 2)
SELECT sample, match_hit, round(match_hit / sample, 6) AS hit_rate, top1_median, (SELECT max(score) FROM first) AS top1_max FROM n, hit, med""")
def match_hit_rate(spark, sf):
    return evaluate.hits(match.best(*_sides(spark, sf), _titles(spark, sf), 1), R.resumes(spark, sf))


@query(MATCH + " SELECT score AS median FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM best WHERE place = 1) WHERE i = n // 2")
def match_median(spark, sf):
    best = match.best(*_sides(spark, sf), _titles(spark, sf), 1)
    return evaluate.upper_median(best, "score")


# -- snapshots


@query("""SELECT job_id, '[' || string_agg('{"skill_id":' || skill_id || ',"confidence":"' || printf('%.2f', confidence) || '","status":"' || status || '"}', ',' ORDER BY skill_id) || ']' AS payload, count(*) AS n FROM edges GROUP BY 1""")
def snapshot_payload(spark, sf):
    return evolve.payload(R.edges(spark, sf))


SNAPS = """base AS (SELECT l_orderkey AS job_id, l_partkey AS skill_id, max(round(0.95 - l_discount, 2)) AS confidence, min(l_linestatus) AS evidence FROM lineitem WHERE l_linenumber % 3 != 0 GROUP BY 1, 2),
fresh AS (SELECT l_orderkey AS job_id, l_partkey AS skill_id, max(round(0.95 - l_tax, 2)) AS confidence, max(l_linestatus) AS evidence FROM lineitem WHERE l_linenumber % 3 != 1 GROUP BY 1, 2),
changes AS (SELECT coalesce(b.job_id, f.job_id) AS job_id, coalesce(b.skill_id, f.skill_id) AS skill_id, CASE WHEN b.job_id IS NULL THEN 'added' WHEN f.job_id IS NULL THEN 'removed' WHEN abs(b.confidence - f.confidence) > 1e-6 OR b.evidence != f.evidence THEN 'modified' END AS change, b.confidence AS cb, f.confidence AS cn
 FROM base b FULL JOIN fresh f ON b.job_id = f.job_id AND b.skill_id = f.skill_id WHERE change IS NOT NULL)"""


def _changes(spark, sf):
    li = R.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id"), "l_linenumber", "l_discount", "l_tax", "l_linestatus")
    base = li.filter("l_linenumber % 3 != 0").groupBy("job_id", "skill_id").agg(F.max(F.round(0.95 - F.col("l_discount"), 2)).alias("confidence"), F.min("l_linestatus").alias("evidence"))
    new = li.filter("l_linenumber % 3 != 1").groupBy("job_id", "skill_id").agg(F.max(F.round(0.95 - F.col("l_tax"), 2)).alias("confidence"), F.max("l_linestatus").alias("evidence"))
    return evolve.difference(base, new)


@query(SNAPS + " SELECT job_id, skill_id, change, round(cb, 6) AS cb, round(cn, 6) AS cn FROM changes")
def snapshot_diff(spark, sf):
    return _changes(spark, sf).select("job_id", "skill_id", "change", F.round("cb", 6).alias("cb"), F.round("cn", 6).alias("cn"))


@query(SNAPS + """, lists AS (SELECT job_id, count(*) AS n, list(skill_id ORDER BY skill_id) FILTER (change = 'added') AS a, list(skill_id ORDER BY skill_id) FILTER (change = 'removed') AS r, list(skill_id ORDER BY skill_id) FILTER (change = 'modified') AS m FROM changes GROUP BY 1)
SELECT job_id, concat_ws('；', '新增能力 ' || len(a) || ' 项（' || array_to_string(a[1:5], '、') || CASE WHEN len(a) > 5 THEN '等' ELSE '' END || '）', '移除能力 ' || len(r) || ' 项（' || array_to_string(r[1:5], '、') || CASE WHEN len(r) > 5 THEN '等' ELSE '' END || '）', '置信度/证据更新 ' || len(m) || ' 项') AS note, n FROM lists""")
def update_note(spark, sf):
    return evolve.notes(_changes(spark, sf))


# -- emerging roles

EVENTS = "ev AS (SELECT event_id, user_id AS technology, CAST(ts AS DATE) AS date, event_type AS type, least(1.0, value / 100) AS relevance FROM events)"
EVENT_WEIGHT = "CASE type WHEN 'view' THEN 0.45 WHEN 'click' THEN 0.55 WHEN 'signup' THEN 0.76 WHEN 'purchase' THEN 0.84 ELSE 0.40 END"
MATURITY = EVENTS + f", mat AS (SELECT technology, count(*) AS n_events, round(least(0.98, 1 - exp(-0.12 * sum({EVENT_WEIGHT} * relevance * exp(-0.11 * (DATE '{EVENT_DAY}' - date) / 365.25)))), 4) AS maturity FROM ev WHERE date <= DATE '{EVENT_DAY}' GROUP BY 1)"


def _events(spark, sf):
    return R.read(spark, sf, "events").select("event_id", F.col("user_id").alias("technology"), F.to_date("ts").alias("date"), F.col("event_type").alias("type"), F.least(F.lit(1.0), F.col("value") / 100).alias("relevance"))


@query(MATURITY + " SELECT technology, n_events, maturity FROM mat")
def maturity(spark, sf):
    return emerging.maturity(_events(spark, sf), F.lit(EVENT_DAY).cast("date"), WEIGHTS)


@query(EVENTS + f""", parts AS (SELECT technology, event_id, round({EVENT_WEIGHT} * relevance * exp(-0.11 * (DATE '{EVENT_DAY}' - date) / 365.25), 4) AS part FROM ev WHERE date <= DATE '{EVENT_DAY}')
SELECT technology, event_id, part, row_number() OVER (PARTITION BY technology ORDER BY part DESC, event_id) AS place FROM parts QUALIFY place <= 12""")
def milestone_contributions(spark, sf):
    return emerging.contributions(_events(spark, sf), F.lit(EVENT_DAY).cast("date"), 12, WEIGHTS)


SQUEEZED = "lower(regexp_replace({0}, '[^A-Za-z0-9一-鿿]+', '', 'g'))"
NAMES = "(SELECT technology, term FROM (" + values([("T1", "license及rights"), ("T1", "Reserved!"), ("T10.2", "signup"), ("T10.2", "the an"), ("T3", "nosuchterm"), ("T3", "x")]) + ") n(technology, term))"
CODES = "(" + values([("T1", "T1"), ("T10.2", "T10"), ("T3", "T3")]) + ")"
LINKS = EVENTS + f""", links AS (SELECT event_id, unnest(['T' || user_id % 12 || '.' || user_id % 3, 'T' || user_id % 5]) AS code, unnest([1.0, 0.4]) AS weight FROM events),
codes AS (SELECT * FROM {CODES} c(technology, own)),
told AS (SELECT event_id, technology, 0.72 AS weight FROM events, (SELECT DISTINCT technology, {SQUEEZED.format('term')} AS term FROM {NAMES}) n WHERE n.term != '' AND contains({SQUEEZED.format("event_type || ' ' || props")}, n.term)),
linked AS (SELECT event_id, technology, round(CAST(max(weight) AS DOUBLE), 3) AS relevance FROM (SELECT event_id, technology, weight FROM links, codes WHERE starts_with(code, own) OR starts_with(own, code) UNION ALL SELECT * FROM told) GROUP BY 1, 2)"""


def _technologies_(spark):
    rows = [("T1", "L2", "", "license及rights", ["Reserved!"]), ("T10.2", "L3", "T10", "signup", ["the an"]), ("T3", "L2", None, "nosuchterm", ["x"])]
    return spark.createDataFrame(rows, "technology string, level string, parent string, name string, aliases array<string>")


def _milestones(spark, sf):
    u = F.col("user_id")
    links = F.array(F.struct(F.concat(F.lit("T"), u % 12, F.lit("."), u % 3).alias("code"), F.lit(1.0).alias("weight")), F.struct(F.concat(F.lit("T"), u % 5).alias("code"), F.lit(0.4).alias("weight")))
    return R.read(spark, sf, "events").select("event_id", F.to_date("ts").alias("date"), F.col("event_type").alias("type"), links.alias("links"), F.concat_ws(" ", "event_type", "props").alias("text"))


@query(LINKS + " SELECT event_id, technology, relevance FROM linked")
def milestone_links(spark, sf):
    return emerging.linked(_milestones(spark, sf), _technologies_(spark))


@query(LINKS + """, placed AS (SELECT l.technology, l.event_id, e.date, l.relevance, row_number() OVER (PARTITION BY l.technology ORDER BY e.date DESC, l.relevance DESC, l.event_id) AS place FROM linked l JOIN ev e USING (event_id))
SELECT technology, event_id, CAST(date AS VARCHAR) AS date, relevance, place FROM placed WHERE place <= 50""")
def milestones_latest(spark, sf):
    m = _milestones(spark, sf)
    return emerging.milestones_of(emerging.linked(m, _technologies_(spark)), m, 50).select("technology", "event_id", F.col("date").cast("string").alias("date"), "relevance", "place")


TECH_NAMES = values([("T1", "license及rights"), ("T1", "Reserved!"), ("T1", "license"), ("T1", "rights"), ("T10.2", "signup"), ("T10.2", "the an"), ("T3", "nosuchterm"), ("T3", "x")])
RELATED = f"""names AS (SELECT DISTINCT technology, {SQUEEZED.format('term')} AS term FROM ({TECH_NAMES}) n(technology, term)),
hits AS (SELECT doc_id, technology, list_sort(list(DISTINCT term)) AS terms FROM documents, names WHERE length(term) >= 2 AND contains({SQUEEZED.format("coalesce(text, '')")}, term) GROUP BY 1, 2),
scored AS (SELECT technology, doc_id, CAST(len(terms) AS INT) AS n_terms, array_to_string(terms[1:5], ',') AS matched, round(least(1.0, 0.5 + 0.12 * len(terms)), 3) AS confidence FROM hits),
related AS (SELECT *, row_number() OVER (PARTITION BY technology ORDER BY confidence DESC, doc_id) AS place FROM scored QUALIFY place <= 600)"""


def _texts(spark, sf):
    return R.read(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("company"), F.concat_ws(" ", "source", "lang").alias("title"))


@query(RELATED + " SELECT technology, doc_id, n_terms, matched, CAST(confidence AS DOUBLE) AS confidence, place FROM related")
def related_docs(spark, sf):
    return emerging.recalled(_texts(spark, sf), _technologies_(spark))


LIBRARY = [("T1", 1, "{技术} model", "model", ["license", "version"], 0.9), ("T1", 2, "{技术} check", "evaluation", ["reserved"], 0.8), ("T1", 3, "{技术} data", "data", ["nosuchkeyword"], 0.7), ("fallback", 1, "{技术} plan", "planning", ["the"], 0.85), ("fallback", 2, "{技术} model", "model", ["and", "that"], 0.75)]
KEYWORDS = values([(c, i, k) for c, i, _, _, ks, _ in LIBRARY for k in ks])
SPECS = values([(c, i, n, g, r) for c, i, n, g, _, r in LIBRARY])
ROOTS = values([("T1", "T1", "license及rights"), ("T10.2", "fallback", "signup"), ("T3", "fallback", "nosuchterm")])
COVER = RELATED + "," + LINKS + f""", dated AS (SELECT linked.technology, ev.type, linked.relevance, ev.date FROM linked JOIN ev USING (event_id)),
growth AS (SELECT technology, count(*) AS milestones, round(least(0.98, 1 - exp(-0.12 * coalesce(sum({EVENT_WEIGHT} * relevance * exp(-0.11 * (DATE '{EVENT_DAY}' - date) / 365.25)) FILTER (date <= DATE '{EVENT_DAY}'), 0))), 4) AS maturity FROM dated GROUP BY 1),
roots AS (SELECT * FROM ({ROOTS}) r(technology, code, name)),
grown AS (SELECT technology, code, name, coalesce(milestones, 0) AS milestones, coalesce(maturity, 0) AS maturity, greatest(0.35, coalesce(maturity, 0)) AS factor FROM roots LEFT JOIN growth USING (technology)),
specs AS (SELECT technology, task, replace(s.name, '{{技术}}', r.name) AS task_name, task_group, relevance FROM ({SPECS}) s(code, task, name, task_group, relevance) JOIN roots r USING (code)),
words AS (SELECT technology, task, keyword FROM ({KEYWORDS}) k(code, task, keyword) JOIN roots USING (code)),
found AS (SELECT technology, task, related.doc_id, any_value(coalesce(source, '')) AS company, any_value(place) AS place FROM related JOIN documents USING (doc_id) JOIN words USING (technology) WHERE contains(lower(coalesce(text, '')), keyword) GROUP BY 1, 2, 3),
cov AS (SELECT technology, task, count(*) AS m, count(DISTINCT company) AS c, (list(doc_id ORDER BY place))[1:4] AS jobs FROM found GROUP BY 1, 2),
graded AS (SELECT technology, task, task_name, task_group, CAST(relevance AS DOUBLE) AS relevance, milestones, maturity, factor, name, coalesce(m, 0) AS m, coalesce(c, 0) AS c, coalesce(jobs, []) AS jobs,
 least(0.88, (1 - exp(-coalesce(m, 0) / 8)) * 0.86) AS coverage, least(1.0, coalesce(c, 0) / 7) AS "cross", least(1.0, 0.52 + least(0.24, milestones / 120) + least(0.2, coalesce(m, 0) / 35)) AS evidence FROM specs JOIN grown USING (technology) LEFT JOIN cov USING (technology, task)),
gaps AS (SELECT *, relevance * factor * (1 - coverage) * evidence * (0.58 + 0.42 * "cross") AS gap FROM graded)"""


def _library(spark):
    return spark.createDataFrame(LIBRARY, "code string, place int, name string, task_group string, keywords array<string>, relevance double")


@query(COVER + ' SELECT technology, task, m, c, milestones, maturity, round(coverage, 4) AS coverage, round("cross", 4) AS "cross", round(evidence, 4) AS evidence, round(gap, 4) AS gap FROM gaps')
def task_gap(spark, sf):
    tech, m = _technologies_(spark), _milestones(spark, sf)
    links = emerging.linked(m, tech)
    grown = links.groupBy("technology").agg(F.count(F.lit(1)).alias("milestones")).join(emerging.maturity(links.join(m.select("event_id", "date", "type"), "event_id"), F.lit(EVENT_DAY).cast("date"), WEIGHTS).select("technology", "maturity"), "technology", "left")
    codes = emerging.with_fallback(tech.select(F.coalesce(F.nullif("parent", F.lit("")), "technology").alias("code")), _library(spark))
    specs = tech.select("technology", F.coalesce(F.nullif("parent", F.lit("")), "technology").alias("code")).join(codes, "code").select("technology", F.col("place").alias("task"), "keywords", "relevance")
    cover = emerging.covered(emerging.covering(emerging.recalled(_texts(spark, sf), tech), _texts(spark, sf), specs))
    rows = specs.join(cover, ["technology", "task"], "left").join(grown, "technology", "left")
    rows = rows.withColumns({"m": F.coalesce("m", F.lit(0)), "c": F.coalesce("c", F.lit(0)), "milestones": F.coalesce("milestones", F.lit(0)), "maturity": F.coalesce("maturity", F.lit(0.0))})
    rows = rows.withColumns(emerging.gap(F.col("m"), F.col("c"), F.col("milestones"), F.col("relevance"), emerging.grade(F.col("maturity"))))
    return rows.select("technology", "task", "m", "c", "milestones", "maturity", *(F.round(x, 4).alias(x) for x in ("coverage", "cross", "evidence", "gap")))


def _edit_ratio(a, b):
    """1 less the edit distance over the longer length, of the ASCII characters: a similarity that SQL has too."""
    a, b = (F.regexp_replace(x, "[^ -~]", "") for x in (a, b))
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


TITLES = [("T1", "model", "web en"), ("T1", "evaluation", "News Evaluation")]
CAPABILITIES = [("T1", 0, "{技术} sensing", "factory"), ("T1", 1, "{技术} control", ""), ("fallback", 0, "{技术} base", "lab")]
RUN = COVER + f""", named AS (SELECT DISTINCT technology, task_group, coalesce(title, name || upper(task_group[1]) || task_group[2:] || '工程师') AS title FROM graded LEFT JOIN ({values(TITLES)}) t(technology, task_group, title) USING (technology, task_group)),
existing AS (SELECT DISTINCT technology, source || ' ' || lang AS existing FROM related JOIN documents USING (doc_id) WHERE place <= 300),
overlap AS (SELECT technology, task_group, max(1 - levenshtein(a, b) / greatest(length(a), length(b))) AS overlap FROM (SELECT technology, task_group, regexp_replace(title, '[^ -~]', '', 'g') AS a, regexp_replace(existing, '[^ -~]', '', 'g') AS b FROM named JOIN existing USING (technology)) GROUP BY 1, 2),
groups AS (SELECT technology, task_group, min(task) AS turn, any_value(name) AS name, any_value(maturity) AS maturity, any_value(factor) AS factor, avg(round(gap, 4)) AS gap, avg(round("cross", 4)) AS "cross", avg(round(evidence, 4)) AS evidence, avg(relevance) AS relevance, count(*) AS n,
 array_to_string(list(task_name ORDER BY task), '；') AS responsibilities, array_to_string(flatten(list(jobs[1:2] ORDER BY task))[1:4], ',') AS jobs FROM gaps GROUP BY 1, 2),
sc AS (SELECT groups.*, title, coalesce(overlap, 0) AS overlap, least(0.96, 0.70 + 0.08 * n) AS cohesion, row_number() OVER (PARTITION BY technology ORDER BY turn) AS place FROM groups JOIN named USING (technology, task_group) LEFT JOIN overlap USING (technology, task_group)),
done AS (SELECT *, round(100 * (0.20 * relevance + 0.25 * gap + 0.15 * cohesion + 0.10 * "cross" + 0.10 * factor + 0.10 * evidence + 0.10 * (1 - overlap)), 1) AS score FROM sc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY technology ORDER BY score DESC, place) AS rank FROM done QUALIFY rank <= 5)"""


def _candidates(spark, sf):
    titles = spark.createDataFrame(TITLES, "code string, task_group string, title string")
    caps = spark.createDataFrame(CAPABILITIES, "code string, place int, name string, scenario string")
    return emerging.run(_technologies_(spark), _milestones(spark, sf), _texts(spark, sf), _library(spark), titles, caps, F.lit(EVENT_DAY).cast("date"), weights=WEIGHTS, ratio=_edit_ratio)


@query(RUN + """ SELECT technology, task_group, rank, 'CAND-' || replace(technology, '.', '') || '-' || lpad(CAST(place AS VARCHAR), 2, '0') AS candidate_id, title, score,
 CASE WHEN overlap >= 0.76 THEN '已有岗位' WHEN overlap >= 0.56 THEN '岗位演化' ELSE '新兴岗位' END AS kind, CASE WHEN maturity >= 0.55 THEN '1-3年' ELSE '3-5年' END AS horizon, round(gap, 4) AS gap, round(overlap, 4) AS overlap, n, responsibilities, jobs,
 CASE technology WHEN 'T1' THEN 'factory' ELSE 'lab' END AS scenarios,
 name || '>' || CASE WHEN technology = 'T1' AND place % 2 = 1 THEN name || ' sensing' WHEN technology = 'T1' THEN name || ' control' ELSE name || ' base' END || '>' || split_part(responsibilities, '；', 1) || '>' || title AS path,
 '具身智能,数据分析,系统工程,' || CASE task_group WHEN 'data' THEN '数据工程' WHEN 'model' THEN '模型训练' WHEN 'evaluation' THEN '评测体系设计' WHEN 'planning' THEN '运动规划' ELSE '推理部署' END AS skills FROM ranked""")
def emerging_run(spark, sf):
    found = _candidates(spark, sf)
    joined = lambda c, mark: F.array_join(F.transform(c, lambda x: x.cast("string")), mark)
    return found.select(
        "technology", "task_group", "rank", "candidate_id", "title", "score", "kind", "horizon", "gap", "overlap", "n", joined("responsibilities", "；").alias("responsibilities"), joined("jobs", ",").alias("jobs"),
        joined("scenarios", ",").alias("scenarios"), F.array_join(F.transform("path", lambda s: s["label"]), ">").alias("path"), joined("required_skills", ",").alias("skills"),
    )


@query(RUN + " SELECT technology, score, rank, candidate_id FROM (SELECT technology, score, rank, 'CAND-' || replace(technology, '.', '') || '-' || lpad(CAST(place AS VARCHAR), 2, '0') AS candidate_id FROM ranked)")
def candidate_score(spark, sf):
    return _candidates(spark, sf).select("technology", "score", "rank", "candidate_id")


@query(RUN + " SELECT technology, round(avg(round(evidence, 4)), 4) AS evidence, round(avg(round(cohesion, 4)), 4) AS cohesion, round(avg(round(overlap, 4)), 4) AS overlap, count(*) AS candidates FROM ranked GROUP BY 1")
def emerging_means(spark, sf):
    return emerging.means(_candidates(spark, sf))


@query(RUN + " SELECT candidate_id, title AS job_name, duties, review_status FROM (SELECT 'CAND-' || replace(technology, '.', '') || '-' || lpad(CAST(place AS VARCHAR), 2, '0') AS candidate_id, title, responsibilities AS duties, 'pending' AS review_status FROM ranked) WHERE candidate_id = 'CAND-T1-02'")
def emerging_submit(spark, sf):
    found = _candidates(spark, sf).filter("candidate_id = 'CAND-T1-02'")
    return found.select("candidate_id", F.col("title").alias("job_name"), F.array_join("responsibilities", "；").alias("duties"), F.lit("pending").alias("review_status"))


def _technologies(spark, sf):
    return R.skills(spark, sf).select(F.col("skill_id").alias("technology"), F.col("term").alias("name"), F.lit(1).alias("level"), F.concat_ws(" ", "l1", "l2").alias("text"))


@query(f"""t AS (SELECT skill_id AS technology, {SQUEEZED.format('term')} AS n, {SQUEEZED.format("l1 || ' ' || l2")} AS x FROM skills),
s AS (SELECT technology, CASE WHEN n = 'redwidget' THEN 1.0 WHEN contains(n, 'redwidget') OR contains('redwidget', n) THEN 0.94 WHEN contains(x, 'redwidget') THEN 0.86 ELSE 0.0 END AS score FROM t)
SELECT technology, CAST(round(score, 4) AS DOUBLE) AS score FROM s WHERE score >= 0.34 ORDER BY score DESC, technology LIMIT 8""")
def tech_search(spark, sf):
    return emerging.search(_technologies(spark, sf), "Red Widget", fuzzy=False).select("technology", "score")


@query()
def tech_search_fuzzy(spark, sf):
    """With difflib's ratio: rows only."""
    return emerging.search(_technologies(spark, sf), "reed widgets").select("technology", "score")


@query(f"""lib AS (SELECT * FROM ({values([('Brand#1', 'a'), ('Brand#2', 'b'), ('fallback', 'x'), ('fallback', 'y')])}) t(code, name)), codes AS (SELECT DISTINCT l2 AS code FROM skills)
SELECT code, name FROM codes JOIN lib USING (code) UNION ALL SELECT c.code, l.name FROM codes c, lib l WHERE l.code = 'fallback' AND c.code NOT IN (SELECT code FROM lib)""")
def library_fallback(spark, sf):
    lib = spark.createDataFrame([("Brand#1", "a"), ("Brand#2", "b"), ("fallback", "x"), ("fallback", "y")], "code string, name string")
    return emerging.with_fallback(R.skills(spark, sf).select(F.col("l2").alias("code")).distinct(), lib)


# -- evaluation

PRED = "pred AS (SELECT doc_id FROM documents WHERE n_chars >= 500), truth AS (SELECT doc_id FROM labels WHERE quality = 1)"


@query(PRED + """, c AS (SELECT (SELECT count(*) FROM truth WHERE doc_id IN (SELECT doc_id FROM pred)) AS tp, (SELECT count(*) FROM pred WHERE doc_id NOT IN (SELECT doc_id FROM truth)) AS fp, (SELECT count(*) FROM truth WHERE doc_id NOT IN (SELECT doc_id FROM pred)) AS fn)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""")
def eval_prf(spark, sf):
    predicted = R.read(spark, sf, "documents").filter("n_chars >= 500").select("doc_id")
    return evaluate.micro(R.read(spark, sf, "labels").filter("quality = 1"), predicted, ["doc_id"])


@query(TERM_SQL + """, gold AS (SELECT doc_id, skill_id FROM labels, dict WHERE skill_id <= 4), c AS (SELECT count(*) AS gold, count(hits.doc_id) AS found FROM gold LEFT JOIN hits USING (doc_id, skill_id))
SELECT gold, found, round(found / gold, 6) AS recall FROM c""")
def eval_in_text_recall(spark, sf):
    gold = R.read(spark, sf, "labels").select("doc_id").join(F.broadcast(extract.dictionary(terms(spark, TERMS)).filter("skill_id <= 4").select("skill_id")), F.lit(True))
    found = extract.occurrences(documents(spark, sf), terms(spark, TERMS)).select("doc_id", "skill_id", F.lit(1).alias("hit"))
    one = gold.join(found, ["doc_id", "skill_id"], "left").agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found"))
    return one.select("gold", "found", F.round(evaluate.ratio(F.col("found"), F.col("gold")), 6).alias("recall"))


# -- companies


@query("""own AS (SELECT DISTINCT company, skill_id FROM edges JOIN jobs USING (job_id) WHERE status = 'approved')
SELECT a.company AS a, b.company AS b, count(*) AS shared FROM own a JOIN own b ON a.skill_id = b.skill_id AND a.company < b.company GROUP BY 1, 2 HAVING count(*) >= 2""")
def company_pairs(spark, sf):
    own = R.edges(spark, sf).filter("status = 'approved'").join(R.jobs(spark, sf).select("job_id", "company"), "job_id")
    return graph.sharing_pairs(own, "company", "skill_id")


@query("SELECT title AS value, count(*) AS n FROM resumes GROUP BY 1")
def company_facets(spark, sf):
    return graph.facets(R.resumes(spark, sf), "title")


# -- validation and DML


@query("SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)")
def orphan_check(spark, sf):
    li = R.read(spark, sf, "lineitem")
    a = ingest.orphans(li, R.read(spark, sf, "orders"), "l_orderkey", "o_orderkey")
    b = ingest.orphans(li.join(R.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi"), R.read(spark, sf, "part").filter("p_size <= 45"), "l_partkey", "p_partkey")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(a, "x").crossJoin(n(b, "y")).select((F.col("x") + F.col("y")).alias("orphans"))


@query(f"""m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {DOC_KEY}) AS survivor FROM documents)
SELECT count(*) AS rows_in, count(DISTINCT survivor) AS rows_out, count(*) FILTER (doc_id != survivor) AS merged, count(*) = count(DISTINCT survivor) + count(*) FILTER (doc_id != survivor) AS conserved FROM m""")
def conservation_check(spark, sf):
    docs = R.read(spark, sf, "documents")
    mapping = ingest.survivors(docs, _doc_key(), "doc_id").select("doc_id", "survivor")
    return ingest.conservation(docs, ingest.first_wins(docs, _doc_key(), "doc_id"), mapping)


#: Every part is an old row, and a new one under twice its number: half of the new ids are there already.
OLD_NEW = "old AS (SELECT p_partkey AS id, p_brand AS v, 0 AS turn FROM part), fresh AS (SELECT p_partkey * 2 AS id, p_type AS v, 1 AS turn FROM part)"


def _old_new(spark, sf):
    p = R.read(spark, sf, "part")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("v"), F.lit(0).alias("turn"))
    return old, p.select((F.col("p_partkey") * 2).alias("id"), F.col("p_type").alias("v"), F.lit(1).alias("turn"))


@query(OLD_NEW + " SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE id NOT IN (SELECT id FROM old)")
def upsert_ignore(spark, sf):
    return ingest.insert_ignore(*_old_new(spark, sf), ["id"])


@query(OLD_NEW + " SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM fresh)")
def upsert_replace(spark, sf):
    return ingest.insert_replace(*_old_new(spark, sf), ["id"], "turn")


@query(OLD_NEW + " SELECT o.id, coalesce(f.v, o.v) AS v, o.turn, f.v IS NOT NULL AS updated FROM old o LEFT JOIN fresh f USING (id)")
def update_matched(spark, sf):
    old, new = _old_new(spark, sf)
    return ingest.update(old, new, ["id"], "v").select("id", "v", "turn", "updated")


@query(f"m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {DOC_KEY}) AS survivor FROM documents) SELECT DISTINCT coalesce(survivor, doc_id) AS doc_id, quality FROM labels LEFT JOIN m USING (doc_id)")
def edges_repointed(spark, sf):
    mapping = ingest.survivors(R.read(spark, sf, "documents"), _doc_key(), "doc_id")
    return ingest.repointed(R.read(spark, sf, "labels").select("doc_id", "quality"), mapping, "doc_id").select("doc_id", "quality")


@query("SELECT term, row_number() OVER (ORDER BY term) AS id FROM (SELECT DISTINCT term FROM skills)")
def numbered_terms(spark, sf):
    return ingest.numbered(R.skills(spark, sf).select("term").distinct(), "id", ["term"]).select("term", F.col("id").cast("long").alias("id"))


@query(OLD_NEW + " SELECT * FROM old WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT * FROM fresh")
def partition_replace(spark, sf):
    return evolve.replace_partition(*_old_new(spark, sf), ["id"])


@query("SELECT job_id, skill_id, status FROM edges ORDER BY md5('42|' || job_id || '|' || skill_id) LIMIT 10")
def sample_check(spark, sf):
    return ingest.sample(R.edges(spark, sf), ["job_id", "skill_id"], 10).select("job_id", "skill_id", "status")


# -- pages


TOP8 = """, eight AS (SELECT job_id, list(term ORDER BY place) AS skills FROM (SELECT job_id, term, row_number() OVER (PARTITION BY job_id ORDER BY confidence DESC, skill_id) AS place FROM edges JOIN skills USING (skill_id) WHERE status = 'approved') WHERE place <= 8 GROUP BY 1),
pnodes AS (SELECT nodes.job_id, nodes.l1, nodes.level, 'embodied' AS category, experience AS name, CAST(company AS VARCHAR) AS company, substr(experience, 1, 80) AS description, coalesce(eight.skills, []) AS skills FROM nodes JOIN jobs ON jobs.job_id = nodes.job_id LEFT JOIN eight ON eight.job_id = nodes.job_id)"""


def _posting_nodes(spark, sf):
    nodes = graph_job_nodes_quota(spark, sf).select("job_id", "l1", "level", "category")
    jobs = R.jobs(spark, sf).select("job_id", F.col("experience").alias("title"), "company", F.col("experience").alias("text"))
    return views.posting_nodes(nodes, jobs, R.edges(spark, sf), R.skills(spark, sf))


@query(NODES + TOP8 + " SELECT job_id, l1, level, category, name, company, description, array_to_string(skills, ',') AS skills FROM pnodes")
def graph_posting_nodes(spark, sf):
    return _posting_nodes(spark, sf).select("job_id", "l1", "level", "category", "name", "company", "description", F.array_join("skills", ",").alias("skills"))


SNODES = """, snodes AS (SELECT skill_id, term, job_count, jobs, CASE WHEN term LIKE '%git%' OR term LIKE '%spark%' THEN 'tool' ELSE 'hard' END AS type FROM (SELECT skill_id, count(DISTINCT job_id) AS job_count, list_sort(list(DISTINCT job_id)) AS jobs FROM edges WHERE status = 'approved' AND job_id IN (SELECT job_id FROM nodes) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 120) JOIN skills USING (skill_id))"""


def _skill_nodes(spark, sf):
    return views.skill_nodes(graph_job_nodes_quota(spark, sf), R.edges(spark, sf), R.skills(spark, sf))


@query(NODES + SNODES + " SELECT 's' || skill_id AS id, term AS name, type, CAST(floor(40 + 60 * job_count / (SELECT max(job_count) FROM snodes)) AS INT) AS weight, 'embodied' AS category, job_count, array_to_string(jobs, ',') AS jobs FROM snodes")
def graph_skill_nodes(spark, sf):
    return _skill_nodes(spark, sf).withColumn("jobs", F.array_join(F.transform("jobs", lambda x: x.cast("string")), ","))


@query(NODES + TOP8 + " SELECT job_id, name FROM pnodes WHERE level = 'mid' AND category = 'embodied' AND (contains(name, 'bolt') OR contains(array_to_string(skills, ','), 'bolt'))")
def graph_filtered_postings(spark, sf):
    return views.filtered_postings(_posting_nodes(spark, sf), "embodied", "mid", "bolt").select("job_id", "name")


@query(NODES + SNODES + " SELECT 's' || skill_id AS id, term AS name FROM snodes WHERE type = 'hard' AND contains(term, 'bolt') AND skill_id IN (SELECT skill_id FROM edges JOIN nodes USING (job_id) WHERE status = 'approved' AND nodes.level = 'mid')")
def graph_filtered_skills(spark, sf):
    return views.filtered_skills(_skill_nodes(spark, sf), views.filtered_postings(_posting_nodes(spark, sf), level="mid"), "hard", "bolt").select("id", "name")


@query(NODES + SNODES + ", k AS (SELECT unnest(['hard', 'soft', 'domain', 'tool']) AS type, unnest([0, 1, 2, 3]) AS turn) SELECT k.type, turn, count(skill_id) AS n FROM k LEFT JOIN snodes USING (type) GROUP BY 1, 2")
def skills_by_type(spark, sf):
    return views.by_kind(_skill_nodes(spark, sf))


@query(HEAT + ", o AS (SELECT unnest(['STANDARD', 'SMALL', 'T9']) AS l1, unnest([1, 2, 3]) AS turn) SELECT l1, turn, string_agg(l2, ',' ORDER BY l2) AS categories, sum(total)::BIGINT AS total FROM heat JOIN o USING (l1) GROUP BY 1, 2")
def heat_groups(spark, sf):
    return views.grouped_heat(heatmap(spark, sf), ("STANDARD", "SMALL", "T9")).withColumn("categories", F.array_join("categories", ","))


@query("SELECT job_id, experience AS title, CAST(company AS VARCHAR) AS company FROM jobs WHERE contains(lower(experience), 'high') OR contains(CAST(company AS VARCHAR), 'high') ORDER BY collect_date DESC, job_id LIMIT 30")
def jobs_search(spark, sf):
    jobs = R.jobs(spark, sf).select("job_id", F.col("experience").alias("title"), F.col("company").cast("string").alias("company"), "collect_date")
    return views.search(jobs, ["title", "company"], " HIGH ", [F.desc("collect_date"), "job_id"]).drop("collect_date")


@query("SELECT c_custkey AS company, c_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND (contains(c_name, '7') OR contains(n_name, '7'))")
def company_filter(spark, sf):
    rows = R.read(spark, sf, "customer").join(R.read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return views.filtered_companies(rows, {"c_mktsegment": "BUILDING", "n_name": "all"}, ["c_name", "n_name"], "7").select(F.col("c_custkey").alias("company"), F.col("c_name").alias("name"))


@query("SELECT term AS value, count(*) AS n FROM (SELECT DISTINCT company, skill_id, term FROM edges JOIN jobs USING (job_id) JOIN skills USING (skill_id) WHERE status = 'approved') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def company_top_skills(spark, sf):
    rows = R.edges(spark, sf).filter("status = 'approved'").join(R.jobs(spark, sf).select("job_id", "company"), "job_id").join(R.skills(spark, sf).select("skill_id", "term"), "skill_id")
    return views.top_items(rows.select("company", "skill_id", "term").distinct(), "term")


@query(NODES + " SELECT DISTINCT resume_id AS company, job_id FROM resume_skills JOIN edges USING (skill_id) JOIN nodes USING (job_id) WHERE edges.status = 'approved'")
def company_jobs(spark, sf):
    nodes = graph_job_nodes_quota(spark, sf).select("job_id")
    own = R.edges(spark, sf).filter("status = 'approved'").join(nodes, "job_id", "left_semi")
    return views.sharing_postings(R.resume_skills(spark, sf).select(F.col("resume_id").alias("company"), "skill_id"), own)


@query(PROFILE + """, listed AS (SELECT cluster_id, jobs AS n, CASE WHEN jobs % 2 = 0 THEN 'llm' ELSE 'heuristic' END AS source, coalesce(kw, []) AS kw, coalesce(further, []) AS further FROM titles LEFT JOIN words USING (cluster_id))
SELECT cluster_id, CASE WHEN n >= 5 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS signal, CASE source WHEN 'llm' THEN 78 ELSE 92 END AS confidence, least(n * 15, 350) AS growth, array_to_string(kw[1:8], ',') AS skills, array_to_string(further, ',') AS bonus FROM listed""")
def cluster_discoveries(spark, sf):
    none = F.array().cast("array<string>")
    words = F.when(F.col("keywords").isNull(), none).otherwise(F.split("keywords", ","))
    rows = _profile(spark, sf).select("cluster_id", F.col("jobs").alias("job_count"), F.when(F.col("jobs") % 2 == 0, "llm").otherwise("heuristic").alias("name_source"), words.alias("shared_skills"), F.concat(words, F.coalesce("further", none)).alias("keywords"))
    found = views.discoveries(rows)
    return found.select("cluster_id", "signal", "confidence", "growth", F.array_join("skills", ",").alias("skills"), F.array_join("bonus", ",").alias("bonus"))


WANTED = [("r1", " Red-Widget "), ("r1", "no such term"), ("r2", "GREEN bolt"), ("r3", "blue  gear")]


@query(f"""wanted AS (SELECT * FROM ({values(WANTED)}) w(owner, term)), ids AS (SELECT {norm('term')} AS n, max(skill_id) AS skill_id FROM skills GROUP BY 1)
SELECT owner, wanted.term, ids.skill_id FROM wanted LEFT JOIN ids ON ids.n = {norm('wanted.term')}""")
def term_lookup(spark, sf):
    return views.looked_up(spark.createDataFrame(WANTED, "owner string, term string"), R.skills(spark, sf)).select("owner", "term", "skill_id")


GOLD = [(1, "the"), (2, "rights、reserved/nosuch"), (3, "license+nosuch"), (4, "all rights reserved")]


@query(f"""gold AS (SELECT * FROM ({values(GOLD)}) g(id, term)), plain AS (SELECT doc_id, {norm('text')} AS t FROM documents),
parts AS (SELECT DISTINCT id, {norm("unnest(regexp_split_to_array(term, '[/,，;；+、|]'))")} AS atom FROM gold),
whole AS (SELECT doc_id, id, contains(' ' || t || ' ', ' ' || {norm('term')} || ' ') AS w FROM plain, gold),
parts_in AS (SELECT doc_id, id, count(*) FILTER (contains(' ' || t || ' ', ' ' || atom || ' ')) AS n FROM plain, parts WHERE atom != '' GROUP BY 1, 2)
SELECT doc_id, CAST(id AS BIGINT) AS skill_id, w OR n >= 2 AS in_text FROM whole JOIN parts_in USING (doc_id, id)""")
def eval_gold_in_text(spark, sf):
    gold = R.read(spark, sf, "documents").select("doc_id").crossJoin(F.broadcast(spark.createDataFrame(GOLD, "skill_id long, term string")))  # four rows
    return views.gold_in_text(documents(spark, sf), gold)


@query("SELECT o_orderkey AS snapshot_id, o_custkey AS job_id FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey DESC LIMIT 50")
def snapshots_list(spark, sf):
    return evolve.history(R.read(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("job_id")), 7, 50)


QUEUES = """pend AS (SELECT cluster_id, count(*) AS jobs FROM members GROUP BY 1)"""


@query(QUEUES + " SELECT cluster_id AS target_id, s_name AS name, jobs, n_name AS l2 FROM pend JOIN supplier ON s_suppkey = cluster_id LEFT JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < 0 ORDER BY jobs DESC, cluster_id LIMIT 50")
def review_queue_clusters(spark, sf):
    size = R.cluster_members(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("jobs"))
    s = R.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("cluster_id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "pending").otherwise("approved").alias("status"), "s_nationkey")
    classes = R.read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("l2"))
    return review.waiting(size.join(s, "cluster_id").join(classes, "s_nationkey", "left"), "cluster_id", [F.desc("jobs"), "cluster_id"], 50).select("target_id", "name", "jobs", "l2")


@query(DECISIONS + """ SELECT (SELECT count(*) FROM edges WHERE status = 'pending') AS edge, (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS cluster, (SELECT count(*) FROM members) AS definition, (SELECT count(*) FROM decisions) AS decided""")
def review_pending(spark, sf):
    clusters = R.read(spark, sf, "supplier").select(F.when(F.col("s_acctbal") < 0, "pending").otherwise("approved").alias("status"))
    definitions = R.cluster_members(spark, sf).select(F.lit("pending").alias("status"))
    return review.pending({"edge": R.edges(spark, sf), "cluster": clusters, "definition": definitions}, _decisions(spark, sf))
