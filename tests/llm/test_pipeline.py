import random

import corpus_pipeline
from pyspark.sql import functions as F
from weftline.llm import langid, packing, toxicity


CLASHING = ("toxicity", "toxic_terms", "lang_pred", "_text", "_", "__", "_gone_id", "_th", "line_dedup", "node")


def test_stages_in_order(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("abdeilmnorstu", k=6)) for _ in range(900)]
    rows, labels = [], []
    for i in range(120):
        bad = i % 6 == 0
        own = [*rng.choices(words, k=80), *(["blarghy"] if bad else [])]
        rng.shuffle(own)
        rows.append((i, " ".join(own), "xx", f"s{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    copy = rows[1][1].split()
    copy[3] = "changed"
    rows += [(200, " ".join(copy), "xx", "s", 0), (201, None, "xx", "s", 0), (202, "12345", None, "s", 0), (203, "a line that is shared\n" + rows[2][1][:200], "xx", "s", 0), (204, "a line that is shared\n" + rows[4][1][::-1], "xx", "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in CLASHING}).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{sf}/{name}"
        stage(spark, tables[-1], sf).write.parquet(path)
        tables.append(spark.read.parquet(path))
        assert tables[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] - ids[1] == {i for i in range(0, 120, 6)}
    assert ids[1] - ids[2] == {201, 202}
    assert ids[2] == ids[3] and ids[3] - ids[4] == {200}
    lines = {r["doc_id"]: (r["text"], r["n_chars"]) for r in tables[3].collect()}
    assert lines[203][0].startswith("a line") and not lines[204][0].startswith("a line") and all(len(t) == n for t, n in lines.values())

    whole = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    last = packing.pack(tables[4]).select("doc_id", "start", "length").collect()
    assert {r["doc_id"] for r in whole} == ids[4]
    tokens = lambda rs: {i: sum(r["length"] for r in rs if r["doc_id"] == i) for i in ids[4]}
    assert tokens(whole) == tokens(last)


def test_texts_in_three_languages_stay(spark):
    rng = random.Random(5)
    pools = {k: ["".join(rng.choices(letters, k=6)) for _ in range(200)] for k, letters in (("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "opqrstu"))}
    rows = [(100 * n + i, " ".join(rng.choices(pool, k=60)), k, "s", 0) for n, (k, pool) in enumerate(pools.items()) for i in range(30)]
    rows += [(900, " ".join(w for pool in pools.values() for w in rng.choices(pool, k=60)), None, "s", 0), (901, "12 34", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_unidentified(spark, docs, "").select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {901}


def test_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_limits_are_the_documented_ones():
    assert toxicity.THRESHOLD == 0.7 and langid.SAMPLE_PER_LANGUAGE == 1500 and packing.CAPACITY == 2048
