import json

from weftline.sources import files
from weftline.streaming import incremental


def test_posting_columns(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text("岗位,Company , JD描述\n工程师,甲,\"会 SLAM\n和 ROS\"\n", encoding="utf-8")
    row = files.renamed(files.csv(spark, str(path))).first()
    assert (row["title"], row["company"], row["city"]) == ("工程师", "甲", None) and "ROS" in row["jd_text"]


def test_dictionary(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("skill_term,l1_code\nSLAM,T1\n ,T1\n", encoding="utf-8")
    rows = files.dictionary(spark, str(path)).collect()
    assert [(r["skill_term"], r["skill_term_raw"], r["l4_type"]) for r in rows] == [("SLAM", "SLAM", "细分词")]


def test_truth_and_texts(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"J1": ["a", "b"], "J2": []}))
    assert {tuple(r) for r in files.truth(spark, str(tmp_path / "t.json")).collect()} == {("J1", "a"), ("J1", "b")}
    (tmp_path / "x.txt").write_text("文本", encoding="utf-8")
    assert files.texts(spark, str(tmp_path / "x.txt")).first()["text"] == "文本"


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.partitionBy("k").parquet(path)
    files.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_stream_goes_on(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    terms = spark.createDataFrame([(1, "slam")], "skill_id long, term string")
    schema = "doc_id long, text string"
    for batch in ([(1, "SLAM"), (2, "x")], [(1, "SLAM"), (3, "slam ros")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        rows = incremental.arriving(spark, source, spark.createDataFrame([], schema).schema, "doc_id")
        incremental.extract_terms(rows, terms, out, check).awaitTermination()
    assert sorted((r["doc_id"], r["skill_id"]) for r in spark.read.parquet(out).collect()) == [(1, 1), (3, 1)]


def workbook(path, sheets):
    import zipfile

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>shared </t></si><si><r><t>two</t></r><r><t> runs</t></r></si></sst>')
        for i, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    head = '<row><c r="A1" t="inlineStr"><is><t> 技术\n词 </t></is></c><c r="C1" t="s"><v>0</v></c></row>'
    workbook(path, {"one": head, "two": head + '<row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>9</v></c></row><row><c r="C3"><v>4.5</v></c></row>'})
    rows = files.sheet(spark, path, "two")
    assert rows.columns == ["技术 词", "shared"]
    assert sorted((tuple(r) for r in rows.collect()), key=str) == [("two runs", None), (None, "4.5")]
    assert files.sheet(spark, path).count() == 0


def test_companies_settings_and_sinks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"companies": [{"name": "A", "skills": ["x", "y"]}, {"name": "B"}]}))
    assert [(r["name"], r["skills"], r["city"]) for r in files.companies(spark, str(tmp_path / "c.json")).collect()] == [("A", ["x", "y"], None), ("B", None, None)]
    env = str(tmp_path / ".env")
    files.save_settings(env, {"A": "1", "B": "two"})
    files.save_settings(env, {"A": "3"})
    with open(env, "a") as f:
        f.write("# C=4\n\nD='q'\n")
    assert files.settings(env) == {"A": "3", "B": "two", "D": "q"}
    rows = spark.createDataFrame([(1, 'a "b",\nc')], "k int, v string")
    files.write_json(rows, str(tmp_path / "j"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "j")).collect()] == [(1, 'a "b",\nc')]
    files.write_csv(rows, str(tmp_path / "csv"))
    assert files.csv(spark, str(tmp_path / "csv")).first()["v"] == 'a "b",\nc'
    files.append(rows, str(tmp_path / "p"))
    files.append(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    files.overwrite(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert files.run_id("2026-08-01", "T", 1) == files.run_id("2026-08-01", "T", 1) != files.run_id("2026-08-01", "T", 2)


def test_generated_postings(spark):
    from weftline.operators import extract

    skills = spark.createDataFrame([(i, f"term{i}", "T1") for i in range(30)], "skill_id long, term string, l1 string")
    got = files.generated(spark, skills, {"T1": ["a", "b"]}, ["X", "Y", "Z"], 5).collect()
    assert len({(r["title"], r["company"]) for r in got}) == 5 and all(7 <= len(r["terms"]) <= 12 for r in got)
    assert got == files.generated(spark, skills.repartition(5), {"T1": ["a", "b"]}, ["X", "Y", "Z"], 5).collect()
    texts = spark.createDataFrame([(i, r["text"]) for i, r in enumerate(got)], "doc_id long, text string")
    found = {(r["doc_id"], r["skill_id"]) for r in extract.occurrences(texts, skills).collect()}
    assert found == {(i, int(t[4:])) for i, r in enumerate(got) for t in r["terms"]}
