"""Sources and sinks: CSV, JSON, text, constants, and table replacement."""

from __future__ import annotations

import hashlib
import io
import os
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from functools import partial
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of posting columns, the first that a file has wins.
ALIASES = {
    "title": ["岗位", "职位", "title", "岗位名称"],
    "company": ["公司", "company", "公司名称"],
    "city": ["城市", "city", "工作城市", "工作地"],
    "region": ["地区", "region"],
    "salary_text": ["薪资", "salary", "薪水", "薪资范围"],
    "experience": ["经验", "experience", "工作经验", "经验要求"],
    "education": ["学历", "education", "学历要求"],
    "headcount": ["招聘人数", "headcount"],
    "jd_text": ["jd描述", "岗位描述", "职位描述", "jd", "描述", "description"],
    "platform": ["来源平台", "platform", "来源"],
    "collect_time": ["收录时间", "collect_time", "发布时间"],
    "link": ["链接", "link", "url"],
    "source_file": ["source_file"],
}


def renamed(rows: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """The logical columns, whatever their case and spaces in the file; missing ones are null."""
    have = {c.replace(" ", "").lower(): c for c in reversed(rows.columns)}
    found = {field: next((have[n.lower()] for n in names if n.lower() in have), None) for field, names in aliases.items()}
    return rows.select(*((F.trim(F.col(f"`{c}`").cast("string")) if c else F.lit(None).cast("string")).alias(f) for f, c in found.items()))


def csv(spark: SparkSession, *paths: str) -> DataFrame:
    """All columns as text; nothing is inferred."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(list(paths))


def dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """Terms of dictionary files, with the default type, and without empty ones."""
    rows = csv(spark, *paths)
    for c in ("skill_term_raw", "l4_type", "l1_code", "l2_name", "l3_name"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.select(text("skill_term").alias("skill_term"), F.coalesce(text("skill_term_raw"), text("skill_term")).alias("skill_term_raw"), F.coalesce(text("l4_type"), F.lit("细分词")).alias("l4_type"), text("l1_code").alias("l1_code"), text("l2_name").alias("l2_name"), text("l3_name").alias("l3_name")).filter("skill_term IS NOT NULL")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, term) of a JSON object of arrays."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("job_id", "terms")).select("job_id", F.explode("terms").alias("term"))


def texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of files decoded as UTF-8; bytes that are none become U+FFFD."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.decode("content", "UTF-8").alias("text")) if files.sparkSession.conf.get("spark.sql.legacy.codingErrorAction", "false") == "true" else files.select("path", F.col("content").cast("string").alias("text"))


def constants(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def pdf(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of PDF files, where the optional library is installed."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("PDF files need the pypdf library") from e

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        from pypdf import PdfReader

        return contents.map(lambda c: "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(c)).pages).strip())

    return spark.read.format("binaryFile").load(list(paths)).select("path", text("content").alias("text"))


def sheet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Rows of a sheet (the first without a name) of the workbooks at ``path``, read on the executors.

    The first row names the columns, its white space collapsed; all cells are text, empty ones null;
    headers without a name and columns that repeat one are left out.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(partial(_cells, name=name), "path string, at int, cells array<string>")
    header = rows.filter("at = 0").orderBy("path").first()  # one row
    if header is None:
        return spark.createDataFrame([], "path string")
    names = [" ".join((c or "").split()) for c in header["cells"]]
    first = {n: i for i, n in reversed(list(enumerate(names))) if n}
    return rows.filter("at > 0").select(*(F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for n, i in sorted(first.items(), key=lambda x: x[1])))


def _cells(batches: Iterator[pd.DataFrame], name: str | None) -> Iterator[pd.DataFrame]:
    """Rows of a sheet in each workbook: a zip of XML parts with shared texts and cells named by letters."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    whole = lambda node: "".join(t.text or "" for t in node.iter(f"{space}t"))
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as book:
                parts = set(book.namelist())
                shared = [whole(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in parts else []
                sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{space}sheet"))
                chosen = next((s for s in sheets if name is None or s.get("name") == name), None)
                if chosen is None:
                    raise ValueError(f"no sheet {name!r} in {path}")
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
                target = targets[chosen.get(link)]
                root = ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            for at, row in enumerate(root.iter(f"{space}row")):
                cells: list[str | None] = []
                for cell in row.iter(f"{space}c"):
                    letters = re.match("[A-Z]*", cell.get("r", "")).group()
                    column = 0
                    for x in letters:
                        column = 26 * column + ord(x) - 64
                    cells += [None] * ((column or len(cells) + 1) - 1 - len(cells))
                    value = cell.find(f"{space}v")
                    kind = cell.get("t")
                    cells.append(whole(cell) if kind == "inlineStr" else None if value is None or value.text is None else shared[int(value.text)] if kind == "s" else value.text)
                out.append((path, at, cells))
        yield pd.DataFrame(out, columns=["path", "at", "cells"])


def attached(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of another database over JDBC, read in ranges of ``key`` (lowest, highest, parts) if there are ``bounds``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key is not None and bounds is not None:
        low, high, parts = bounds
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a JSON document with a list ``companies``; skills and positions are lists of texts."""
    texts_ = ("name", "english_name", "chain_level", "sub_field", "products", "product_type", "key_features", "mass_production", "city", "region", "province", "finance_stage", "finance_raw", "website")
    fields = ", ".join([*(f"{c}: string" for c in texts_), "skills: array<string>", "positions: array<string>"])
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"companies array<struct<{fields}>>")["companies"]).alias("c")).select("c.*")


def settings(path: str) -> dict[str, str]:
    """``KEY=value`` lines; blank lines and those that begin with # are left out, quotes around values go."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            k, eq, v = line.strip().partition("=")
            if eq and not k.startswith("#"):
                out[k.strip()] = v.strip().strip("'\"")
    return out


def save_settings(path: str, values: Mapping[str, str]) -> None:
    """Writes the values over those that the file has, through a new file that takes its place."""
    try:
        old = settings(path)
    except FileNotFoundError:
        old = {}
    with open(f"{path}.new", "w", encoding="utf-8") as out:
        out.writelines(f"{k}={v}\n" for k, v in {**old, **values}.items())
    os.replace(f"{path}.new", path)


def run_id(day: str, *seed: object) -> str:
    """RUN-day-8 hex digits, from the seed so that the same request has the same id."""
    return f"RUN-{day.replace('-', '')}-{hashlib.sha256(repr(seed).encode()).hexdigest()[:8].upper()}"


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def generated(spark: SparkSession, skills: DataFrame, titles: Mapping[str, Sequence[str]], companies_: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` postings drawn by hashes of their number: job_id, title, company, text, terms (what the text names).

    ``skills``: term, l1, of the domains that ``titles`` names.  A title stands at a company once, so at most
    titles x companies rows come out.  The same arguments give the same rows however they are split.
    """
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40))
    pairs = spark.createDataFrame([(d, t, c) for d, ts in titles.items() for t in ts for c in companies_], "l1 string, title string, company string").distinct()
    chosen = pairs.withColumn("_draw", draw(F.col("title"), F.col("company"))).orderBy("_draw", "title", "company").limit(n)
    numbered = chosen.withColumn("_id", F.concat_ws("|", "title", "company"))
    # Each domain's terms are a dimension; a posting takes the seven to twelve of them that its draw puts first.
    pool = skills.filter(F.col("l1").isin(list(titles))).groupBy("l1").agg(F.sort_array(F.collect_set("term")).alias("pool"))
    ranked = F.array_sort(F.transform("pool", lambda t: F.struct(draw(t, F.col("_id")).alias("d"), t.alias("t"))))
    size = (7 + draw(F.col("_id"), F.lit("size")) % 6).cast("int")
    rows = numbered.join(F.broadcast(pool), "l1").withColumn("terms", F.transform(F.slice(ranked, F.lit(1), size), lambda x: x["t"]))
    text = F.concat(F.lit("岗位职责：负责"), F.array_join(F.slice("terms", 1, 2), "、"), F.lit("相关系统的设计与优化。任职要求：熟练掌握"), F.array_join("terms", "、"), F.lit("。"))
    return rows.select(F.concat(F.lit("sample__"), "_id").alias("job_id"), "l1", "title", "company", text.alias("text"), F.sort_array("terms").alias("terms"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def replace_partitions(rows: DataFrame, path: str, column: str) -> None:
    """Only the partitions that ``rows`` has are written anew."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
