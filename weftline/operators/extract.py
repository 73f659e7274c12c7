"""Dictionary extraction from free text: terms, combinations, metrics, evidence.

A term occurs where its normalised form stands in the normalised text, bounded if it has
an ASCII letter or digit.  Texts are cut into the tokens of their normalised form and
joined with the terms' first tokens by equality, so no text is held against every term;
a joined pair is then verified with the term's whole pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import scalar as S

WINDOW = 40
EDGE = "[A-Za-z0-9_]"
# Units of measure that a metric term may name.
UNITS = ("m", "mm", "cm", "km", "um", "nm", "inch", "g", "kg", "mg", "t", "lb", "ms", "us", "ns", "min", "h", "hz", "khz", "mhz", "ghz", "pa", "kpa", "mpa", "bar", "psi", "n", "kn", "j", "kj", "w", "kw", "mw", "v", "kv", "a", "ma", "ah", "deg", "rad", "%", "ppm", "m/s", "km/h", "rpm", "lux", "k", "lm", "db", "dbm")


def bounded(norm: Column) -> Column:
    """The pattern of a normalised term."""
    quoted = F.concat(F.lit(r"\Q"), norm, F.lit(r"\E"))
    return F.when(norm.rlike("[A-Za-z0-9]"), F.concat(F.lit(f"(?<!{EDGE})"), quoted, F.lit(f"(?!{EDGE})"))).otherwise(quoted)


def dictionary(terms: DataFrame) -> DataFrame:
    """skill_id, norm and pattern; of one normalised form only the longest-first, lowest id."""
    rows = terms.select("skill_id", S.normalize_text(F.col("term")).alias("norm")).filter("norm != ''")
    return rows.groupBy("norm").agg(F.min("skill_id").alias("skill_id")).select("skill_id", "norm", bounded(F.col("norm")).alias("pattern"))


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, skill_id, evidence) of each term that a text holds; ``texts`` has doc_id and text."""
    words = dictionary(terms)
    plain = texts.select("doc_id", S.normalize_text(F.col("text")).alias("norm_text"))
    # ASCII-led terms are met by a token of the text, others by containment of a small list.
    led = words.filter(F.col("norm").rlike("^[A-Za-z0-9_]")).withColumn("token", F.regexp_extract("norm", f"^{EDGE}+", 0))
    tokens = plain.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("norm_text", F.lit(f"({EDGE}+)"), 1))).alias("token"))
    pairs = tokens.join(led, "token").select("doc_id", "skill_id", "norm", "pattern")
    # A term of one token is found already; longer ones are verified against the text.
    single = pairs.filter(F.col("norm").rlike(f"^{EDGE}+$")).select("doc_id", "skill_id", "norm", "pattern")
    longer = pairs.filter(~F.col("norm").rlike(f"^{EDGE}+$")).join(plain, "doc_id").filter(F.expr("norm_text rlike pattern")).select("doc_id", "skill_id", "norm", "pattern")
    other = plain.join(words.filter(~F.col("norm").rlike("^[A-Za-z0-9_]")), F.expr("contains(norm_text, norm) AND norm_text rlike pattern")).select("doc_id", "skill_id", "norm", "pattern")
    return single.unionByName(longer).unionByName(other).select("doc_id", "skill_id", "norm", "pattern")


def evidence(texts: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """The first place of each hit, and the characters around it."""
    plain = texts.select("doc_id", S.normalize_text(F.col("text")).alias("norm_text"))
    at = F.expr("regexp_instr(norm_text, pattern)")
    rows = found.join(plain, "doc_id").withColumn("pos", at.cast("long"))
    start = F.greatest(F.lit(1), F.col("pos") - window)
    size = F.col("pos") - start + F.length("norm") + window
    return rows.select("doc_id", "skill_id", "pos", F.trim(F.substring(F.col("norm_text"), start.cast("int"), size.cast("int"))).alias("evidence"))


def combinations(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Combination terms of which the text holds the whole, or else an atom of two letters or more."""
    atoms = terms.select("skill_id", F.col("term").alias("whole"), F.posexplode(F.split("term", r"[/,，;；+、\\|]")).alias("k", "atom"))
    atoms = atoms.select("skill_id", F.col("k"), S.normalize_text(F.col("atom")).alias("atom")).filter(F.length("atom") >= 2)
    whole = terms.select("skill_id", S.normalize_text(F.col("term")).alias("whole"))
    ids = atoms.select(F.concat_ws(":", F.lit("a"), "skill_id", "k").alias("skill_id"), F.col("atom").alias("term")).unionByName(whole.select(F.concat_ws(":", F.lit("w"), "skill_id", F.lit(0)).alias("skill_id"), F.col("whole").alias("term")))
    # Equal atoms of different terms are looked up once and spread afterwards.
    names = ids.select(S.normalize_text(F.col("term")).alias("norm"), "skill_id")
    hits = occurrences(texts, ids).select("doc_id", "norm").join(names, "norm")
    parts = F.split("skill_id", ":")
    flat = hits.select("doc_id", F.get(parts, F.lit(1)).cast("long").alias("skill_id"), (F.get(parts, F.lit(0)) == "w").alias("is_whole"))
    return flat.groupBy("doc_id", "skill_id").agg(F.max("is_whole").alias("is_whole"), F.count(F.lit(1)).alias("parts"))


def metric_pattern(norm: str) -> str | None:
    """A number before one of the units whose letters stand in a metric term's normalised form."""
    import re

    units = [re.escape(u) for u in UNITS if u in norm]
    return rf"\d+(?:\.\d+)?\s*(?:{'|'.join(units)})" if units else None


def incremental(texts: DataFrame, done: DataFrame) -> DataFrame:
    """Texts without any edge yet."""
    return texts.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def exact(texts: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Hits with the evidence that nested terms share: a term inside a longer hit is shown by the
    longer hit's place.  Off the hot path: it runs in Python, a batch of texts at a time.
    """
    import re

    words = [(r["skill_id"], r["norm"]) for r in dictionary(terms).orderBy(F.desc(F.length("norm")), "skill_id").collect()]  # the dictionary is a dimension of bounded size

    def pattern(norm: str) -> re.Pattern[str]:
        body = re.escape(norm)
        return re.compile(rf"(?<!{EDGE}){body}(?!{EDGE})" if re.search("[A-Za-z0-9]", norm) else body)

    compiled = [(i, n, pattern(n)) for i, n in words]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["norm_text"], strict=True):
                spans: list[tuple[int, int]] = []
                for i, _, p in compiled:
                    m = p.search(text)
                    if m is None:
                        continue
                    outer = next((s for s in spans if s[0] <= m.start() and m.end() <= s[1] and s != m.span()), m.span())
                    spans.append(m.span())
                    rows.append((doc, i, text[max(0, outer[0] - window) : outer[1] + window].strip()))
            yield pd.DataFrame(rows, columns=["doc_id", "skill_id", "evidence"])

    plain = texts.select("doc_id", S.normalize_text(F.col("text")).alias("norm_text"))
    return plain.mapInPandas(run, "doc_id long, skill_id long, evidence string")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def metrics(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, skill_id) of metric terms whose units follow a number; metric terms are a small list."""
    words = [(r["skill_id"], metric_pattern(r["norm"])) for r in terms.select("skill_id", S.normalize_text(F.col("term")).alias("norm")).collect()]
    words = [(i, p) for i, p in words if p]
    plain = texts.select("doc_id", S.normalize_text(F.col("text")).alias("norm_text"))
    hit = F.filter(F.array(*(F.when(F.col("norm_text").rlike(p), F.lit(i)) for i, p in words)), lambda x: x.isNotNull())
    return plain.select("doc_id", F.explode(hit).alias("skill_id"))
