"""A training-data pipeline over ``documents``: each stage's table is the next one's input.

Toxic documents go, then those without a letter, then lines
that other documents hold already, then all but one of each class of near duplicates;
what is left is packed.  Each stage works on every document that its predecessor kept.

A null text counts as empty: it is not toxic, and goes as a text without a letter does.  A
text that line deduplication has emptied stays an empty text; near-duplicate removal then
keeps one of those.  Ties are broken by doc_id, a null one ranks last; of rows that repeat
one stays after near-duplicate removal.  An empty table gives an empty result.  Further
columns of any name go through all stages but the last.  Texts of any length are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, linededup, neardup, packing, toxicity
from weftline.llm.common import materialize, table


def names(docs: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, made longer than any column's, so that none of them is one."""
    return [w + "_" * max(map(len, docs.columns)) for w in wanted]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity is THRESHOLD or more, learned from ``labels``."""
    scorer = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    score, terms = names(docs, "toxicity", "toxic_terms")
    return toxicity.score(docs, scorer, [*docs.columns], (score, terms)).filter(F.col(score) < toxicity.THRESHOLD).drop(score, terms)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have no letter; texts in several languages stay, whatever their shares."""
    added = names(docs, "lang_pred", "lang_score", "lang_shares")
    found = langid.predict(docs, langid.learn(docs), [*docs.columns], tuple(added))
    return found.filter(F.col(added[0]) != "und").drop(*added)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller id holds; n_chars follows."""
    (found,) = names(docs, "line_dedup")
    text = F.col(f"{found}.kept_text")
    columns = {"text": text, "n_chars": F.length(text).cast("long")}
    return linededup.dedup(docs, result=found).select(*(columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Learned scores, sketches and packing cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
