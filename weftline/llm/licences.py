"""Licence scans by a positional rare-token index, with DataFrame operations only.

Templates of licences are short word sequences with a mandatory key phrase.  A first scan
counts in how many texts each template word stands; from that, each template's two rarest
words are its entries in the index.  A second scan looks up the rare words of each text:
where one stands, the template would begin at its place less its place in the template,
and the starts that the first rare word gives are intersected with those of the second.
What is left is verified against the template's whole key phrase.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.  Null
and empty texts have no words and no places (nulls for the first and last place).  Rows
that repeat are scanned each; input columns of any name are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words, with A-Z not yet in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further templates, label and (key phrase, words that may stand around it).
TEMPLATES = {
    "apache-2.0": ("apache license version 2 0", "licensed under the apache license version 2 0"),
    "mit": ("permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "bsd": ("redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    "mpl-2.0": ("mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    "lgpl": ("lesser general public license", "gnu lesser general public license"),
    "agpl": ("affero general public license", "gnu affero general public license"),
    "cc0": ("cc0 1 0", "cc0 1 0 universal public domain dedication"),
    "cc-by-sa": ("cc by sa", "licensed under cc by sa 4 0"),
    "cc-by-nc": ("cc by nc", "licensed under cc by nc 4 0"),
    "unlicense": ("released into the public domain", "this is free and unencumbered software released into the public domain"),
    "isc": ("permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose"),
}
ALL = {label: (phrase, phrase) for phrase, label in BASE.items()} | TEMPLATES
VOCABULARY = sorted({w for phrase, words in ALL.values() for w in words.split()})
#: Words a template is entered by.
ENTRIES = 2


def words(text: Column) -> Column:
    """The words of a text, only A-Z in lower case (a word with other letters keeps them)."""
    # A licence word is ASCII, so lower() of a word that has other characters is never looked at: it could
    # only turn into one by U+212A or U+0130, which these words then still must not match.
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.lit("\u0080")))


def _any_of(names: list[str]) -> str:
    edge = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    return f"(?i)(?<!{edge})(?:{'|'.join(sorted(names, key=lambda w: (-len(w), w)))})(?!{edge})"


def rarity(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each template word: one row for each, counted over all texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({_any_of(_telling())})"), 1), lambda w: F.lower(w)))
    one = docs.select(F.explode(F.concat(F.array(F.lit("")), seen)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["word"]: r["n"] for r in one.collect()}
    total = counts.get("", 0)
    # What is not counted here is a word so short and common that no text is entered by it.
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) if w in _telling() else 0.0 for w in VOCABULARY}


def _telling() -> list[str]:
    """Template words worth an entry: in a key phrase, and of four letters or the phrase's only longer ones."""
    out = set()
    for phrase, _ in ALL.values():
        names = phrase.split()
        long = [w for w in names if len(w) >= 5]
        out |= set(long or names)
    return sorted(out)


def entries(idf: dict[str, float]) -> dict[str, list[tuple[str, int]]]:
    """The index: each template's rarest key words (the same word once) and their places in the key phrase."""
    out = {}
    for label, (phrase, _) in ALL.items():
        names = phrase.split()
        ranked = sorted({w: names.index(w) for w in reversed(names)}.items(), key=lambda x: (-(idf[x[0]] if x[0] in _telling() else -1.0), x[1]))
        out[label] = ranked[:ENTRIES]
    return out


def _less(place: int) -> Callable[[Column], Column]:
    return lambda i: i - place


def _stands(names: list[str]) -> Callable[[Column], Column]:
    """Whether the phrase's words stand from a place on."""
    return lambda i: F.slice(F.col("__ls_words"), i + 1, len(names)) == F.array(*(F.lit(w) for w in names))


def scan(docs: DataFrame, result: str = "licence_scan") -> DataFrame:
    """``docs`` and a struct ``result``: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    idf = rarity(docs)
    index = entries(idf)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rare = sorted({places[0][0] for places in index.values()})
    # Only a text that holds some template's rarest word is cut into words.
    listed = F.when(text.rlike(_any_of(rare)), words(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn("__ls_words", listed)

    def places(word: str) -> Column:
        at = F.transform(F.col("__ls_words"), lambda w, i: F.when(w == word, i))
        return F.filter(at, lambda i: i.isNotNull())

    lookups = sorted({w for entry in index.values() for w, _ in entry})
    some = F.size("__ls_words") > 0
    none = F.array().cast("array<int>")
    rows = rows.withColumn("__ls_at", F.struct(*(F.when(some, places(w)).otherwise(none).alias(f"w{k}") for k, w in enumerate(lookups))))
    found, fits = {}, {}
    for label, (phrase, whole) in ALL.items():
        names = phrase.split()
        starts = None
        for w, place in index[label]:
            own = F.transform(F.col(f"__ls_at.w{lookups.index(w)}"), _less(place))
            starts = own if starts is None else F.array_intersect(starts, own)
        starts = F.filter(starts, lambda i: i >= 0)
        found[label] = F.filter(starts, _stands(names))
    rows = rows.withColumn("__ls_found", F.struct(*(F.when(some, p).otherwise(none).alias(f"t{k}") for k, p in enumerate(found.values()))))
    at = {label: F.col(f"__ls_found.t{k}") for k, label in enumerate(found)}
    for label, (phrase, whole) in ALL.items():
        # How much of the template, by rarity, stands around the phrase where it was first found.
        template, shift = whole.split(), _shift(whole, phrase)
        own = [max(idf[w], 0.1) for w in template]
        first = F.get(at[label], F.lit(0))
        agree = sum((F.when(F.get(F.col("__ls_words"), first + (j - shift)) == w, v).otherwise(0.0) for j, (w, v) in enumerate(zip(template, own, strict=True))), F.lit(0.0))
        fits[label] = F.when(F.size(at[label]) > 0, agree / sum(own)).otherwise(0.0)
    base = F.flatten(F.array(*(at[label] for label in BASE.values())))

    def names_of(labels: list[str]) -> Column:
        return F.array_join(F.filter(F.array(*(F.when(F.size(at[x]) > 0, x) for x in sorted(labels))), lambda x: x.isNotNull()), ",")

    out = F.struct(
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base).cast("long").alias("first_word"),
        F.array_max(base).cast("long").alias("last_word"),
        names_of([*BASE.values()]).alias("base_labels"),
        names_of([*ALL]).alias("labels"),
        F.least(F.lit(1.0), F.greatest(*fits.values())).alias("score"),
    )
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), out.alias(result))


def _shift(whole: str, phrase: str) -> int:
    w, p = whole.split(), phrase.split()
    return next(i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)
