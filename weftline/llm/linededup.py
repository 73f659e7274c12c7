"""Line deduplication with DataFrame operations only.

Lines are exploded with their position, their normalised keys hashed to 128 bits, the
smallest and largest document of each hash aggregated (map-side first) and written, and
lines of a repeated key marked in every document but the smallest.  The written keys are
joined with the lines anew: small ones are broadcast, and a join that stays a shuffle has
an exchange of its own, so Spark splits the lines of a hot key over tasks.  Marks travel
only to the documents that have any, as positions; each of those texts is put together
again from its other positions.  Other texts are not shuffled as long as the marked
documents' ids are few enough to be broadcast (MARKED_ROWS).

Null and empty texts are one empty line.  doc_id may be of any type that has an order; a
null doc_id ranks last; rows that repeat doc_id and text are treated alike and count as
one document, as do all rows of one doc_id where documents of a key are counted.  Texts of
any length are taken whole; an empty table gives an empty result.  Input columns of any
name are kept; results stand in one added struct column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize

#: White space that is stripped from a key: U+0020 and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 10
#: Marked documents (an id and a hash each) that are broadcast to leave all others where they are.
MARKED_ROWS = 2_000_000


def key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case, nothing else changed."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup(docs: DataFrame, least: int = LEAST, result: str = "line_dedup") -> DataFrame:
    """``docs`` and a struct ``result``: n_lines, n_dropped, kept_text."""
    tag = "_" * (1 + max(map(len, docs.columns)))  # no column of docs begins with it
    ident, row, at, first, marks, whole = (tag + x for x in ("id", "row", "at", "first", "marks", "text"))
    long_id = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)) if long_id else F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*(F.col(f"`{c}`") for c in docs.columns), rank.alias(ident), F.xxhash64(body).alias(row), body.alias(whole))
    split = lambda x: F.split(x, "\n", -1)

    lines = keyed.select(ident, row, F.posexplode(split(F.col(whole))).alias(at, "line")).select(ident, row, at, key(F.col("line")).alias("key")).filter(F.length("key") >= least)
    lines = lines.select(ident, row, at, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    repeated = lines.groupBy("h1", "h2").agg(F.min(ident).alias(first), F.max(ident).alias("last")).filter(F.col(first) < F.col("last")).drop("last")
    repeated = materialize(repeated, "repeated-lines")
    found = lines.join(repeated, ["h1", "h2"]).filter(F.col(ident) > F.col(first)).groupBy(ident, row).agg(F.collect_set(at).alias(marks))
    found = materialize(found, "line-marks")

    names = found.select(ident, row)
    if found.count() <= MARKED_ROWS:
        marked, clean = keyed.join(F.broadcast(names), [ident, row], "left_semi"), keyed.join(F.broadcast(names), [ident, row], "left_anti")
        marked = marked.join(found, [ident, row])
        parts = [marked, clean.withColumn(marks, F.lit(None).cast("array<int>"))]
    else:
        parts = [keyed.join(found, [ident, row], "left")]

    def kept(part: DataFrame) -> DataFrame:
        part, own = part.withColumn(f"{tag}lines", split(F.col(whole))), F.col(f"{tag}lines")
        left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(marks)), lambda i: F.get(own, i))
        text = F.when(F.col(marks).isNull(), F.col(whole)).otherwise(F.array_join(left, "\n"))
        out = F.struct(F.size(own).cast("long").alias("n_lines"), F.coalesce(F.size(marks), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))
        return part.select(*(F.col(f"`{c}`") for c in docs.columns), out.alias(result))

    out = kept(parts[0])
    return out if len(parts) == 1 else out.union(kept(parts[1]))


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.doc_id, pos, line, first IS NOT NULL AND keyed.doc_id > first AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
