"""Exact deduplication by a stateful stream.

A scan writes a log of (digest, identifier, content locator) rows.  A stream over that
log keeps, for each digest, the best row seen and a count in RocksDB state on disk, which
never expires; given the same state folder again, it goes on where it stopped.  Equal
rows are combined before they cross the network.  Rows whose digest the state has seen
more than once are hits: their whole normalised texts are compared, again combined
before the exchange, and a digest that stands for several texts is split by text.

Null counts as empty.  Of equal rows (ties in length and doc_id) one locator stays; a
null doc_id ranks last.  Texts of any length are compared whole.  An empty table gives an
empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from weftline.llm.common import materialize, work_dir

#: State lies in RocksDB; a store for each of many partitions allocates no space ahead.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Repeated digests that are broadcast to find their rows; more are joined by a shuffle.
BROADCAST_DIGESTS = 500_000


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", "")


def sha(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _located(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows with the file and the place in it that hold their content; rows that come from no file are
    written first, below ``folder``."""
    columns = ["doc_id", F.col("text").cast("string").alias("text")]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*columns, *place)
    except AnalysisException:
        spark, rows = docs.sparkSession, docs.select(*columns)
        path = f"{folder}/content/{uuid.uuid4().hex}" if folder else work_dir(spark, "content")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path).select(*columns, *place)


def observe(log: DataFrame, log_path: str, state_path: str) -> DataFrame:
    """Streams the log into keyed state and returns the state: digest, n, best."""
    spark = log.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(log.schema).parquet(log_path)
        best = F.struct((-F.col("n")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
        seen = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(state_path)
    return state.select(F.col("key.digest").alias("digest"), F.col("value.count").alias("n"), F.col("value.min").alias("best"))


def _earlier(log: DataFrame, call: str, digests: DataFrame) -> DataFrame:
    """digest, normalised text and locator of the rows that earlier calls saw under ``digests``, read through their locators."""
    spark = log.sparkSession
    found = materialize(log.filter(F.col("call") != call).drop("call").join(digests, "digest", "left_semi"), "earlier")
    files = [r["file"] for r in found.select("file").distinct().collect()]  # names of input files
    if not files:
        return found.withColumn("norm", F.lit("")).limit(0)
    content = spark.read.parquet(*files).select(F.col("text").cast("string").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return found.join(content, ["file", "row"]).select(*found.columns, normal(F.col("text")).alias("norm"))


def dedup(docs: DataFrame, state_path: str | None = None, digest: Callable[[Column], Column] = sha) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, digest (of the normalised text), n_chars, file, row.

    ``state_path`` holds log and state.  A later call with it goes on: its rows are grouped with all that earlier
    calls saw, whose texts are read again through their locators where whole bytes must be compared.
    """
    spark = docs.sparkSession
    base = state_path or work_dir(spark, "digests")
    log_path, call = f"{base}/log", uuid.uuid4().hex
    rows = _located(docs, state_path)
    content = rows.select("doc_id", "file", "row", F.length(F.coalesce("text", F.lit(""))).alias("n"), normal(F.col("text")).alias("norm"))
    content = content.withColumn("digest", digest(F.col("norm")))
    content.drop("norm").write.parquet(f"{log_path}/call={call}")
    own = content.drop("norm").schema
    log = spark.read.schema(own.add("call", "string")).option("basePath", log_path).parquet(log_path)
    mine = log.filter(F.col("call") == call).drop("call")
    if mine.isEmpty():
        return _result(mine.withColumns({"size": F.lit(1).cast("long"), "best": F.struct("doc_id", "file", "row")}))

    state = observe(log, log_path, f"{base}/state")
    repeated = state.filter("n > 1").select("digest", F.col("n").alias("size"), F.col("best").dropFields("shorter", "no_id").alias("best"))
    goes_on = not log.filter(F.col("call") != call).isEmpty()
    if goes_on:  # only digests of this call's rows
        repeated = repeated.join(mine.select("digest").distinct(), "digest", "left_semi")
    repeated = materialize(repeated, "repeated")
    few = repeated.count() <= BROADCAST_DIGESTS
    side = (lambda x: F.broadcast(x)) if few else (lambda x: x)

    # Whole bytes on hits: one row for each text, task and digest reaches the exchange.
    hits = content.join(side(repeated.select("digest")), "digest", "left_semi")
    if goes_on:
        hits = hits.unionByName(_earlier(log, call, repeated.select("digest")))
    best = F.struct((-F.col("n")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")
    texts = hits.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("size"), F.min(best).dropFields("shorter", "no_id").alias("best"))
    clashes = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "clashes")

    joined = mine.join(side(repeated), "digest", "left")
    if clashes.isEmpty():
        return _result(joined)
    clashing = content.join(clashes, "digest", "left_semi").join(texts.join(clashes, "digest", "left_semi"), ["digest", "norm"])
    whole = joined.join(clashes, "digest", "left_anti")
    return _result(whole.unionByName(clashing.select(*whole.columns)))


def _result(rows: DataFrame) -> DataFrame:
    alone = F.col("best").isNull()
    stays = alone | ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row")))
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        stays.alias("kept"),
        "digest",
        F.col("n").alias("n_chars"),
        "file",
        "row",
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
