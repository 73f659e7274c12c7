"""Ingestion and DML: validity, first-wins deduplication, upserts, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(rows: DataFrame, *needed: str) -> DataFrame:
    """Rows whose needed columns hold more than white space."""
    for c in needed:
        rows = rows.filter(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    return rows


def survivors(rows: DataFrame, key: Column, ident: str) -> DataFrame:
    """(ident, survivor, group_size): the least ident of each key.  Aggregated first, then joined back."""
    keyed = rows.select(ident, key.alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(ident).alias("survivor"), F.count(F.lit(1)).alias("group_size"))
    return keyed.join(first, "_key").select(ident, "survivor", "group_size")


def first_wins(rows: DataFrame, key: Column, ident: str) -> DataFrame:
    """Rows that are the first of their key."""
    kept = survivors(rows, key, ident).filter(F.col(ident) == F.col("survivor")).select(ident)
    return rows.join(kept, ident, "left_semi")


def repointed(edges: DataFrame, mapping: DataFrame, ident: str) -> DataFrame:
    """Edges of merged rows moved to their survivors; unmapped ids stay, duplicates collapse."""
    m = mapping.select(ident, F.col("survivor"))
    return edges.join(m, ident, "left").withColumn(ident, F.coalesce("survivor", ident)).drop("survivor").distinct()


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and the first new row of each key that is not there yet."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c) for c in new.columns if c not in keys]))
    return old.unionByName(fresh.withColumn("_n", rank).filter("_n = 1").drop("_n").select(*old.columns))


def insert_replace(old: DataFrame, new: DataFrame, keys: list[str], turn: str) -> DataFrame:
    """The last row of each key: new ones stand above old ones, later turns above earlier ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    payload = F.struct(*(F.col(c) for c in old.columns))
    last = both.groupBy(*keys).agg(F.max_by(payload, F.struct("_new", turn)).alias("_row"))
    return last.select("_row.*")


def update(old: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``old`` with ``column`` set where ``changes`` has a value, and whether it did."""
    c = changes.select(*keys, F.col(column).alias("_value"))
    return old.join(c, keys, "left").withColumn("updated", F.col("_value").isNotNull()).withColumn(column, F.coalesce("_value", column)).drop("_value")


def orphans(rows: DataFrame, parents: DataFrame, column: str, parent: str) -> DataFrame:
    """Rows that point to no parent."""
    return rows.join(parents.select(F.col(parent).alias(column)).distinct(), column, "left_anti")


def conservation(before: DataFrame, after: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts that a migration must keep: rows in, rows out, merged rows, and whether they add up."""
    one = before.agg(F.count(F.lit(1)).alias("rows_in")).crossJoin(after.agg(F.count(F.lit(1)).alias("rows_out"))).crossJoin(mapping.agg(F.sum((F.col("survivor") != F.col(mapping.columns[0])).cast("long")).alias("merged")))
    return one.select("rows_in", "rows_out", "merged", (F.col("rows_in") == F.col("rows_out") + F.col("merged")).alias("conserved"))


def numbered(rows: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """Ids from 1 in the order of business keys, by sorted ranges and their sizes; no single task sees all rows."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    sizes = sorted_.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each partition
    return sorted_.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(ident, F.coalesce("_before", F.lit(0)) + within).drop("_part", "_at", "_before")


def sample(rows: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn by a digest of seed and keys: the same rows however the input is laid out.

    Each task keeps its own first ``n``; nothing is sorted as a whole.
    """
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))).limit(n)
