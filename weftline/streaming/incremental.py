"""Extraction over a folder that receives files: an extension of the batch operators.

New files are read once; a record of an identifier that came before, within the
watermark, is dropped by state; terms are found with the batch operator in each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from weftline.operators import extract


def arriving(spark, path: str, schema: StructType, ident: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows of new Parquet files, each identifier once (within ``delay`` of event time, if there is one)."""
    rows = spark.readStream.schema(schema).parquet(path)
    if event_time is None:
        return rows.dropDuplicates([ident])
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([ident])


def extract_terms(rows: DataFrame, terms: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes (doc_id, skill_id) of all rows that are there, then stops; called again, it goes on.

    A batch that is repeated after a failure overwrites its own folder, so nothing is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = extract.occurrences(batch.select("doc_id", "text"), terms).select("doc_id", "skill_id")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
