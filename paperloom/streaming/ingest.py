"""Streams: files as they arrive, and the latest feedback for each paper. Extensions; batch queries do not need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.control import latest_per_key


def arriving_files(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """A stream of ``path, modificationTime, length, content`` of new files."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)


def arriving_rows(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(rows: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by key and tumbling window; state older than ``late`` is dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def upsert_latest(rows: DataFrame, path: str, key: str, time: str, checkpoint: str):
    """Keep one parquet folder of the latest row a key: each batch merges with what is there and replaces it.

    Two folders take turns, so that a batch reads one and writes the other; a batch that is repeated after a failure
    writes the same rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(f"{path}/{(number + 1) % 2}") if number else None
        both = batch if old is None else old.unionByName(batch)
        latest_per_key(both, key, time).write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
