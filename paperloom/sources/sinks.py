"""Writers: JSON lines that grow, one file a document, gazetteers, weights, and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.control import resume


def append_json(rows: DataFrame, path: str, key: str | None = None) -> None:
    """Append rows as JSON lines; with ``key``, only those whose key the folder does not hold yet."""
    if key is not None:
        try:
            rows = resume(rows, rows.sparkSession.read.schema(rows.schema).json(path), key)
        except Exception as e:  # the first run finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def json_by_document(rows: DataFrame, path: str, key: str) -> None:
    """A folder of JSON for each document."""
    rows.write.mode("overwrite").partitionBy(key).json(path)


def as_json(rows: DataFrame, *skip: str) -> DataFrame:
    """One column ``json`` a row, without the fields to skip; nulls are kept."""
    kept = rows.drop(*skip)
    return kept.select(F.to_json(F.struct(*kept.columns), {"ignoreNullFields": "false"}).alias("json"))


def feature_matrix(features: DataFrame, wide: int = 50) -> DataFrame:
    """``id, binary`` and a column for each of the ``wide`` most frequent other features of ``id, feature, value``.

    Features that are only ever 1 are listed in ``binary``; the others are pivoted by falling frequency.
    """
    kinds = features.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n"))
    names = [r.feature for r in kinds.filter("not (a = 1 and b = 1)").orderBy(F.desc("n"), "feature").limit(wide).collect()]
    binary = features.join(kinds.filter("a = 1 and b = 1").select("feature"), "feature").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("feature")), " ").alias("binary"))
    if not names:
        return binary
    matrix = features.filter(F.col("feature").isin(names)).groupBy("id").pivot("feature", names).agg(F.first("value"))
    return matrix.join(binary, "id", "full_outer")


def save_weights(weights: DataFrame, path: str, version: int = 1) -> None:
    weights.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_weights(spark, path: str, version: int = 1) -> DataFrame:
    rows = spark.read.parquet(path)
    found = {r.version for r in rows.select("version").distinct().collect()}  # a value, if the file is sound
    if found != {version}:
        raise ValueError(f"{path} holds version {found}, not {version}")
    return rows.drop("version")
