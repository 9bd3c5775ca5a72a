"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors must share.

    Only where the session names none and all runs on one machine, as in tests, is a temporary one set.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables in the shared folder that steps of a loop hand on, and that are removed once nothing reads them.

    Unlike ``cut``, a table forgets what the planner knew of the rows (``x != y``, ``z = coalesce(x, y)``), which multiplies
    from round to round of a loop until planning takes minutes. Free a table only when all that was made of it is
    itself a table: a lost executor's work is then done again from what is left.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        folder = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.held.append((out, folder))
        return out

    def free(self, *tables: DataFrame) -> None:
        self._keep([t for t, _ in self.held if not any(t is x for x in tables)])

    def free_all_but(self, *tables: DataFrame) -> None:
        self._keep(list(tables))

    def _keep(self, tables: list[DataFrame]) -> None:
        left = []
        for table, folder in self.held:
            if any(table is x for x in tables):
                left.append((table, folder))
            else:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.held = left


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes the partitioning of what follows."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text (one row may be larger)."""
    for batch in batches:
        sizes = np.diff(utf8_buffer(batch.column(text_col))[1])
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
