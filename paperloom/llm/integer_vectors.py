"""Vectors of integers, as the exact searches by inner product use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def integer_vectors(df: DataFrame, factor: int, id_col: str, vector_col: str, label: Column | None = None) -> DataFrame:
    """``id, v`` and, if one is given, ``label``: each component x of a vector becomes ``floor(factor * x)``.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows whose id or label is
    null, nor vectors of another length than most. Ids that repeat count once (the smallest label, then the
    smallest vector). A component that doesn't fit a long becomes the nearest one that does.
    """
    x, named = F.col(vector_col), F.lit(0) if label is None else label
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & x.isNotNull() & named.isNotNull() & fine)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), named.cast("long").alias("label"), F.transform(x.cast("array<double>"), lambda c: F.floor(c * factor).cast("double")).alias("v"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (lengths.n if lengths else 0))
    return rows.drop("label") if label is None else rows


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """float64 where no sum of products of rows of ``a`` and ``b`` can leave the integers that it holds; else Python's integers."""
    if not len(a) or not len(b):
        return np.float64
    return np.float64 if float(np.abs(a).sum(axis=1).max()) * float(np.abs(b).max(initial=0)) < 2.0**52 else object


def as_type(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is np.float64:
        return x
    return np.array([int(c) for c in x.ravel()], object).reshape(x.shape)


def as_long(x: np.ndarray) -> np.ndarray:
    """Integers as longs; those beyond a long become the nearest one."""
    return x.astype(np.int64) if x.dtype != object else np.array([min(MOST, max(LEAST, c)) for c in x.ravel()], np.int64).reshape(x.shape)


def smallest_copies(ids: np.ndarray, keep: int, *columns: np.ndarray) -> np.ndarray:
    """Row numbers without those that ``keep`` rows of smaller ids equal in all columns: no list of the best ``keep`` by score, ties to smaller ids, can hold them."""
    if not len(ids):
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, *columns))
    new = np.ones(len(ids), bool)
    if columns:
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    start = np.flatnonzero(new)
    place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
    return np.sort(order[place < keep])
