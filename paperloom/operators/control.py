"""Control over inputs: fallback, exclusion, interleaving, ranges, feedback and serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fallback(ids: DataFrame, *sources: DataFrame, key: str = "id", value: str = "content") -> DataFrame:
    """For each id the value of the first source that has one; null if none has."""
    out = ids.select(key)
    for i, s in enumerate(sources):
        out = out.join(s.select(key, F.col(value).alias(f"__{i}")), key, "left")
    return out.select(key, F.coalesce(*[F.col(f"__{i}") for i in range(len(sources))]).alias(value))


def resume(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key the output does not hold yet."""
    return inputs.join(done.select(key), key, "left_anti")


def union_of_keys(*columns: DataFrame, key: str = "id") -> DataFrame:
    """Tables of a key and one value each over all keys; a value that is missing is null. One aggregation."""
    names = [next(c for c in d.columns if c != key) for d in columns]
    rows = None
    for d, name in zip(columns, names, strict=True):
        part = d.select(key, *[(F.col(n) if n == name else F.lit(None).cast(columns[j].schema[n].dataType)).alias(n) for j, n in enumerate(names)])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(*[F.max(n).alias(n) for n in names])


def quantiles(rows: DataFrame, by: str, pieces: int = 200) -> list[float]:
    """Numbers that cut the rows into at most ``pieces`` ranges of about equal size."""
    return sorted(set(rows.approxQuantile(by, [i / pieces for i in range(1, pieces)], 0.25 / pieces)))


def numbered(rows: DataFrame, by: str, group: str | None = None, cuts: list[float] | None = None) -> DataFrame:
    """Add ``index``: the place of each row, from 0, in the order of the number ``by`` (null first), within ``group`` if one is given.

    No group is sorted in one task: ``cuts`` (by default the quantiles of ``by``) make ranges, counts by range give how
    many come before, and rows are numbered within their range. Rows that share a number are in one range; make ``by`` (nearly)
    unique.
    """
    cuts = quantiles(rows, by) if cuts is None else cuts
    keys = [group, "_range"] if group else ["_range"]
    at = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(by))) if cuts else F.lit(0)
    ranged = rows.withColumn("_range", F.when(F.col(by).isNull(), -1).otherwise(at))
    counts = ranged.groupBy(*keys).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(group) if group else Window.partitionBy()
    before = counts.select(*keys, (F.sum("_n").over(running.orderBy("_range")) - F.col("_n")).alias("_before"))
    out = ranged.join(before, keys).withColumn("index", F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first(by))) - 1)
    return out.drop("_range", "_before")


def interleave(*sources: DataFrame, order: str) -> DataFrame:
    """Add ``turn`` and ``source``: rows take turns by source, and exhausted sources are skipped."""
    out = None
    for i, s in enumerate(sources):
        part = s.withColumn("source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return numbered(out, order, "source").withColumn("turn", (F.col("index") + 1).cast("int")).drop("index")


def drop_take(rows: DataFrame, skip: int, take: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(take)


def hash_split(c: Column, share: float) -> Column:
    """True for about ``share`` of the keys, by their MD5; the same on every run and engine."""
    return F.conv(F.left(F.md5(c.cast("string")), F.lit(8)), 16, 10).cast("long") < int(share * 2**32)


def replace_values(rows: DataFrame, replacements: DataFrame, c: str) -> DataFrame:
    """Values of ``c`` by the map ``old, new`` where it has them."""
    return rows.join(replacements, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")


def latest_per_key(log: DataFrame, key: str, time: str, *tie: str) -> DataFrame:
    """The last row of each key; ties by the further columns. An arg-max aggregation: no sort of a key's rows."""
    rest = [c for c in log.columns if c not in (key, time)]
    row = log.groupBy(key).agg(F.max_by(F.struct(time, *rest), F.struct(time, *tie)).alias("r"))
    return row.select(key, *[F.col(f"r.{c}").alias(c) for c in (time, *rest)])


def latest_in_window(log: DataFrame, key: str, time: str, start: Column | None, end: Column | None, *tie: str) -> DataFrame:
    """The latest rows of all keys that lie in [start, end): filtered after choosing."""
    out = latest_per_key(log, key, time, *tie)
    out = out if start is None else out.filter(F.col(time) >= start)
    return out if end is None else out.filter(F.col(time) < end)
