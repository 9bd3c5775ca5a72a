"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A document's key is exponential: -ln(u) / weight, with u from a hash of its id, so that heavier documents
come first more often. A source's target is met by complete epochs and then, in the order of the keys, by
documents until the running sum of sizes reaches what is left.

No source is sorted in one task. Keys map monotonically to (0, 1) and fall into slots; with the least weight of the
source as the rate of that map no slot is expected to hold over some thousand rows, whatever the weights. Sums by slot show in which one the running sum reaches the rest, and only that slot
is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``index``: the place of each row, from 0, in the given order; without sorting in one task."""
    parts = cut(df.orderBy(*order).withColumn("part", F.spark_partition_id()))
    parts = parts.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    return parts.join(before, "part").withColumn("index", F.col("before") + F.col("row") - 1).drop("part", "row", "before")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (a row a source).

    Sources in code point order, null last, take the weights in turn and share ``share`` times the sum of all
    sizes by weight; none gets over ``most`` times its size, and the excess is shared anew by weight. Each
    round fixes the sources at their limit; it ends when no other is above. Where all reach their limit
    (``share`` above ``most``) the limits stand.
    """
    turn = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("index"), F.lit(len(weights))).cast("int"))
    found = cut(numbered(sizes, F.col("source").asc_nulls_last()).select("source", "source_size", turn.alias("weight"), (most * F.col("source_size")).alias("limit")))
    total, all_weight = found.agg(F.sum("source_size"), F.sum("weight")).first()
    total, rate = share * (total or 0), 0.0
    if all_weight:
        rate = total / all_weight
        while True:
            full = F.col("limit") <= rate * F.col("weight")
            fixed, weight = found.agg(F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
            if not weight or (total - fixed) / weight <= rate:
                break
            rate = (total - fixed) / weight
    return found.select("source", "source_size", F.least("limit", F.lit(rate) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weight: Column | None = None, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), seed: int = 7, slot_rows: int = 4_000) -> DataFrame:
    """``id, source, size, source_size, target, epochs, taken`` for every row.

    ``size`` defaults to the number of words of ``text``, ``weight`` (the quality; null or not above 0 counts as 1) to 1.
    ``epochs`` says how often the mix takes the row, ``taken`` = epochs x size. A row is taken in the last, partial
    epoch if the middle of its share of the running sum lies below what is left, so the sum differs from the
    target by half a document at most. Equal keys are ordered by id. Reruns give the same mix; rows with
    the same id, source and size are alike. Rows of size 0 take part without effect on the sums. Sources of
    size 0 have target 0. An empty table gives no rows.
    """
    size = word_count(F.col("text")) if size is None else size
    weight = F.lit(1.0) if weight is None else weight
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.when(weight > 0, weight).otherwise(1.0).cast("double").alias("weight")))

    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("weight").alias("least"), F.sum("weight").alias("weights"))
    aims = targets(sums.select("source", "source_size"), share, most, weights)
    aims = aims.alias("a").join(sums.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source"))).select("a.source", "a.source_size", "target", "least", "weights")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("slots", F.ceil(F.col("weights") / F.col("least") / slot_rows))
    aims = cut(aims)

    u = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) + 0.5) * F.lit(2.0**-53)
    key = -F.log(u) / F.col("weight")
    keyed = rows.join(aims, rows.source.eqNullSafe(aims.source)).drop(aims.source).withColumn("key", key)
    keyed = keyed.withColumn("slot", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("least"))) * F.col("slots")), F.col("slots") - 1))
    keyed = cut(keyed.drop("least", "weights", "slots", "weight"))

    slots = keyed.groupBy("source", "slot").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"))
    in_source = Window.partitionBy("source").orderBy("slot")
    slots = slots.withColumn("before", F.sum("held").over(in_source) - F.col("held"))
    slots = cut(slots.withColumn("state", F.when(F.col("before") + F.col("held") <= F.col("rest"), "in").when(F.col("before") >= F.col("rest"), "out").otherwise("edge")).drop("held", "rest"))
    held = keyed.join(slots, keyed.source.eqNullSafe(slots.source) & (keyed.slot == slots.slot)).drop(slots.source).drop(slots.slot)
    in_slot = Window.partitionBy("source", "slot").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = held.filter("state = 'edge'").withColumn("upto", F.col("before") + F.sum("size").over(in_slot))
    edge = edge.withColumn("more", (F.col("upto") - F.col("size") / 2 < F.col("rest")).cast("long"))
    other = held.filter("state <> 'edge'").withColumn("more", (F.col("state") == "in").cast("long"))
    columns = ["id", "source", "size", "source_size", "target", (F.col("whole") + F.col("more")).cast("long").alias("epochs")]
    out = other.select(*columns).union(edge.select(*columns))
    return out.withColumn("taken", F.col("epochs") * F.col("size")).withColumnRenamed("id", id_col)
