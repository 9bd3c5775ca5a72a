"""Bags of words, stride samples and gazetteers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gazetteer_key, tokenize, within_length


def bag(texts: DataFrame, c: str, which: str = "all") -> DataFrame:
    """``token, n``: all, the first or the last tokens of a string column."""
    t = tokenize(F.col(c))
    if which == "all":
        tokens = texts.select(F.explode(t).alias("token"))
    else:
        tokens = texts.select(F.try_element_at(t, F.lit(1 if which == "first" else -1)).alias("token"))
    return tokens.filter(F.col("token").isNotNull() & (F.col("token") != "")).groupBy("token").agg(F.count("*").alias("n"))


def stride_sample(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows at even distances in the given order: those at which i * n / total passes a whole number.

    The place of a row comes from counts below it by range partition, so no task sorts all rows.
    """
    parts = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    return _numbered(parts, order).filter(F.floor(F.col("__i") * n / F.col("__total")) > F.floor((F.col("__i") - 1) * n / F.col("__total"))).drop("__i", "__total", "__part")


def _numbered(parts: DataFrame, order: str) -> DataFrame:
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(F.lit(1))).alias("__total"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return parts.withColumn("__own", own).join(before, "__part").withColumn("__i", F.col("__own") + F.col("__before")).drop("__own", "__before")


def gazetteer(entries: DataFrame, name: str = "gazetteer", entry: str = "entry") -> DataFrame:
    """``gazetteer, key``: entries that are no comment, not blank and at most seven words."""
    kept = entries.filter(~F.col(entry).startswith("#") & (F.trim(entry) != "") & within_length(F.col(entry)))
    return kept.select(F.col(name).alias("gazetteer"), gazetteer_key(F.col(entry)).alias("key")).distinct()


def membership(keys: DataFrame, gaz: DataFrame, names: list[str]) -> DataFrame:
    """A boolean column for each gazetteer: whether it has the row's ``key``. One join; the gazetteer is pivoted by key."""
    wide = gaz.groupBy("key").agg(*[F.max(F.col("gazetteer") == n).alias(n) for n in names])
    return keys.join(wide, "key", "left").fillna(False, names)


def spans(tokens: DataFrame, gaz: DataFrame, most: int = 6) -> DataFrame:
    """``doc_id, line_no, start, stop, gazetteer``: runs of 1 to ``most`` tokens of a line that are an entry.

    ``tokens`` has ``doc_id, line_no, toks`` (an array a line; a token holds no newline). Runs are made only at tokens whose word begins
    an entry, and only as long as an entry with that word can be; the first words of entries are broadcast, the entries themselves
    meet the runs in an equi-join on the key.
    """
    word = lambda key: F.substring_index(key, " ", 1)
    longest = gaz.groupBy(word("key").alias("word")).agg(F.max(F.size(F.split("key", " "))).alias("longest"))
    # a token that is no word begins runs with the keys of the runs after it, whatever their first word
    longest = longest.filter("word != ''").union(gaz.sparkSession.range(1).select(F.lit(""), F.lit(2**31 - 1)))
    # a line's tokens are cleaned together
    keys = F.split(gazetteer_key(F.concat(F.array_join("toks", "\n", ""), F.lit("\n"))), " ?\n ?")
    keyed = tokens.filter(F.size("toks") > 0).select("doc_id", "line_no", F.slice(keys, F.lit(1), F.size("toks")).alias("keys"))
    begins = F.transform("keys", lambda k, i: F.struct(i.alias("start"), word(k).alias("word")))
    begins = keyed.select("doc_id", "line_no", "keys", F.inline(begins)).join(F.broadcast(longest), "word")
    begins = begins.withColumn("run", F.slice("keys", F.col("start") + 1, most))
    key = lambda k: F.array_join(F.filter(F.slice("run", F.lit(1), k), lambda x: x != ""), " ")
    runs = F.transform(F.sequence(F.lit(1), F.size("run")), lambda k: F.struct((F.col("start") + k).alias("stop"), key(k).alias("key")))
    rows = begins.select("doc_id", "line_no", "start", "longest", F.inline(runs)).filter(F.size(F.split("key", " ")) <= F.col("longest"))
    return rows.join(gaz, "key").select("doc_id", "line_no", "start", "stop", "gazetteer")


def span_labels(found: DataFrame) -> DataFrame:
    """``doc_id, line_no, pos, feature``: B, I and E (or W for one token) of each span's tokens."""
    rows = found.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    kind: Column = F.when(F.col("stop") - F.col("start") == 1, "W").when(F.col("pos") == F.col("start"), "B").when(F.col("pos") == F.col("stop") - 1, "E").otherwise("I")
    return rows.select("doc_id", "line_no", "pos", F.concat(F.lit("%gaz_"), kind, F.lit("_"), "gazetteer").alias("feature"))
