"""Buckets, set similarities and the fuzzy join of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, StructType

from ..functions.text import alnum_normalize, normalize, strict_normalize
from .reference_pairs import compare

#: Classes of references, of gold or of guesses, that a group of :func:`fuzzy_match` holds, about; fewer if their titles are longer than ``LONG`` on average.
GROUP, LONG = 8192, 128


def words(c: Column, most: int = 40) -> Column:
    return F.slice(F.filter(F.split(alnum_normalize(c), " "), lambda w: w != ""), 1, most)


def word_ngrams(ws: Column, n: int, truncated: bool = True) -> Column:
    """Windows of ``n`` words joined by ``_``; a shorter text gives one window of all its words if ``truncated``."""
    size = F.size(ws)
    full = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), "_"))
    empty = F.array().cast("array<string>")
    return F.when(size >= n, full).when((size > 0) & F.lit(truncated), F.array(F.array_join(ws, "_"))).otherwise(empty)


def buckets(rows: DataFrame, id_col: str, c: Column, n: int, truncated: bool = True, reverse: bool = False, frequent: DataFrame | None = None, cutoff: int | None = None, upto: int = 1) -> DataFrame:
    """``id, bucket``: the first ``upto`` n-grams of each row that are not too frequent (``frequent``: ngram, freq)."""
    # a row of its own for the words: inside the windows' lambda they would be made anew for each window
    rows = rows.select(F.col(id_col).alias("id"), (F.reverse(words(c)) if reverse else words(c)).alias("ws"))
    grams = word_ngrams(F.col("ws"), n, truncated)
    if frequent is None or cutoff is None:
        return rows.select("id", F.explode(F.slice(grams, 1, upto)).alias("bucket"))
    found = rows.select("id", F.posexplode(grams).alias("at", "bucket"))
    found = found.join(frequent.filter(F.col("freq") >= cutoff).select(F.col("ngram").alias("bucket")), "bucket", "left_anti")
    place = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return found.withColumn("k", place).filter(F.col("k") <= upto).select("id", "bucket")


def jaccard(a: Column, b: Column) -> Column:
    """Null for two empty sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def char_grams(c: Column, n: int = 3) -> Column:
    """Different windows of ``n`` characters; one for a shorter text, none for the empty one."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n))))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(many)


def ngram_similarity(a: Column, b: Column) -> Column:
    """(J + F C) / (1 + F) of two gram sets, where F grows with the smaller set: 1.2 ** (size - 10), at most 1e5."""
    both, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    f = F.least(F.pow(F.lit(1.2), least - 10), F.lit(100000.0))
    j = F.try_divide(both, F.size(a) + F.size(b) - both)
    return (j + f * F.try_divide(both, least)) / (1 + f)


def prefix_suffix(a: Column, b: Column) -> Column:
    """w / (w + 0.5) if one title begins or ends with the other, w the shorter one's words; else null."""
    w = F.size(F.split(F.when(F.length(a) <= F.length(b), a).otherwise(b), " "))
    inside = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)
    return F.when(inside, w / (w + 0.5))


def fuzzy_match(gold: DataFrame, guess: DataFrame, accept: float = 0.94, near: float = 0.8) -> DataFrame:
    """``paper, guess_id, gold_id, score``: the best accepted gold reference of each guess.

    Both have ``paper, id, title, authors, year``. Candidates share a bucket within the paper: three shortened title
    words, or three of the authors' last names. Titles score by their character grams; above ``near`` the authors
    count as well where the years are equal. Ties (scores equal to nine digits) go to the smaller gold id.

    References of a paper with one title and one list of authors are a class. Classes are compared, not references, so
    copies add no pairs; a class's smallest gold id, and that of each year, stand for its references. A paper's classes
    are compared in one group, or in as many as its parts of about ``GROUP`` classes have pairs; pairs stay in the task.
    """
    digest = F.unhex(F.md5(F.to_json(F.struct("title", "authors")))).alias("class")
    gold, guess = (d.filter("paper is not null and title is not null and authors is not null") for d in (gold, guess))

    def prepared(d: DataFrame, *more: str) -> DataFrame:
        title = normalize("title")
        lasts = F.transform("authors", lambda a: strict_normalize(F.try_element_at(F.split(a, " "), F.lit(-1))))
        short = F.transform(F.filter(F.split(alnum_normalize("title"), " "), lambda w: w != ""), lambda w: F.left(w, F.lit(3)))
        d = d.select("paper", digest, title.alias("title"), lasts.alias("lasts"), short.alias("short"), *more)
        keys = F.concat(F.transform(word_ngrams(F.col("short"), 3, False), lambda x: F.concat(F.lit("t:"), x)), F.transform(word_ngrams(F.col("lasts"), 3, True), lambda x: F.concat(F.lit("a:"), x)))
        # no filter on these: it would be pushed below the grouping, to each reference
        return d.select("paper", "class", "title", F.array_distinct("lasts").alias("lasts"), F.array_distinct(keys).alias("keys"), *more)

    p = prepared(guess.groupBy("paper", "title", "authors").agg(F.collect_set("year").alias("years")), "years")
    g = gold.groupBy("paper", "title", "authors", "year").agg(F.min("id").alias("id"))
    g = g.groupBy("paper", "title", "authors").agg(F.min("id").alias("gold_id"), F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", "id"))).alias("in_year"))
    g = prepared(g.select("*", F.col("in_year.year").alias("years"), F.col("in_year.id").alias("ids")), "gold_id", "years", "ids")

    many = lambda side: F.approx_count_distinct(F.when(F.col("side") == side, F.xxhash64("title", "authors")), 0.1)
    parts = lambda side: F.ceil(many(side) * F.greatest(F.avg(F.when(F.col("side") == side, F.length("title"))) / LONG, F.lit(1.0)) / GROUP)
    both = guess.select("paper", "title", "authors", F.lit(0).alias("side")).unionByName(gold.select("paper", "title", "authors", F.lit(1).alias("side")))
    large = F.broadcast(both.groupBy("paper").agg(parts(0).alias("n"), parts(1).alias("m")).filter("n > 1 or m > 1"))
    tasks = 4 * guess.sparkSession.sparkContext.defaultParallelism

    def dealt(d: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("class"), F.coalesce(F.greatest(own, F.lit(1)), F.lit(1))).alias(own)
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.greatest(other, F.lit(1)), F.lit(1)) - 1)).alias(other)
        d = d.join(large, "paper", "left").select(*(F.col(c).alias(c) for c in d.columns), part, every)  # names of its own, if both sides come of one table
        return d.repartition(tasks, "paper", "n", "m").groupBy("paper", "n", "m")

    kind = lambda d, c: d.schema[c].dataType
    made = StructType().add("paper", kind(guess, "paper")).add("class", BinaryType()).add("year", kind(guess, "year")).add("gold_id", kind(gold, "id")).add("score", DoubleType())
    found = dealt(p, "n", "m").cogroup(dealt(g, "m", "n")).applyInArrow(compare(accept, near, to_arrow_schema(made)), made)
    found = found.groupBy("paper", "class").agg(F.collect_list(F.struct("year", "score", "gold_id")).alias("found"))

    fits = F.filter("found", lambda m: m["year"].isNull() | (m["year"] == F.col("year")))
    first = F.array_min(F.transform(fits, lambda m: F.struct((-F.round(m["score"], 9)).alias("place"), m["gold_id"].alias("gold_id"), m["score"].alias("score"))))
    rows = guess.select("paper", F.col("id").alias("guess_id"), digest, "year").join(found, ["paper", "class"]).select("paper", "guess_id", first.alias("m")).filter("m is not null")
    return rows.groupBy("paper", "guess_id").agg(F.min("m").alias("m")).select("paper", "guess_id", "m.gold_id", "m.score")
