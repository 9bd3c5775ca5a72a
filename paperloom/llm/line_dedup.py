"""Line deduplication with a suffix array over line-id sequences.

Texts are sequences of lines. Lines that occur once can be part of no repeated run, so the strings to sort are
the maximal segments of lines that recur. Prefix doubling ranks the suffixes of all segments, two doublings a round:
a rank of the first 4k lines comes from four ranks of k lines, here and k, 2k and 3k lines further on. A round sorts the
different tuples of ranks (their number is a fraction of the positions, and a frequent line is one tuple a successor) by
range and names them in order; rounds end when one splits no rank or whole segments are compared. The order of the ranks
is the suffix array.

The longest common prefix of two neighbours in it is read down the rounds: their tuples' first difference is a place and two
ranks of the round before, whose tuples differ in turn. Neighbours whose prefix has d lines or more share an interval of
depth d. The first position of an interval in the order of the ids stays; what begins at the others are later copies of
d lines. Of the maximal repeated runs those of ``min_words`` words or more are deleted at their later places.

Not all depths need a look. A line lies in such a run if and only if it lies in a repeated run of ``min_words`` words that
can't lose its last line, or its first line, without having fewer words. At a position these are the runs from the
shortest one there to as many lines as the shortest one at the next position has: two a position, on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .mixing import word_count

_DOC = ["id", "hash"]
_TUPLE = ["rank", "x1", "x2", "x3"]


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines that have words: id, hash of the text, place, two hashes of the line, its words."""
    line = F.col("line")
    return (
        df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.posexplode(F.split(text_col, "\n")).alias("place", "line"))
        .select(*_DOC, "place", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), word_count(line).cast("int").alias("words"))
        .filter("words > 0")
    )


def _named(tuples: DataFrame, *keys: str) -> DataFrame:
    """The different keys with ``name``, which grows in their order; ``name >> 33`` is the sorted partition."""
    return cut(tuples.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).withColumn("name", F.monotonically_increasing_id()))


def suffix_ranks(positions: DataFrame, longest: int) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """Ranks of all suffixes, and of each round the lines that a rank in its tuples stands for, and the names of its tuples.

    ``positions`` has the columns id, hash, segment, seq and rank (of the line); ``longest`` is the largest number of
    lines of a segment. Two suffixes get the same rank if and only if they are the same up to the ends of their segments.
    """
    rounds, step, count = [], 1, -1
    following = Window.partitionBy(*_DOC, "segment").orderBy("seq")
    while True:
        ahead = {x: F.coalesce(F.lead("rank", j * step).over(following), F.lit(-1)) for j, x in enumerate(_TUPLE) if j}
        tuples = cut(positions.withColumns(ahead))
        names = _named(tuples, *_TUPLE)
        rounds.append((step, names))
        positions = tuples.join(names.drop("n"), _TUPLE).select(*_DOC, "segment", "seq", F.col("name").alias("rank"))
        now, step = names.count(), 4 * step
        if now == count or step >= longest:
            return positions, rounds
        count = now


def common_prefixes(rounds: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rank, lcp``: for each rank the lines that it has in common with the one before it (0 for the first)."""
    last = rounds[-1][1].select(F.col("name").alias("rank"), F.shiftright("name", 33).alias("part"), F.array(*_TUPLE).alias("v"))
    inside = Window.partitionBy("part").orderBy("rank")
    # the last tuple of a sorted partition is handed to the next one: a row a partition
    ends = last.groupBy("part").agg(F.max_by("v", "rank").alias("v")).select("part", F.lag("v").over(Window.orderBy("part")).alias("handed"))
    found = last.withColumn("u", F.lag("v").over(inside)).join(ends, "part").select("rank", F.coalesce("u", "handed").alias("u"), "v", F.lit(0).alias("lcp"))
    for i in reversed(range(len(rounds))):
        step = rounds[i][0]
        at = F.array_position(F.zip_with("u", "v", lambda a, b: a != b), True).cast("int") - 1
        found = found.withColumn("at", at).withColumn("lcp", F.col("lcp") + F.coalesce(F.col("at") * step, F.lit(0)))
        if not i:
            break
        a, b = F.get("u", F.col("at")), F.get("v", F.col("at"))
        over = F.col("at").isNull() | (a < 0) | (b < 0)  # one of them ends there; such rows ask for nothing that exists
        own = -2 - F.col("rank")
        found = found.select("rank", "lcp", F.when(over, own).otherwise(a).alias("a"), F.when(over, own).otherwise(b).alias("b"))
        parts = rounds[i - 1][1]
        for end, side in (("a", "u"), ("b", "v")):
            found = found.join(parts.select(F.col("name").alias(end), F.array(*_TUPLE).alias(side)), end, "left").drop(end)
    return cut(found.select("rank", "lcp"))


def _later(positions: DataFrame, lcps: DataFrame) -> DataFrame:
    """``rank, first, deepest, later`` of the ranks with later copies: the first position, and how many of the lines from a position
    on are a later copy, at its first position (``later``, null for none) and at the others (``deepest``).

    ``positions`` has id, hash, seq, rank and the depths ``low`` to ``high`` at which to look, null for none.
    """
    place = F.struct(*_DOC, "seq")
    ranks = positions.filter("low is not null").groupBy("rank").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("low").alias("low"), F.max("high").alias("high"))
    ranks = cut(ranks.join(lcps, "rank"))
    depths = ranks.select("rank", "first", "lcp", F.shiftright("rank", 33).alias("part"), F.explode(F.sequence("low", "high")).alias("depth"))
    # all of an interval's ranks have its depth among theirs, so it is a stretch of rows that a shorter prefix opens
    opens = F.when(F.col("lcp") < F.col("depth"), F.col("rank"))
    inside = Window.partitionBy("part", "depth").orderBy("rank")
    carried = depths.groupBy("part", "depth").agg(F.max(opens).alias("last"))
    carried = carried.select("part", "depth", F.max("last").over(Window.partitionBy("depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row a partition and depth
    depths = depths.withColumn("interval", F.last(opens, ignorenulls=True).over(inside)).join(carried, ["part", "depth"])
    depths = cut(depths.select("rank", "first", "depth", F.coalesce("interval", "carried").alias("interval")))
    firsts = cut(depths.groupBy("depth", "interval").agg(F.min("first").alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = depths.join(firsts, ["depth", "interval"]).filter(~F.col("first").eqNullSafe(F.col("earliest"))).groupBy("rank").agg(F.max("depth").alias("later"))
    return cut(ranks.join(later, "rank", "left").filter("n > 1 or later is not null").select("rank", "first", F.col("high").alias("deepest"), "later"))


def repeated_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """``id, hash, places``: for each text with later copies, the places (from 0) of the lines to delete."""
    by_place = Window.partitionBy(*_DOC).orderBy("place")
    lines = _lines(df, id_col, text_col).withColumn("before", F.lag("place").over(by_place))
    lines = lines.filter("before is null or before <> place").drop("before")  # rows that are wholly alike count once
    lines = cut(lines.withColumn("seq", F.row_number().over(by_place)))
    recurring = _named(lines, "h1", "h2").filter("n > 1").select("h1", "h2", F.col("name").alias("rank"))
    kept = lines.join(recurring, ["h1", "h2"]).drop("h1", "h2")
    kept = kept.withColumn("segment", F.col("seq") - F.row_number().over(Window.partitionBy(*_DOC).orderBy("seq")))
    segment = Window.partitionBy(*_DOC, "segment")
    in_order = segment.orderBy("seq")
    kept = kept.withColumn("ahead", F.sum("words").over(in_order) - F.col("words"))
    # the shortest run of min_words ends before the first line that has as many words between it and this one
    kept = kept.withColumn("end", F.min("seq").over(segment.orderBy("ahead").rangeBetween(min_words, Window.unboundedFollowing)))
    kept = kept.withColumn("stop", F.max("seq").over(segment) + 1)
    enough = F.max(F.col("ahead") + F.col("words")).over(segment) - F.col("ahead") >= min_words
    kept = kept.withColumn("low", F.coalesce(F.col("end"), F.when(enough, F.col("stop"))) - F.col("seq"))
    high = F.greatest("low", F.coalesce(F.lead("low").over(in_order), F.col("stop") - F.col("seq")))
    kept = kept.withColumn("high", F.when(F.col("low").isNotNull(), high))
    upto = F.collect_list("place").over(in_order.rowsBetween(0, min_words))  # no run to look at has more lines
    kept = cut(kept.select(*_DOC, "segment", "seq", "rank", "low", "high", upto.alias("upto")))

    longest = kept.groupBy(*_DOC, "segment").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    ranked, rounds = suffix_ranks(kept.select(*_DOC, "segment", "seq", "rank"), longest)
    same = [kept.id.eqNullSafe(ranked.id), kept.hash == ranked.hash, kept.seq == ranked.seq]
    kept = cut(kept.filter("low is not null").join(ranked, same).select(kept.id, kept.hash, kept.seq, "low", "high", "upto", ranked["rank"]))
    later = kept.join(_later(kept, common_prefixes(rounds)), "rank")
    count = F.when(F.struct(*_DOC, "seq").eqNullSafe(F.col("first")), F.col("later")).otherwise(F.col("deepest"))
    later = later.select(*_DOC, "upto", count.alias("count")).filter("count is not null")
    return later.select(*_DOC, F.explode(F.slice("upto", 1, F.col("count"))).alias("place")).groupBy(*_DOC).agg(F.collect_set("place").alias("places"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """All columns of ``df`` with the later copies' lines deleted from the text, and ``n_lines``, ``n_removed``.

    Lines end at ``\\n`` and are compared unchanged; ``min_words`` is the least number of words of a run. Each line of a
    run of that many words that also stands earlier is deleted, however long the run. Lines without words neither match nor
    part a run, and stay. Earlier means a smaller id (null first), with equal ids a smaller hash of the text, or further
    up in the same text; rows with the same id and text are one document and get the same text. Columns of ``df`` named
    like the two counts are replaced, all others kept. A null text stays null with 0 lines; an empty one is one line. Empty
    tables give no rows. The lines of one text are sorted in one task, as its text is one row.
    """
    kept_columns = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    mark = "found"
    while mark in {c.lower() for c in df.columns}:
        mark += "_"
    runs = repeated_runs(df, id_col, text_col, min_words).select(F.struct("id", "hash", "places").alias(mark))
    joined = df.select(*kept_columns).join(runs, F.col(id_col).eqNullSafe(F.col(mark)["id"]) & (F.xxhash64(text_col) == F.col(mark)["hash"]), "left")
    lines: Column = F.split(text_col, "\n")
    places = F.col(mark)["places"]
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    text = F.when(places.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(places.isNull(), 0).otherwise(F.size(places)).cast("long")
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept_columns], n_lines.alias("n_lines"), n_removed.alias("n_removed"))
