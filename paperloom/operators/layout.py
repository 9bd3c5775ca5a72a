"""Layout: lines, breaks, blocks, columns, abstracts, reference sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that head a bibliography.
REFERENCE_HEADINGS = ("references", "citations", "bibliography", "reference", "bibliographie")
#: What ends an abstract, in the order of removal: from the match to the end.
ABSTRACT_TAILS = (
    r"Key ?words(:| |\.).*$", r"KEY ?WORDS(:| |\.).*$", r"Key ?Words(:| |\.).*$", r"(?i)(1|I)\.? Introduction.*$",
    r"Categories and Subject Descriptors.*$", r"0 [1-2][0-9]{3}.*$", r"Contents.*$", r"(?i)Index terms\p{P}.*$",
)
REFERENCE_START = r"^[0-9]{1,2}(\.|\s|$)|^\[.+?\]"


def line_bounds(toks: DataFrame) -> DataFrame:
    """A row a line: bounds, height, mean font size and text."""
    parts = toks.groupBy("doc_id", "line_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("font").alias("font"),
        F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("ts"),
    )
    return parts.withColumn("height", F.col("y1") - F.col("y0")).withColumn("line", F.array_join(F.transform("ts", lambda t: t["token"]), " ")).drop("ts")


def bounds_of_rows(rows: DataFrame) -> DataFrame:
    """Like :func:`line_bounds`, of lines already summed up: ``doc_id, line_no, at, tokens`` (arrays in order), bounds and ``fonts``, their sum.

    A line may have several rows. Only lines are shuffled, by document, so what follows by document needs no further shuffle.
    """
    merged = rows.repartition("doc_id").groupBy("doc_id", "line_no").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.sum("fonts") / F.sum(F.size("at"))).alias("font"),
        F.collect_list(F.struct("at", "tokens")).alias("ts"),
    )
    mixed = F.array_sort(F.flatten(F.transform("ts", lambda t: F.zip_with(t["at"], t["tokens"], lambda a, x: F.struct(a.alias("pos"), x.alias("token"))))))
    line = F.when(F.size("ts") == 1, F.array_join(F.get("ts", F.lit(0))["tokens"], " ")).otherwise(F.array_join(F.transform(mixed, lambda t: t["token"]), " "))
    return merged.withColumn("height", F.col("y1") - F.col("y0")).withColumn("line", line).drop("ts")


def in_order():
    return Window.partitionBy("doc_id").orderBy("line_no")


def breaks(lines: DataFrame) -> DataFrame:
    """Add ``brk``: the gap to the line above by the smaller of the two heights; 0 for the first line."""
    w = in_order()
    size = (F.col("y0") - F.lag("y1").over(w)) / F.least(F.col("height"), F.lag("height").over(w))
    return lines.withColumn("brk", F.coalesce(size, F.lit(0.0)))


def break_threshold(lines: DataFrame, numerator: int = 7, denominator: int = 9, more: float = 0.0) -> DataFrame:
    """``doc_id, threshold``: the element n * numerator div denominator of the sorted positive breaks; 1 without any."""
    w = Window.partitionBy("doc_id").orderBy("brk", "line_no")
    positive = lines.filter("brk > 0").withColumn("k", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    at = positive.filter(F.col("k") == F.floor(F.col("n") * numerator / denominator)).select("doc_id", (F.col("brk") + more).alias("threshold"))
    return lines.select("doc_id").distinct().join(at, "doc_id", "left").fillna(1.0, ["threshold"])


def with_threshold(lines: DataFrame, numerator: int = 7, denominator: int = 9) -> DataFrame:
    """Add ``threshold``, as :func:`break_threshold` has it, by windows of a document alone."""
    positive = F.coalesce(F.col("brk") > 0, F.lit(False))
    k = F.row_number().over(Window.partitionBy("doc_id", "positive").orderBy("brk", "line_no")) - 1
    doc = Window.partitionBy("doc_id")
    lines = lines.withColumn("positive", positive).withColumn("k", k).withColumn("n", F.count(F.when(F.col("positive"), 1)).over(doc))
    at = F.max(F.when(F.col("positive") & (F.col("k") == F.floor(F.col("n") * numerator / denominator)), F.col("brk"))).over(doc)
    return lines.withColumn("threshold", F.coalesce(at, F.lit(1.0))).drop("positive", "k", "n")


def blocks(lines: DataFrame, threshold: DataFrame | None = None, mark: str = "<lb>") -> DataFrame:
    """``doc_id, block, n_lines, block_text``: lines up to a break above the threshold, joined by ``mark``. Without ``threshold`` the lines have it."""
    lines = lines if threshold is None else lines.join(threshold, "doc_id")
    marked = lines.withColumn("block", F.sum((F.col("brk") > F.col("threshold")).cast("int")).over(in_order()))
    grouped = marked.groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return grouped.select("doc_id", "block", "n_lines", F.array_join(F.transform("ls", lambda x: x["line"]), mark).alias("block_text"))


def first_text_block(block: DataFrame, least: int = 400) -> DataFrame:
    """The first block of over ``least`` characters that another one follows; empty if there is none."""
    w = Window.partitionBy("doc_id").orderBy("block")
    fits = (F.length("block_text") > least) & F.col("next").isNotNull()
    found = block.withColumn("next", F.lead("block").over(w)).groupBy("doc_id").agg(F.min(F.when(fits, F.struct("block", "block_text"))).alias("b"))
    return found.select("doc_id", F.coalesce("b.block_text", F.lit("")).alias("first_block"))


def columns(toks: DataFrame) -> DataFrame:
    """``doc_id, column, n``: runs of tokens whose vertical place does not decrease."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    turn = F.coalesce((F.col("y0") < F.lag("y0").over(w)).cast("int"), F.lit(0))
    return toks.withColumn("turn", turn).withColumn("column", F.sum("turn").over(w)).groupBy("doc_id", "column").agg(F.count("*").alias("n"))


def clean_abstract(c: Column) -> Column:
    """Cut at keywords, introduction and the like (first match each), then join hyphenated words."""
    for tail in ABSTRACT_TAILS:
        c = F.regexp_replace(c, f"(?-s){tail}", "")
    return F.replace(c, F.lit("- "), F.lit(""))


def abstracts(block: DataFrame, fallback: DataFrame, stop_below: int = 20) -> DataFrame:
    """``doc_id, abstract``: the blocks after a heading *Abstract* (or one that begins with the word) up to the first
    with fewer than ``stop_below`` characters; else the first text block without a leading *Summary*."""
    head = r"(?i)^abstract ?\p{P}?"
    plain = block.withColumn("b", F.replace("block_text", F.lit("<lb>"), F.lit(" ")))
    is_head = F.col("b").rlike(head)
    starts = F.min(F.when(is_head, F.col("block"))).over(Window.partitionBy("doc_id"))
    after = plain.withColumn("start", starts).filter("block >= start").withColumn("stop", F.min(F.when((F.col("block") > F.col("start")) & (F.length("b") < stop_below), F.col("block"))).over(Window.partitionBy("doc_id")))
    body = after.filter(F.col("stop").isNull() | (F.col("block") < F.col("stop"))).withColumn("b", F.when(F.col("block") == F.col("start"), F.regexp_replace("b", head, "")).otherwise(F.col("b")))
    found = body.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "b"))), lambda x: F.trim(x["b"])), " ").alias("found"))
    other = fallback.select("doc_id", F.regexp_replace(F.replace("first_block", F.lit("<lb>"), F.lit(" ")), r"(?i)^summary ?\p{P}?", "").alias("other"))
    return other.join(found, "doc_id", "left").select("doc_id", F.trim(clean_abstract(F.coalesce("found", "other"))).alias("abstract"))


def reference_heading(lines: DataFrame) -> DataFrame:
    """``doc_id, heading``: the first line of fewer than five tokens whose last one is a heading word; null without one."""
    last = F.lower(F.regexp_replace(F.try_element_at(F.split(F.trim("line"), " "), F.lit(-1)), r"\p{P}", ""))
    hit = last.isin(*REFERENCE_HEADINGS) & (F.size(F.split(F.trim("line"), " ")) < 5)
    return lines.groupBy("doc_id").agg(F.min(F.when(hit, F.col("line_no"))).alias("heading"))


def reference_entries(lines: DataFrame, most_lines: int = 6) -> DataFrame:
    """Lines of a section into entries: a new one at a start pattern or after ``most_lines`` lines.

    The count of lines since the last start only restarts at starts, so the cap falls on every ``most_lines``-th line
    after one: a division, not a fold.
    """
    w = Window.partitionBy("section").orderBy("line_no")
    starts = F.sum(F.col("line").rlike(REFERENCE_START).cast("int")).over(w)
    numbered = lines.withColumn("start", starts).withColumn("k", F.row_number().over(Window.partitionBy("section", "start").orderBy("line_no")) - 1)
    numbered = numbered.withColumn("part", F.floor(F.col("k") / most_lines))
    grouped = numbered.groupBy("section", "start", "part").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return grouped.select("section", "line_no", F.array_join(F.transform("ls", lambda x: x["line"]), "<lb>").alias("entry"))


def new_lines(toks: DataFrame) -> DataFrame:
    """Add ``line``: tokens in reading order stay on a line while they overlap vertically and stand 0 to 4 font sizes apart."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    same = (F.col("y0") < F.lag("y1").over(w)) & (F.lag("y0").over(w) < F.col("y1")) & ((F.col("x0") - F.lag("x1").over(w)).between(0, 4 * F.col("font")))
    return toks.withColumn("line", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))


def bad_title(title: Column) -> Column:
    """Null, a file name, proceedings, an arXiv mark or without a capitalised word."""
    return title.isNull() | title.rlike(r"(?i)\.(pdf|doc|docx|tex|dvi|ps)$") | title.rlike("(?i)proceedings of") | title.rlike("(?i)arxiv:") | ~title.rlike(r"(^|\s)\p{Lu}")


def heuristic_title(lines: DataFrame) -> DataFrame:
    """``doc_id, title``: the first run of lines in the largest font of the document's first lines."""
    w = Window.partitionBy("doc_id")
    large = lines.withColumn("most", F.max("font").over(w)).filter(F.col("font") == F.col("most"))
    large = large.withColumn("run", F.col("line_no") - F.row_number().over(in_order()))
    large = large.withColumn("first", F.min("run").over(w)).filter(F.col("run") == F.col("first"))
    return large.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("title"))


def greedy_clusters(values: Column, width: float) -> Column:
    """Means and sizes of sorted numbers grouped from below: a number joins while it is within ``width`` of the running mean."""
    start = F.array().cast("array<struct<total:double,n:int>>")

    def step(s: Column, v: Column) -> Column:
        last = F.try_element_at(s, F.lit(-1))
        near = (F.size(s) > 0) & (F.abs(last["total"] / last["n"] - v) <= width)
        grown = F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct((last["total"] + v).alias("total"), (last["n"] + 1).alias("n"))))
        return F.when(near, grown).otherwise(F.concat(s, F.array(F.struct(v.alias("total"), F.lit(1).alias("n")))))

    return F.transform(F.aggregate(F.array_sort(values), start, step), lambda c: F.struct((c["total"] / c["n"]).alias("mean"), c["n"].alias("n")))


def merge_bare_numbers(entries: DataFrame) -> DataFrame:
    """Entries ``section, line_no, entry`` where a bare number (``12.`` or ``[12]``) takes in the one that follows."""
    w = Window.partitionBy("section").orderBy("line_no")
    bare = F.col("entry").rlike(r"^(\[[0-9]+\]|[0-9]{1,3}\.?)$")
    marked = entries.withColumn("bare", bare).withColumn("run", F.col("line_no") * 0 + F.row_number().over(w) - F.sum(bare.cast("int")).over(w))
    # in a run of bare numbers each second one is taken in by the one before it
    marked = marked.withColumn("k", F.when(F.col("bare"), F.row_number().over(Window.partitionBy("section", "bare", "run").orderBy("line_no"))))
    marked = marked.withColumn("taker", F.col("bare") & (F.col("k") % 2 == 1)).withColumn("after", F.lead("entry").over(w))
    taken = F.coalesce(F.lag("taker").over(w), F.lit(False))
    marked = marked.withColumn("taken", taken).filter(~F.col("taken"))
    return marked.select("section", "line_no", F.when(F.col("taker") & F.col("after").isNotNull(), F.concat_ws(" ", "entry", "after")).otherwise(F.col("entry")).alias("entry"))


def repair_columns(toks: DataFrame, least: int = 10, near: float = 3.0) -> DataFrame:
    """Order of the tokens of two-column pages read across: ``doc_id, seq, column, place``.

    The gap after a token is a gutter if it is wider than 5 mean spaces. A document is split only if it has over
    ``least`` gutters and all lie within ``near`` mean spaces of their mean; its tokens are then ordered by column first.
    """
    w = Window.partitionBy("doc_id", "line_no").orderBy("x0")
    d = Window.partitionBy("doc_id")
    t = toks.withColumn("gap", F.lead("x0").over(w) - F.col("x1"))
    t = t.withColumn("space", F.avg(F.when(F.col("gap") < 3 * F.col("font"), F.col("gap"))).over(d))
    t = t.withColumn("gutter", F.when(F.col("gap") > 5 * F.coalesce("space", F.lit(4.0)), F.col("x1") + F.col("gap") / 2))
    t = t.withColumn("mean", F.avg("gutter").over(d)).withColumn("n", F.count("gutter").over(d))
    t = t.withColumn("spread", F.max(F.abs(F.col("gutter") - F.col("mean"))).over(d))
    split = (F.col("n") > least) & (F.col("spread") <= near * F.coalesce("space", F.lit(4.0)))
    t = t.withColumn("column", F.when(split & (F.col("x0") > F.col("mean")), 1).otherwise(0))
    return t.select("doc_id", "line_no", "pos", "column", F.row_number().over(Window.partitionBy("doc_id").orderBy("column", "line_no", "x0")).alias("place"))
