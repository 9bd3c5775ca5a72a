"""Precision and recall of extracted items against gold, by document and on average."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import eval_last_name
from ..functions.text import first_and_last_word, mention_normalize, normalize


def _ratios(gold: Column, guess: Column, hits: Column) -> list[Column]:
    """Both empty: 1 and 1; no gold: 0 and 1; no guess: 0 and 0."""
    precision = F.when((gold == 0) & (guess == 0), 1.0).when((gold == 0) | (guess == 0), 0.0).otherwise(hits / guess)
    recall = F.when(gold == 0, 1.0).when(guess == 0, 0.0).otherwise(hits / gold)
    return [precision.alias("precision"), recall.alias("recall")]


def with_occurrence(items: DataFrame) -> DataFrame:
    """Number equal items of a paper, so that multisets compare as sets. Items of a paper are ranked in their own partition."""
    return items.withColumn("k", F.row_number().over(Window.partitionBy("paper", "item").orderBy(F.lit(1))))


def counted(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """``paper, item, in_gold, in_guess``: how often each side has the item; one aggregation, no join.

    Equal to numbering the copies and joining on item and number, but a frequent item is a pair of counts.
    """
    both = gold.select("paper", "item", F.lit(1).alias("a"), F.lit(0).alias("b")).union(guess.select("paper", "item", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("paper", "item").agg(F.sum("a").alias("in_gold"), F.sum("b").alias("in_guess"))


def precision_recall(gold: DataFrame, guess: DataFrame, papers: DataFrame | None = None, multiset: bool = True) -> DataFrame:
    """``paper, precision, recall`` for every paper of either side, or of ``papers``."""
    c = counted(gold, guess)
    if not multiset:
        c = c.select("paper", "item", F.least("in_gold", F.lit(1)).alias("in_gold"), F.least("in_guess", F.lit(1)).alias("in_guess"))
    sums = c.groupBy("paper").agg(F.sum("in_gold").alias("gold"), F.sum("in_guess").alias("guess"), F.sum(F.least("in_gold", "in_guess")).alias("hits"))
    if papers is not None:
        sums = papers.select("paper").distinct().join(sums, "paper", "left").fillna(0, ["gold", "guess", "hits"])
    return sums.select("paper", *_ratios(F.col("gold"), F.col("guess"), F.col("hits")))


def count_metric(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """Precision 1; recall is the number guessed by the number in gold (1 for empty gold)."""
    sums = counted(gold, guess).groupBy("paper").agg(F.sum("in_gold").alias("gold"), F.sum("in_guess").alias("guess"))
    return sums.select("paper", F.lit(1.0).alias("precision"), F.when(F.col("gold") == 0, 1.0).otherwise(F.col("guess") / F.col("gold")).alias("recall"))


def macro_average(scores: DataFrame, papers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over all papers; papers without a score count 0."""
    if not by:
        return papers.select("paper").distinct().join(scores, "paper", "left").agg(F.avg(F.coalesce("precision", F.lit(0.0))).alias("precision"), F.avg(F.coalesce("recall", F.lit(0.0))).alias("recall"))
    n = papers.select("paper").distinct().agg(F.count("*").alias("n"))
    return scores.groupBy(*by).agg(F.sum("precision").alias("p"), F.sum("recall").alias("r")).join(F.broadcast(n)).select(*by, (F.col("p") / F.col("n")).alias("precision"), (F.col("r") / F.col("n")).alias("recall"))


def missing(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """Gold items beyond those guessed, with their number."""
    return counted(gold, guess).filter("in_gold > in_guess").select("paper", "item", (F.col("in_gold") - F.col("in_guess")).alias("n"))


def excess(gold: DataFrame, guess: DataFrame) -> DataFrame:
    return missing(guess, gold)


def two_system_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """``metric`` of either system, values (0 where absent) and their difference."""
    both = a.select("metric", F.col("value").alias("a")).join(b.select("metric", F.col("value").alias("b")), "metric", "full_outer").fillna(0.0, ["a", "b"])
    return both.withColumn("difference", F.col("a") - F.col("b"))


def word_grams(c: Column) -> Column:
    """Different character pairs and triples of a string."""
    runs = lambda k: F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(runs(2), runs(3)))


def error_pairs(lost: DataFrame, extra: DataFrame, least: float = 0.5) -> DataFrame:
    """Missing and excess items of a paper that look alike: shared grams by the larger number of grams.

    Candidates share a gram (an equi-join on paper and gram), so items of a paper that share none are never paired.
    """
    left = lost.select("paper", F.col("item").alias("gold"), word_grams(F.col("item")).alias("g"))
    right = extra.select("paper", F.col("item").alias("guess"), word_grams(F.col("item")).alias("h"))
    a = left.select("paper", "gold", F.size("g").alias("n"), F.explode("g").alias("gram"))
    b = right.select("paper", "guess", F.size("h").alias("m"), F.explode("h").alias("gram"))
    shared = a.join(b, ["paper", "gram"]).groupBy("paper", "gold", "guess").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("m").alias("m"))
    return shared.withColumn("score", F.col("both") / F.greatest("n", "m")).filter(F.col("score") >= least).select("paper", "gold", "guess", "score")


#: Items of a record for each metric; ``Normalized`` ones are compared in a normal form.
RECORD_METRICS = {
    "bibTitles": lambda: F.array("title"),
    "bibTitlesNormalized": lambda: F.array(normalize("title")),
    "bibAuthors": lambda: F.col("authors"),
    "bibAuthorsNormalized": lambda: F.transform("authors", normalize),
    "bibVenues": lambda: F.array("venue"),
    "bibVenuesNormalized": lambda: F.array(normalize("venue")),
    "bibYears": lambda: F.array(F.nullif(F.col("year").cast("string"), F.lit("0"))),
    "bibAll": lambda: F.array(_fields(F.col("title"), F.array_join("authors", ":"), F.col("venue"), F.col("year").cast("string"))),
    "bibAllNormalized": lambda: F.array(_fields(normalize("title"), F.array_join(F.transform("authors", normalize), ":"), normalize("venue"), F.col("year").cast("string"))),
    "bibAllButVenuesNormalized": lambda: F.array(_fields(normalize("title"), F.array_join(F.transform("authors", normalize), ":"), F.col("year").cast("string"))),
    "bibCounts": lambda: F.array(F.lit("record")),
}
#: Items of a paper: its authors, title and abstract.
PAPER_METRICS = {
    "authorFullName": lambda: F.col("authors"),
    "authorFullNameNormalized": lambda: F.transform("authors", normalize),
    "authorLastName": lambda: F.transform("authors", eval_last_name),
    "authorLastNameNormalized": lambda: F.transform("authors", lambda a: normalize(eval_last_name(a))),
    "title": lambda: F.array("title"),
    "titleNormalized": lambda: F.array(normalize("title")),
    "abstract": lambda: F.array(first_and_last_word("abstract")),
    "abstractNormalized": lambda: F.array(normalize(first_and_last_word("abstract"))),
}
#: Items of a mention: its context and itself without parentheses.
MENTION_METRICS = {
    "bibMentions": lambda: F.array(_mention()),
    "bibMentionsNormalized": lambda: F.array(mention_normalize(_mention())),
}
SET_METRICS = ("bibAll", "bibAllNormalized", "bibAllButVenuesNormalized")
COUNT_METRICS = ("bibCounts",)


def _fields(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


def _mention() -> Column:
    return _fields(F.col("context"), F.regexp_replace("mention", "[()]", ""))


def metric_items(rows: DataFrame, metrics: dict) -> DataFrame:
    """``metric, paper, item`` of rows with a ``paper``; null and empty items don't count. One scan."""
    cells = F.array(*[F.struct(F.lit(name).alias("metric"), items().alias("items")) for name, items in metrics.items()])
    return rows.select("paper", F.inline(cells)).select("metric", "paper", F.explode("items").alias("item")).filter("item <> ''")


def record_items(records: DataFrame) -> DataFrame:
    """``metric, paper, item`` of ``paper, title, authors, venue, year``."""
    return metric_items(records, RECORD_METRICS)


def brief(item: Column) -> Column:
    """What stands for an item where items are only compared: its bytes if they are fewer than 32, else their SHA-256."""
    return F.when(F.octet_length(item) < 32, F.encode(item, "utf-8")).otherwise(F.unhex(F.sha2(item, 256)))


def _scores(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """``metric, paper, precision, recall`` of ``metric, paper, item`` wherever either side has an item: two aggregations, no join; long items stay where they are."""
    gold, guess = (df.select("metric", "paper", brief(F.col("item")).alias("item")) for df in (gold, guess))
    both = gold.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(guess.withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    c = both.groupBy("metric", "paper", "item").agg(F.sum("a").alias("x"), F.sum("b").alias("y"))
    once, number = F.col("metric").isin(*SET_METRICS), F.col("metric").isin(*COUNT_METRICS)
    x, y = (F.when(once, F.least(F.col(v), F.lit(1))).otherwise(F.col(v)) for v in ("x", "y"))
    sums = c.groupBy("metric", "paper").agg(F.sum(x).alias("gold"), F.sum(y).alias("guess"), F.sum(F.least(x, y)).alias("hits"))
    gold, guess = F.col("gold"), F.col("guess")
    precision, recall = _ratios(gold, guess, F.col("hits"))
    found = F.when(gold == 0, 1.0).otherwise(guess / gold)
    return sums.select("metric", "paper", F.when(number, 1.0).otherwise(precision).alias("precision"), F.when(number, found).otherwise(recall).alias("recall"))


def record_metrics(gold: DataFrame, guess: DataFrame) -> DataFrame:
    """``metric, precision, recall``: the macro average over the papers of gold of every record metric."""
    scores = _scores(record_items(gold), record_items(guess))
    return macro_average(scores.join(gold.select("paper").distinct(), "paper", "left_semi"), gold, ["metric"])


@dataclass(frozen=True)
class Extraction:
    """What is known of papers, by hand or by extraction; all tables have ``paper``, other columns are ignored.

    ``papers``: ``authors`` (a list), ``title``, ``abstract``, a row a paper. ``records``: ``title, authors, venue, year``, a row an
    entry of a bibliography. ``mentions``: ``context, mention``, a row a citation.
    """

    papers: DataFrame
    records: DataFrame
    mentions: DataFrame

    def items(self) -> DataFrame:
        return metric_items(self.papers, PAPER_METRICS).union(metric_items(self.records, RECORD_METRICS)).union(metric_items(self.mentions, MENTION_METRICS))


def gold_metrics(gold: Extraction, guess: Extraction) -> DataFrame:
    """``metric, papers, failed, precision, recall`` of all metrics: averages over the papers of gold.

    A paper that the extraction doesn't have failed and counts 0; where neither side of another paper has an item, precision and
    recall are 1. Null papers take no part; items of papers that are not in ``papers`` don't count; repeated items
    are matched as often as both sides have them (whole records: once). Without gold papers the averages are null.
    """
    papers = gold.papers.select("paper").filter("paper is not null").distinct()
    found = guess.papers.select("paper").distinct().withColumn("found", F.lit(True))
    papers = papers.join(found, "paper", "left")
    n = papers.agg(F.count("*").alias("n"), F.count("found").alias("n_found"))
    scores = _scores(gold.items(), guess.items()).join(papers.filter("found"), "paper", "left_semi")
    sums = scores.groupBy("metric").agg(F.count("*").alias("scored"), F.sum("precision").alias("p"), F.sum("recall").alias("r"))
    names = F.array(*[F.lit(m) for m in (*PAPER_METRICS, *RECORD_METRICS, *MENTION_METRICS)])
    rows = n.select("*", F.explode(names).alias("metric")).join(sums, "metric", "left").fillna(0, ["scored", "p", "r"])
    mean = lambda c: F.try_divide(F.col(c) + F.col("n_found") - F.col("scored"), F.col("n"))
    return rows.select("metric", F.col("n").alias("papers"), (F.col("n") - F.col("n_found")).alias("failed"), mean("p").alias("precision"), mean("r").alias("recall"))


def annotation_sheet(records: DataFrame) -> DataFrame:
    """``paper, number, cell``: each paper's list of records as rows numbered from 1."""
    return records.select("paper", F.posexplode("cells").alias("i", "cell")).select("paper", (F.col("i") + 1).alias("number"), "cell")


def from_sheet(sheet: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("number", "cell")))
    return sheet.groupBy("paper").agg(F.transform(rows, lambda r: r["cell"]).alias("cells"))


def token_items(texts: DataFrame, c: str) -> DataFrame:
    """``paper, item``: words of a text, as a simple tokenizer has them."""
    return texts.select("paper", F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}0-9]+"), 0)).alias("item"))
