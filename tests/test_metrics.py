"""Metrics of an extraction against gold: papers that fail, papers without items, repeated items."""

import pytest

from pyspark.sql import functions as F

from paperloom.operators import evaluate as E

PAPER, RECORD, MENTION = "paper long, authors array<string>, title string, abstract string", "paper long, title string, authors array<string>, venue string, year int", "paper long, context string, mention string"


def extraction(spark, papers=(), records=(), mentions=()):
    return E.Extraction(spark.createDataFrame(list(papers), PAPER), spark.createDataFrame(list(records), RECORD), spark.createDataFrame(list(mentions), MENTION))


def scores(gold, guess):
    return {r.metric: r for r in E.gold_metrics(gold, guess).collect()}


def test_all_metrics(spark):
    gold = extraction(
        spark,
        [(1, ["Ann B. Lee Jr.", "Bo Ek"], "A Näme", "one two three"), (2, [], None, None), (3, ["X Y"], "t", "u"), (None, ["Z"], "z", "z")],
        [(1, "T", ["a b"], "V", 1999), (1, "T", ["a b"], "V", 1999), (1, "U", None, None, 0)],
        [(1, "As (A, 2001) says", "(A, 2001)")],
    )
    guess = extraction(
        spark,
        [(1, ["Ann Lee", "Bo Ek", "Bo Ek"], "a name", "one 2 three"), (2, None, "", None), (9, ["Q"], "q", "q")],
        [(1, "t!", ["A B"], "w", 1999), (1, "T", ["a b"], "V", 1999)],
        [(1, "as (a 2001) says", "A, 2001")],
    )
    got = scores(gold, guess)
    assert len(got) == 21 and {(r.papers, r.failed) for r in got.values()} == {(3, 1)}
    value = {m: (round(3 * r.precision - 1, 6), round(3 * r.recall - 1, 6)) for m, r in got.items()}  # paper 2 counts 1, paper 3 none
    assert value["authorFullName"] == (round(1 / 3, 6), 0.5) and value["authorLastName"] == (round(2 / 3, 6), 1)
    assert value["title"] == (0, 0) and value["titleNormalized"] == (1, 1)
    assert value["abstract"] == (1, 1)
    assert value["bibTitles"] == (0.5, round(1 / 3, 6)) and value["bibTitlesNormalized"] == (1, round(2 / 3, 6))
    assert value["bibYears"] == (1, 1) and value["bibVenues"] == (0.5, 0.5)
    assert value["bibAll"] == (0.5, 0.5) and value["bibAllButVenuesNormalized"] == (1, 0.5)  # copies of a record count once
    assert value["bibCounts"] == (1, round(2 / 3, 6))
    assert value["bibMentions"] == (0, 0) and value["bibMentionsNormalized"] == (1, 1)


@pytest.mark.parametrize("papers", [[], [(1, ["a"], "t", "u")]])
def test_nothing_extracted(spark, papers):
    got = scores(extraction(spark, papers), extraction(spark))
    assert {(r.papers, r.failed, r.precision, r.recall) for r in got.values()} == ({(1, 1, 0.0, 0.0)} if papers else {(0, 0, None, None)})


def test_long_items_are_not_shuffled(spark):
    """Items of 31 to 33 bytes and long ones that differ at the end only are told apart, by what is at most 32 bytes."""
    items = ["a" * n for n in (31, 32, 33, 5000)] + ["a" * 4999 + "b", "\u00e9" * 15, "\u00e9" * 16]
    rows = spark.createDataFrame([("m", 1, x) for x in items], "metric string, paper long, item string")
    r = E._scores(rows, rows.filter("length(item) < 4999 or item like '%b'")).first()
    assert (r.precision, round(r.recall, 6)) == (1.0, round(6 / 7, 6))
    sizes = rows.select(F.octet_length(E.brief(F.col("item"))).alias("n")).collect()
    assert max(x.n for x in sizes) == 32
