"""Bulk labelling works on each paper once, and a second time only on those that are taken."""

from pyspark.sql import functions as F

from paperloom.operators import supervision as D


def test_papers_are_labelled_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def tokens(text):
        read.add(1)
        return text.split(" ")

    rows = [(i, "x y Ann Dee x y Ann Dee and more", ["Ann Dee"], "x y", 2000) for i in range(100)]
    papers = spark.createDataFrame(rows, "id long, text string, authors array<string>, title string, year int").repartition(5)
    papers = papers.select("id", F.explode(F.array(tokens("text"))).alias("tokens"), "authors", "title", "year")
    got = D.label_in_bulk(papers, spark.createDataFrame([(3,)], "id long"), min_year=1995, most=10, check_authors=True).collect()
    assert sorted(x.id for x in got) == [0, 1, 2, *range(4, 11)]
    assert all(x.labels == ["<S>", "B_T", "E_T", "B_A", "E_A", "O", "O", "O", "O", "O", "O", "</S>"] for x in got)
    assert read.value <= 100 + 11


def test_repeated_and_null_ids_count(spark):
    rows = [(i, ["Ann", "Dee", "x"], ["Ann Dee"], "x") for i in (None, 1, 1, 1, 2)]
    papers = spark.createDataFrame(rows, "id long, tokens array<string>, authors array<string>, title string")
    assert [x.id for x in D.label_in_bulk(papers, most=3).collect()].count(1) == 2
    assert sorted(x.id or 0 for x in D.label_in_bulk(papers, most=4).collect()) == [0, 1, 1, 1]
