"""Mentions are found in their unit's row, also where it has many, and what many words share draws no rows together."""

from pyspark.sql import functions as F

from paperloom.operators import mentions as M

UNITS = "id long, unit int, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_offsets_of_many_markers_without_shuffle(spark):
    texts = ["".join(f"{'x' * (i % 5)} [{i}] " for i in range(1, n)) for n in (2, 256, 257, 258, 700)]
    got = M.places(spark.createDataFrame(list(enumerate(texts)), "unit long, text string").select(F.lit(1).alias("id"), "unit", "text"), M.MARKERS["number"][0])
    assert "Exchange" not in plan(got) and "Window" not in plan(got)
    rows = got.collect()
    assert len(rows) == 1 + 255 + 256 + 257 + 699
    assert all(texts[x.unit][x.start : x.stop] == x.marker == f"[{x.k + 1}]" for x in rows)


def test_narrative_joins_whole_keys(spark):
    units = spark.createDataFrame([(1, 0, "Small et al. (1990) and Ring et al. (1990)"), (1, 1, "of Ring (1990)")], UNITS)
    records = spark.createDataFrame([(1, 1, ["A. Small", "B", "C"], 1990), (1, 2, ["A. Ring", "B", "C"], 1990), (1, 4, ["D. Ring"], 1990), (1, 3, ["E. Ring"], 1990)], "id long, n int, authors array<string>, year int")
    got = M.narrative(units, records)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1, 0, 19), (1, 0, 2, 24, 42), (1, 1, 3, 3, 14)]
    assert "Window" not in plan(got)


def test_kept_in_one_pass(spark):
    texts = ["First (1) here it is and it goes on for long. Then [2] also goes on, and on, for quite long.", ".⍐3⍗ And the rest of this sentence is rather long, too.", "  (1, 2) stands before a sentence of some length here.", "(4) short.", None]
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(text):
        read.add(1)
        return text

    rows = [(d, u, texts[(d * u) % 5]) for d in range(1, 9) for u in range(40)]
    plain = spark.createDataFrame(rows, UNITS)
    records = spark.createDataFrame([(d, n) for d in range(1, 9) for n in range(1, 4)], "id long, n int")
    want = M.keep_predominant(M.with_contexts(M.marked(plain, records, "number"), plain)).collect()
    units = plain.select("id", "unit", F.explode(F.array(once("text"))).alias("text"))
    got = M.kept_in_style(units, records, "number").collect()
    assert got and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert read.value <= 2 * len(rows)
