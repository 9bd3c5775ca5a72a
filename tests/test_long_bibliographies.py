"""Bibliographies of very many entries: numbers in turn, missing and repeated ones."""

import time

from pyspark.sql import functions as F

from paperloom.operators import bibliography as B


def segments(spark, body, how="bracket"):
    return spark.createDataFrame([(body,)], "body string").select(B.segment(F.col("body"), how).alias("e")).first().e


def by_hand(lines):
    out = []
    for line in lines:
        if line.startswith(f"[{len(out) + 1}]"):
            out.append(line)
        elif out:
            out[-1] += " " + line
    return out


def test_numbers_in_and_out_of_turn(spark):
    for numbers in ([2, 1, 3, 2, 2, 9, 3, 1, 4], [5, 6], [*range(1, 600)], [*range(1, 300), 7, 8, *range(300, 520), 519, 520, 530], [*range(2, 700), 1, 2]):
        lines = [f"[{n}] entry {i}" for i, n in enumerate(numbers)]
        assert segments(spark, "<bb>" + "<lb>".join(lines)) == by_hand(lines)
    assert segments(spark, "<bb>[01] a<lb>[1] b-<lb>c<lb>[99999999999] d") == ["[1] bc [99999999999] d"]
    assert segments(spark, "") == [] and segments(spark, None) is None


def test_time_grows_with_entries(spark):
    segments(spark, "[1] a")
    start = time.time()
    assert len(segments(spark, "<lb>".join(f"[{n}] an entry" for n in range(1, 100_001)))) == 100_000
    assert time.time() - start < 30
