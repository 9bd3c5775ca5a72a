"""Gazetteer spans: all runs by hand, and how many runs are made."""

import random

from pyspark.sql import functions as F

from paperloom.functions.text import gazetteer_key
from paperloom.operators import language_model as G

WORDS = ["new", "york", "New-York", "--", "the", "...", "of", "(York)", "-new", "city", "a", "\u03a3\u0391\u03a3", " x "]
ENTRIES = ["new york", "york", "new york city", "of the", "the", "...", "a a a a a a", "\u03c3\u03b1\u03c2 new", "york new york"]


def test_spans_equal_all_runs(spark):
    r = random.Random(3)
    lines = [(i, 0, [r.choice(WORDS) for _ in range(r.randrange(0, 25))]) for i in range(120)] + [(500, 0, ["a"] * 9), (501, 0, ["..."]), (502, 0, None)]
    gaz = G.gazetteer(spark.createDataFrame([("g", e) for e in ENTRIES] + [("h", "york")], "gazetteer string, entry string")).cache()
    of = {}
    for g, key in gaz.collect():
        of.setdefault(key, []).append(g)
    clean = {w: k for w, k in spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", gazetteer_key("w")).collect()}
    want = []
    for doc, _, toks in lines:
        for i in range(len(toks or [])):
            for k in range(1, min(6, len(toks) - i) + 1):
                key = " ".join(x for x in (clean[t] for t in toks[i : i + k]) if x)
                want += [(doc, 0, i, i + k, g) for g in of.get(key, [])]
    found = G.spans(spark.createDataFrame(lines, "doc_id long, line_no int, toks array<string>"), gaz)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 500


def test_no_runs_where_no_entry_begins(spark):
    """Lines without a first word of an entry give no rows to the join with the entries: a plain count of the rows after the first join."""
    gaz = G.gazetteer(spark.createDataFrame([("g", "new york")], "gazetteer string, entry string"))
    toks = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).alias("line_no"), F.array_repeat(F.lit("word"), 40).alias("toks"))
    found = G.spans(toks, gaz)
    assert "BroadcastHashJoin [word" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0
