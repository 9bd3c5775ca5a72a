"""The fuzzy match of references: copies, years and ties."""

import random

import duckdb
import pytest

from paperloom.operators import similarity as S
from paperloom.plans import registry

SCHEMA = "paper int, id long, title string, authors array<string>, year int"


def match(spark, gold, guess):
    return {r.guess_id: (r.gold_id, round(r.score, 6)) for r in S.fuzzy_match(spark.createDataFrame(gold, SCHEMA), spark.createDataFrame(guess, SCHEMA)).collect()}


def test_copies_are_compared_once(spark):
    ref = lambda i: (1, i, "a title of many copies in one paper", ["A. Able", "B. Baker"], 1990 + i % 7)
    got = match(spark, [ref(i) for i in range(6000, 2000, -1)], [ref(i) for i in range(10_000, 14_000)])
    assert len(got) == 4000 and set(got.values()) == {(2001, 1.0)}


def test_years_choose_among_near_titles(spark):
    near, authors = "on the growth of tables in large stores today", ["A. Able", "B. Baker"]
    gold = [(1, 5, near, authors, 1999), (1, 3, near, authors, None), (1, 7, near, authors, 2001), (2, 1, near, authors, 2001)]
    other = near.replace("today", "to")
    got = match(spark, gold, [(1, 10, near, authors, 2001), (1, 11, other, authors, 2001), (1, 12, other, authors, None), (1, 13, None, authors, 2001), (3, 14, near, authors, 2001)])
    assert got[10] == (3, 1.0)  # equal titles: the smallest id, whatever the year
    t = spark.range(1).select(S.ngram_similarity(S.char_grams(S.F.lit(near)), S.char_grams(S.F.lit(other)))).first()[0]
    assert got[11] == ((3, round(t, 6)) if t >= 0.99 else (7, 0.99)) and got.get(12) == ((3, round(t, 6)) if t > 0.94 else None)
    assert 13 not in got and 14 not in got


def rows_made(plan):
    """Rows out of each operator of a plan that has run."""
    made = plan.metrics().get("numOutputRows")
    parts = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return ([made.get().value()] if made.isDefined() else []) + [x for p in parts for x in rows_made(p)]


def test_pairs_of_a_paper_stay_in_the_task(spark):
    ref = lambda i, shift: (1, i + shift, f"on the {i * 7919 % 1000:03d} tables of {i:03d} stores", ["A. Able", "B. Baker"], 2000)
    gold, guess = (spark.createDataFrame([ref(i, shift) for i in range(300)], SCHEMA) for shift in (0, 1000))
    found = S.fuzzy_match(gold, guess)
    assert {(r.guess_id, r.gold_id, r.score) for r in found.collect()} == {(i + 1000, i, 1.0) for i in range(300)}
    assert max(rows_made(found._jdf.queryExecution().executedPlan())) <= 1200  # 90,000 pairs share the authors


@pytest.mark.parametrize("name", ["fuzzy_match", "fuzzy_precision_recall", "fuzzy_unmatched"])
def test_queries_make_no_table_of_pairs(spark, tmp_path, name):
    parts = [(i, f"{'ab'[i // 2 % 2]}{i // 4} ring", f"Brand#{i % 25}", "SMALL", 1 + i % 10 // 9, 1.0) for i in range(400)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = registry.QUERIES[name](spark, str(tmp_path))
    got = sorted(tuple(r[c] for c in sorted(found.columns)) for r in found.collect())
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(sorted(found.columns))} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert got and got == sorted(want)
    assert max(rows_made(found._jdf.queryExecution().executedPlan())) <= 800  # 40,000 pairs share the authors


def test_all_pairs_give_the_same(spark, monkeypatch):
    draw = random.Random(7)
    words, names = ["alpha", "alphas", "beta", "gamma", "deltas", "é𝔸", "x"], [[], ["A. Able", "B. Baker"], ["B. Baker", None, "Cy"], ["", "Cy"], ["A. Able", "B. Baker", "Cy", "D. Du"]]
    kept = [" ".join(draw.choices(words, k=draw.randint(1, 9))) for _ in range(25)]

    def refs(first):
        rows = [(draw.choice([1, 1, 2, None]), first + i, draw.choice(kept) + draw.choice(["", "", "s", " x", " alpha"]), draw.choice(names), draw.choice([1999, 2000, 2001, None])) for i in range(240)]
        rows += [(1, first + 300, None, ["Cy"], 1999), (1, first + 301, "", ["Cy"], 1999), (1, first + 302, "alpha", None, 1999), (1, first + 303, "?", ["Cy"], None), (2, first + 304, "ab", ["Cy"], 1999)]
        return spark.createDataFrame(rows, SCHEMA).cache()

    gold, guess = refs(0), refs(1000)

    def plain(d, n):
        lasts = S.F.transform("authors", lambda a: S.strict_normalize(S.F.try_element_at(S.F.split(a, " "), S.F.lit(-1))))
        short = S.F.transform(S.F.filter(S.F.split(S.alnum_normalize("title"), " "), lambda w: w != ""), lambda w: S.F.left(w, S.F.lit(3)))
        d = d.filter("title is not null").select("paper", "id", "year", S.char_grams(S.normalize("title")).alias("g"), lasts.alias("l"), short.alias("s"))
        keys = S.F.concat(S.F.transform(S.word_ngrams(S.F.col("s"), 3, False), lambda x: S.F.concat(S.F.lit("t:"), x)), S.F.transform(S.word_ngrams(S.F.col("l"), 3, True), lambda x: S.F.concat(S.F.lit("a:"), x)))
        return d.select("paper", *(S.F.col(c).alias(c + n) for c in ("id", "year", "g", "l")), keys.alias("k" + n))

    pairs = plain(guess, "1").join(plain(gold, "2"), "paper").filter(S.F.arrays_overlap("k1", "k2"))
    pairs = pairs.withColumn("t", S.ngram_similarity(S.F.col("g1"), S.F.col("g2"))).withColumn("j", S.F.coalesce(S.jaccard(S.F.col("l1"), S.F.col("l2")), S.F.lit(0.0)) - 0.01)
    score = S.F.when((S.F.col("t") > 0.8) & S.F.coalesce(S.F.col("year1") == S.F.col("year2"), S.F.lit(False)), S.F.greatest("t", "j")).otherwise(S.F.col("t"))
    best = pairs.withColumn("score", score).filter("score > 0.94").groupBy("paper", "id1").agg(S.F.min(S.F.struct(-S.F.round("score", 9), "id2")).alias("m"))
    right = {(r.paper, r.id1): (r.m.id2, round(-r.m[0], 9)) for r in best.collect()}
    assert len(right) > 100 and 0.99 in {s for _, s in right.values()} and any(0.94 < s < 0.99 or 0.99 < s < 1 for _, s in right.values())
    for group, long in ((8192, 128), (20, 128), (8192, 0.05)):  # in one group a paper, and in several
        monkeypatch.setattr(S, "GROUP", group)
        monkeypatch.setattr(S, "LONG", long)
        assert {(r.paper, r.guess_id): (r.gold_id, round(r.score, 9)) for r in S.fuzzy_match(gold, guess).collect()} == right
