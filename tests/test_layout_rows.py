"""Lines summed up in their rows: the same as from tokens, with only lines shuffled, once."""

from paperloom.operators import layout as L
from paperloom.plans import token_queries as Q
from paperloom.sources.derived import line_tokens, tokens, with_geometry

TEXTS = [(1, "A title\n\n  two  blanks \nx"), (2, ""), (3, None), (4, "\n \n"), (5, "one"), (6, "again a\nb"), (6, "again z\n\nc d"), (None, "no id\nline"), *[(i, "\n".join(f"w{j} " * (j % 4) for j in range(i))) for i in range(10, 40)]]


def rows(df):
    return sorted(map(str, df.collect()))


def test_bounds_and_thresholds_equal_those_of_tokens(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    old, new = L.line_bounds(with_geometry(tokens(docs))), L.bounds_of_rows(line_tokens(docs))
    assert new.columns == old.columns and [f.dataType for f in new.schema] == [f.dataType for f in old.schema] and rows(new) == rows(old)
    br = L.breaks(old.filter("doc_id is not null"))
    assert rows(L.with_threshold(br).select("doc_id", "threshold").distinct()) == rows(L.break_threshold(br))
    assert rows(L.blocks(L.with_threshold(br))) == rows(L.blocks(br, L.break_threshold(br)))


def test_lines_are_shuffled_once(spark, sf_dir):
    for name in ("line_bounds", "text_blocks", "first_block"):
        plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 1, name
