"""Glyphs to tokens: cuts, bounds, fonts and superscripts."""

from paperloom.operators import glyphs as G


def run_of(text, raised=(), deep=(), xs=None, size=10.0):
    """Glyphs of a line at y 10, 6 apart; raised ones end at 4.5, deep ones at 1."""
    out = []
    for i, c in enumerate(text):
        y = 4.5 if i in raised else 1.0 if i in deep else 10.0
        out.append((c, float(xs[i] if xs else 6 * i + 6), y, 5.0, y, "Serif", size, 2.5))
    return out


def tokens_of(spark, *runs):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], f"run int, glyphs array<{G.GLYPH}>")
    out = {i: [] for i in range(len(runs))}
    for r in sorted(G.tokens(df, "run").collect(), key=lambda r: (r.run, r.n)):
        assert r.n == len(out[r.run])
        out[r.run].append(r)
    return out


def test_tokens(spark):
    ligature = run_of("xﬁy")
    got = tokens_of(
        spark, run_of("  ab  c "), run_of("abcd", xs=[6, 12, 3, 9]), run_of("ab", xs=[0, -3]), run_of("x1,2y", raised={1, 2, 3}), run_of("x12a", raised={3}), run_of("[3]", raised={0, 1, 2}),
        run_of("word(1)", raised={4, 5, 6}), run_of("w1", deep={1}), ligature, run_of("a", size=105.0), [], None, run_of("   "), [(None, 6.0, 10.0, 5.0, 10.0, None, None, None), ("z", 12.0, 10.0, 5.0, 10.0, None, 9.0, 2.0)],
        run_of("x7ab8z", raised={1, 4}), run_of("q" * 5000 + "4", raised={5000}), run_of("xa", raised={1})
    )
    text = {i: [r.token for r in rows] for i, rows in got.items()}
    assert text[0] == ["ab", "c"] and (got[0][0].x0, got[0][0].x1, got[0][0].y0, got[0][0].y1) == (18, 29, 0, 10)
    assert text[1] == ["ab", "cd"]  # back to the left
    assert text[2] == ["ab"]  # a glyph at 0 says nothing
    assert text[3] == ["x⍐1,2⍗y"] and text[14] == ["x⍐7⍗ab⍐8⍗z"]
    assert text[4] == ["x12"] and text[16] == ["x"]  # not a mention: left out
    assert text[5] == ["[3]"]  # all glyphs at one height
    assert text[6] == ["word⍐(1)⍗"]
    assert text[7] == ["w1"]  # far above mid-height: not raised
    assert text[8] == ["xfiy"]
    assert got[9][0].size == 10.5 and got[9][0].font == "Serif_10.5_2.5" and got[0][0].font == "Serif_10.0_2.5"
    assert [text[i] for i in (10, 11, 12)] == [[], [], []]
    assert text[13] == ["z"] and got[13][0].font == "unknown_9.0_2.0"
    assert text[15] == ["q" * 5000 + "⍐4⍗"]


def test_long_runs(spark):
    """Work grows with the glyphs of a run, not with their square; tokens of a run keep their numbers."""
    got = tokens_of(spark, run_of("ab " * 20_000), run_of("c" * 60_000), run_of("é x"))
    assert len(got[0]) == 20_000 and {r.token for r in got[0]} == {"ab"} and got[0][-1].x0 == 6 * (60_000 - 3) + 6
    assert [len(r.token) for r in got[1]] == [60_000] and [r.token for r in got[2]] == ["é", "x"]
    empty = spark.createDataFrame([], f"run int, glyphs array<{G.GLYPH}>")
    assert G.tokens(empty, "run").count() == 0


def test_nulls_and_what_is_no_number(spark):
    g = lambda c, x, y, h: (c, x, y, 5.0, h, "F", 9.0, 2.0)
    nan = float("nan")
    got = tokens_of(spark, [g("a", None, 10.0, None), g("b", 3.0, None, 4.0)], [g("a", nan, 10.0, 10.0), g("b", 7.0, 10.0, 10.0)], [None, g("z\x02", 1.0, 2.0, 1.0)])
    assert [(r.token, r.x0, r.y0, r.x1, r.y1) for r in got[0]] == [("ab", 3.0, None, 8.0, 10.0)]
    assert [r.token for r in got[1]] == ["a", "b"]  # NaN is larger than all
    assert [(r.token, r.n) for r in got[2]] == [("z", 0)]
