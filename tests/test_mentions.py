"""Citation mentions: literal cases and plain scans of random texts."""

import random
from collections import Counter

from pyspark.sql import functions as F

from paperloom.operators import mentions as M

UNITS = "id long, unit int, text string"


def found(df):
    return sorted(map(tuple, df.collect()))


def test_narrative_citations(spark):
    units = [
        (1, 0, "Etzioni et al. (2005) began it."), (1, 1, "See Small and Ring (1991a) Small [1990] for more."), (1, 2, "Small (2001), Nobody (1990) and (1990) alone"),
        (1, 3, "as Ring's (1992) and (Ring (1992)) say"), (1, 4, "Smaller (1990) Small\n(1990)"), (1, 5, "Small in a work (1990)"), (2, 0, "Small (1990)"), (1, 6, None), (1, 7, ""), (1, 8, "O’Neil (1999)"),
    ]
    records = [
        (1, 1, ["A. Small"], 1990), (1, 2, ["A. Small", "B. Ring"], 1991), (1, 3, ["O. Etzioni", "X. Y", "Z. W"], 2005), (1, 4, ["C. Ring"], 1992), (1, 5, ["D. Ring"], 1992), (1, 6, ["P. O'Neil"], 1999),
        (1, 7, [], 1990), (1, 8, None, 1990), (3, 1, ["Small"], 1990),
    ]
    u, r = spark.createDataFrame(units, UNITS), spark.createDataFrame(records, "id long, n int, authors array<string>, year int")
    want = [(1, 0, 3, 0, 21), (1, 1, 1, 27, 39), (1, 1, 2, 4, 26), (1, 3, 4, 3, 16), (1, 3, 4, 22, 33), (1, 4, 1, 15, 27), (1, 8, 6, 0, 13)]
    assert found(M.narrative(u, r)) == sorted(want)
    assert (1, 5, 1, 0, 22) in found(M.narrative(u, r, gap=3)) and (1, 5, 1, 0, 22) not in found(M.narrative(u, r, gap=2))
    assert (1, 2, 1, 0, 12) in found(M.narrative(u, r, any_year=True))
    assert found(M.narrative(u.filter("id > 9"), r)) == []


def test_narrative_against_all_places(spark):
    r = random.Random(2)
    names = ["Ann", "Bo", "Cy", "Dee"]
    records = [(d, n, [f"X. {name}" for name in r.sample(names, r.choice([1, 1, 2, 3]))], 1990 + r.randrange(3)) for d in range(4) for n in range(5)]
    words = [*names, "and", "et", "al.", "(1990)", "(1991)", "[1992b]", "text", "Ann,"]
    units = [(d, u, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for d in range(4) for u in range(30)]
    want = set()
    for d, u, text in units:
        last = 0
        places = []
        for w in text.split(" "):
            places.append((last, w))
            last += len(w) + 1
        plain = [w.strip(",.").lower() for _, w in places]
        for y, (at, w) in enumerate(places):
            if w[:1] not in "([" or not w:
                continue
            hits = []
            for rd, n, authors, year in records:
                last_names = [a.split(" ")[-1].lower() for a in authors]
                key = last_names[:1] if len(authors) == 1 else [last_names[0], "and", last_names[1]] if len(authors) == 2 else [last_names[0], "et", "al"]
                if rd == d and str(year) == w[1:5] and y >= len(key) and plain[y - len(key) : y] == key:
                    hits.append((y - len(key), n))
            if hits:
                first, n = min(hits)
                want.add((d, u, n, places[first][0], at + len(w)))
    got = M.narrative(spark.createDataFrame(units, UNITS), spark.createDataFrame(records, "id long, n int, authors array<string>, year int"))
    assert len(want) > 15 and found(got) == sorted(want)


def test_markers_of_each_style(spark):
    text = "a [1, 3] b (2-4) c.⍐5⍗ d (3 - 5) [7] (Small and Ring, 1991; De Mori 1990b) [KEY 99; other]"
    u = spark.createDataFrame([(1, 0, text), (2, 0, None)], UNITS)
    r = spark.createDataFrame([(1, n, ["A. Small", "B. Ring"] if n == 2 else ["R. De Mori"], 1991, "Key 99") for n in range(1, 6)], "id long, n int, authors array<string>, year int, key string")
    assert [(n, text[a:b]) for _, _, n, a, b in found(M.marked(u, r, "number"))] == [(1, "[1, 3]"), (2, "(2-4)"), (3, "[1, 3]"), (3, "(2-4)"), (4, "(2-4)"), (5, "⍐5⍗")]
    assert [(n, text[a:b]) for _, _, n, a, b in found(M.marked(u, r, "named"))] == [(2, "(Small and Ring, 1991; De Mori 1990b)")]
    assert [(n, text[a:b]) for _, _, n, a, b in found(M.marked(u, r, "bracket_name"))] == [(1, "[KEY 99; other]")]
    assert [(n, text[a:b]) for _, _, n, a, b in found(M.marked(u, r, "paren_number"))] == [(2, "(2-4)"), (3, "(2-4)"), (3, "(3 - 5)"), (4, "(2-4)"), (5, "(3 - 5)")]


def scan(text, begin, end):
    """The sentence around a mention, character by character."""
    at = begin
    while at > 0 and at < len(text) and text[at] in "([.⍐":
        at -= 1
    start = 0
    for i in range(at):
        if text[i] == ".":
            start = i + 1
    if start < len(text) and text[start] == "⍐":
        close = next((i for i in range(start, len(text)) if text[i] == "⍗"), -1)
        if 0 < close < begin:
            start = close + 1
    stop = next((i + 1 for i in range(end, len(text)) if text[i] == "."), len(text))
    while start < stop and text[start] <= " ":
        start += 1
    while stop > start and text[stop - 1] <= " ":
        stop -= 1
    return text[start:stop], begin - start, end - start


def test_sentence_contexts_of_random_texts(spark):
    r = random.Random(4)
    rows = []
    for _ in range(400):
        before, after = ("".join(r.choice("ab .([⍐⍗\n") for _ in range(r.randrange(0, 14))) for _ in range(2))
        mention = r.choice(["(1)", "[2, 3]", "⍐4⍗", "x (2005)"])
        rows.append((before + mention + after, len(before), len(before) + len(mention)))
    df = spark.createDataFrame(rows, "text string, a int, b int").select("*", M.sentence_context(F.col("text"), F.col("a"), F.col("b")).alias("c"))
    for x in df.collect():
        assert tuple(x.c) == scan(x.text, x.a, x.b), (x.text, x.a, x.b)


def test_predominant_style(spark):
    def rows(signs, i):
        return [(i, u, 0, 1, f"{sign}1) some words here", 0, 3) for u, sign in enumerate(signs)]

    docs = {1: "((([[", 2: "([[(", 3: "((((((([[[[[", 4: "xx(", 5: "⍐", 6: "[(", 7: "((((([[[["}
    df = spark.createDataFrame([x for i, s in docs.items() for x in rows(s, i)], "id long, unit int, place int, n int, context string, start int, stop int")
    got = M.keep_predominant(df).collect()
    assert Counter((x.id, x.style) for x in got) == {(1, "("): 3, (2, "["): 2, (3, "["): 5, (4, ""): 3, (5, "⍐"): 1, (6, "["): 1, (7, "("): 5}
    assert [x.context for x in got if x.id == 5] == ["(1) some words here"]
    long = M.with_contexts(spark.createDataFrame([(1, 0, 1, 5, 8), (1, 1, 2, 0, 3)], "id long, unit int, n int, start int, stop int"), spark.createDataFrame([(1, 0, "Then (1) " + "word " * 9), (1, 1, "(1) short.")], UNITS))
    assert [tuple(x)[:4] for x in long.collect()] == [(1, 0, 5, 1)]
