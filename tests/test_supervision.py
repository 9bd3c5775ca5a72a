"""Optional-token patterns, labels made of them and numbering: literal cases and a plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.operators import control as C
from paperloom.operators import supervision as D

PAPER = "id long, tokens array<string>, authors array<string>, title string, year int, labels_of string"


def papers(spark, *rows):
    return spark.createDataFrame([(i, t.split(" ") if isinstance(t, str) else t, a, title, year, "kept") for i, t, a, title, year in rows], PAPER)


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("Marco C. Baroni", "Marco C Baroni", (0, 3)), ("Marco C. Baroni", "Marco Baroni", (0, 2)), ("Marco Baroni", "M. G. Baroni", (0, 3)), ("Marco Baroni", "M. G. B.", None),
        ("M. Baroni", "by Marcello Baroni2,*", (1, 3)), ("Marco Baroni", "Marcello Baroni", None), ("Li X", "Li X Li X", (0, 2)), ("Ann B. C. Dee", "Ann Dee", (0, 2)), ("Ann Bo Cy Dee", "A. C. Dee", (0, 3)),
        ("Plato", "of PLATO1", (1, 2)), ("", "a b", None), ("A (B) C", "A B C", (0, 3)), ("Ann Ann Dee", "Ann Ann Ann Dee", (1, 4)), ("Ann Dee", "", None),
    ],
)
def test_names(spark, name, text, want):
    got = D.find_names(papers(spark, (1, text.split(), [name], "t", 2000))).collect()
    assert [(r.start, r.stop) for r in got] == ([want] if want else [])


def brute(elements, tokens):
    def ends(i, j):
        if j == len(elements):
            return {i}
        test, optional = elements[j]
        return (ends(i + 1, j + 1) if i < len(tokens) and test(tokens[i]) else set()) | (ends(i, j + 1) if optional else set())

    return next(((i, max(e)) for i in range(len(tokens)) if (e := ends(i, 0))), None)


def test_names_against_a_plain_search(spark):
    r = random.Random(6)
    words = ["ann", "a.", "b", "bo", "b.", "Dee", "dee1", "and", "x.y"]
    rows, want = [], {}
    for i in range(300):
        name, tokens = " ".join(r.choice(["Ann", "A.", "Bo", "B", "Dee"]) for _ in range(r.randrange(1, 5))), [r.choice(words) for _ in range(r.randrange(0, 12))]
        rows.append((i, tokens, [name], "t", 2000))
        ws = name.lower().split()
        elements = []
        for k, w in enumerate(ws):
            if k == len(ws) - 1:
                test = lambda t, w=w: re.fullmatch(re.escape(w) + r"[\W0-9]*", t.lower())
            elif re.fullmatch(r"[a-z]\.?", w):
                test = lambda t, w=w: re.fullmatch(w[0] + r"(\.?|[a-z]+)", t.lower())
            else:
                test = lambda t, w=w: t.lower() in (w, w[0], w[0] + ".")
            elements.append((test, 0 < k < len(ws) - 1))
        if len(ws) == 2:
            elements.insert(1, (lambda t: re.fullmatch(r"[a-z]\.?", t.lower()), True))
        if (found := brute(elements, tokens)) is not None:
            want[i] = found
    got = {x.id: (x.start, x.stop) for x in D.find_names(papers(spark, *rows)).collect()}
    assert len(want) > 40 and got == want


def test_labels(spark):
    rows = [
        (1, "On Text Mining by Ann Dee and Bo", ["Ann Dee", "Bo", "Not There"], "text mining", 2000),  # a single token, one author missing
        (2, "Ann Dee on Dee", ["Ann Dee"], "dee on", 2000),  # the title takes a token of the author
        (3, "no title here", ["no"], "other", 2000), (4, "a b", None, "a", 2000), (5, "a b", ["b"], None, 2000), (6, [], ["b"], "a", 2000), (7, "a b", [], "A B", 2000), (8, None, ["b"], "a", 2000),
    ]
    got = {x.id: " ".join(x.labels) for x in D.labelled(papers(spark, *rows)).collect()}
    assert got == {1: "<S> O B_T E_T O B_A E_A O W_A </S>", 2: "<S> B_A B_T E_T O </S>", 7: "<S> B_T E_T </S>"}
    assert D.labelled(papers(spark, *rows)).columns == [*PAPER.replace(" long", "").replace(" array<string>", "").replace(" string", "").replace(" int", "").split(", "), "labels"]


def test_bulk(spark):
    rows = [(i, "x y Ann Dee", ["Ann Dee"], "x y", None if i % 5 == 0 else 1990 + i) for i in range(40)] + [(50 + i, "x y Ann Dee", ["Ann Dee", "Bo"], "x y", 2030) for i in range(3)]
    df = papers(spark, *rows).repartition(5)
    none = spark.createDataFrame([(7,), (7,), (999,)], "id long")
    ids = lambda **how: sorted(x.id for x in D.label_in_bulk(df, **how).collect())
    assert ids() == [r[0] for r in rows]
    assert ids(excluded=none, min_year=1995, most=10, check_authors=True) == [i for i in range(6, 40) if i % 5 and i != 7][:10]
    assert ids(check_authors=True, min_year=2025) == [i for i in range(35, 40) if i % 5]
    assert ids(first_tokens=1) == [] and ids(most=1000) == [r[0] for r in rows]


def test_numbered(spark):
    r = random.Random(1)
    keys = r.sample(range(10_000), 500) + [None]
    df = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "k long, g int").repartition(7)
    got = {x.k: x["index"] for x in C.numbered(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys, key=lambda k: -1 if k is None else k))}
    by = C.numbered(df, "k", "g", cuts=[100.0, 5000.0]).collect()
    for g in range(3):
        assert [x["index"] for x in sorted((x for x in by if x.g == g), key=lambda x: -1 if x.k is None else x.k)] == list(range(sum(x.g == g for x in by)))
    assert C.numbered(df.filter("k < 0"), "k").collect() == []


def labels_of(line, scheme):
    from paperloom.operators.tagged import label_line

    return [(x["token"], x["label"]) for x in label_line(line, scheme)]


def test_tagged_lines():
    cora = labels_of("<author> A. Cau </author> <title> Formalising Dijkstra's development strategy within Stark's formalism. </title> <booktitle> BCS-FACS Refinement Workshop, </booktitle> <date> 1992. </date>", "cora")
    assert len(cora) == 15 and cora[0] == ("<S>", "<S>") and cora[-1] == ("</S>", "</S>")
    assert [cora[i] for i in (2, 3, 5, 13)] == [("Cau", "E_A"), ("Formalising", "B_T"), ("development", "I_T"), ("1992.", "W_Y")] and ("formalism.", "E_T") in cora
    umass = labels_of("<ref-marker> [30] </ref-marker> <authors> <person> <person-first> E. </person-first> <person-last> M , </person-last> </person> <person> B. W , </person> </authors> <venue> <booktitle> F P , </booktitle> <date> <year> 1979 , </year> </date> <chapter> Ch </chapter> </venue>", "umass")
    assert umass[1:] == [("E.", "B_A"), ("M", "I_A"), (",", "I_A"), ("B.", "I_A"), ("W", "I_A"), (",", "E_A"), ("F", "B_V"), ("P", "I_V"), (",", "E_V"), ("1979", "B_Y"), (",", "E_Y"), ("Ch", "O"), ("</S>", "</S>")]
    kermit = labels_of('<bibl> <author> Hinshaw, et al. </author> , <title level="j"> Circ. Shock </title> <biblScope type="vol"> 30 </biblScope> , <biblScope type="issue"> 2 </biblScope> <biblScope type="pp"> 279-292 </biblScope> ( <date> 1990 </date> ) </bibl>', "kermit")
    assert ("Hinshaw,", "B_A") in kermit and ("Shock", "E_V") in kermit and ("30", "W_volume") in kermit and ("2", "O") in kermit and ("279-292", "W_pages") in kermit and ("1990", "W_Y") in kermit


def test_tagged_lines_that_are_odd(spark):
    assert labels_of("<title> a <note> b </note> c </title> d", "cora")[1:-1] == [("a", "B_T"), ("b", "W_note"), ("c", "E_T"), ("d", "O")]
    assert labels_of("</title> a <title> b <note> c </title> d x-> <date> e", "cora")[1:-1] == [("a", "O"), ("b", "W_T"), ("c", "W_note"), ("d", "O"), ("e", "W_Y")]
    assert labels_of("<title></title>a<b>c", "cora")[1:-1] == [("a", "O"), ("c", "O")]
    df = spark.createDataFrame([(None,), ("",), ("<title> x </title>",)], "line string")
    from paperloom.operators.tagged import labelled_line

    assert sorted(len(r[0]) for r in df.select(labelled_line(F.col("line"), "cora")).collect()) == [2, 2, 3]


def test_initials_of_sharp_s(spark, tmp_path):
    """The capital of one letter is one letter, as in the SQL: a name that begins with a sharp s is found again."""
    import duckdb

    from paperloom.plans import supervision_queries as P

    words = "title of it here ann lee x y ß wald z v ida berg und mehr"
    table = spark.createDataFrame([(2, words), (4, words.replace("ß", "ǰ")), (5, words.replace("ß", "é"))], "doc_id long, text string")
    table.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, at_least in (("author_patterns", 8), ("supervised_labels", 3)):
        got = sorted(tuple(r) for r in P.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(P.ORACLE_SQL[name]).fetchall()) and len(got) >= at_least
    assert (2, 1, "ẞ. wald", 8, 10) in {tuple(r) for r in P.author_patterns(spark, str(tmp_path)).collect()}
