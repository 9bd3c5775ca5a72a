"""Readers, sinks, streams and control over files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom import schema
from paperloom.operators import control as C
from paperloom.sources import readers as R
from paperloom.sources import sinks as W
from paperloom.streaming import ingest

TEI = """<TEI><teiHeader><fileDesc><titleStmt><title>On Things.</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>A</forename><surname>Roe</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short text.</p></abstract></profileDesc></teiHeader><text><back><listBibl>
<biblStruct><analytic><title>First work</title><author><persName><forename>J</forename><surname>Doe</surname></persName></author></analytic><monogr><title>Journal</title><imprint><date when="2001-05"/></imprint></monogr></biblStruct>
<biblStruct><monogr><title>A book</title><author><persName><forename>K</forename><surname>Lee</surname></persName></author><imprint><date>1999</date></imprint></monogr></biblStruct></listBibl></back></text></TEI>"""
ARTICLE = """<article><front><journal-meta><journal-title-group><journal-title>J. Things</journal-title></journal-title-group></journal-meta><article-meta><title-group><article-title>On Things</article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Jane</given-names></name></contrib></contrib-group><pub-date><year>2004</year></pub-date><pub-date><year>2005</year></pub-date><abstract><sec><p>One.</p></sec></abstract></article-meta></front></article>"""


def test_files_by_name_and_resume(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name in ("in/a.pdf", "in/deep/b.pdf", "in/c.txt"):
        (tmp_path / name).write_bytes(b"x" + name.encode())
    found = R.files(spark, str(tmp_path / "in"))
    assert sorted(r.id for r in found.select("id").collect()) == ["a", "b"]
    done = spark.createDataFrame([("a",)], "id string")
    assert [r.id for r in C.resume(found, done, "id").collect()] == ["b"]


def test_json_lines_of_papers(spark, tmp_path):
    rows = [{"id": "abcdef", "title": "T", "authors": ["Doe, Jane", "Roe"], "year": 2001, "venue": None}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)))
    got = R.papers(spark, str(tmp_path / "p.json")).first()
    assert (got.authors, got.key, got.url) == (["Jane Doe", "Roe"], "ef", None)


def test_gold_tables_and_cells(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("AB\tx|2001|V|a:b\ty|?||c\nCD\n\n")
    gold = R.gold_table(spark, str(tmp_path / "g.tsv"), "cells")
    got = {r.id: r.b for r in gold.select("id", R.bibliography_cells(F.col("cells")).alias("b")).collect()}
    assert got["cd"] == [] and [tuple(x) for x in got["ab"]] == [("x", 2001, "V", ["a", "b"]), ("y", None, "", ["c"])]


def test_gazetteers_vectors_frequencies(spark, tmp_path):
    (tmp_path / "gaz").mkdir()
    (tmp_path / "gaz/names.txt").write_text("# c\nAbbey\n")
    assert {(r.gazetteer, r.entry) for r in R.gazetteer_directory(spark, str(tmp_path / "gaz")).collect()} == {("names", "# c"), ("names", "Abbey")}
    (tmp_path / "v.txt").write_text("cat 1 2.5\n")
    assert R.word_vectors(spark, str(tmp_path / "v.txt")).first().vector == [1.0, 2.5]
    (tmp_path / "f.tsv").write_text("a_b\t12\n")
    assert R.ngram_frequencies(spark, str(tmp_path / "f.tsv")).first().freq == 12


def test_tei_and_article_xml(spark):
    df = spark.createDataFrame([("x", TEI)], "id string, xml string")
    head = R.tei_headers(df, "id", "xml").first()
    assert (head.title, head.abstract, head.surnames) == ("On Things", "Short text.", ["Roe"])
    refs = [(r.n, r.title, r.authors, r.venue, r.year) for r in R.tei_references(df, "id", "xml").orderBy("n").collect()]
    assert refs == [(0, "First work", ["J Doe"], "Journal", 2001), (1, "A book", ["K Lee"], None, 1999)]
    art = R.article_xml(spark.createDataFrame([("x", ARTICLE)], "id string, xml string"), "id", "xml").first()
    assert (art.title, art.year, art.venue, art.abstract, art.authors) == ("On Things", 2004, "J. Things", "One.", ["Jane Doe"])


def test_affiliations(spark):
    people = spark.createDataFrame([(1, "A", "r1"), (1, "A", "r2"), (1, "B", None)], "id long, author string, ref string")
    places = spark.createDataFrame([(1, "r1", "X"), (1, "r2", "Y")], "id long, ref string, affiliation string")
    assert {r.author: r.affiliations for r in R.affiliations(people, places).collect()} == {"A": ["X", "Y"], "B": []}


def test_metadata_round_trip(spark):
    row = ("CRF", "T", ["A"], [], [("H", "text")], [("R", ["B"], "V", "1", None, 2001)], [(0, "ctx [1]", 4, 7)], 2001, None, None)
    df = spark.createDataFrame([row], schema.METADATA)
    again = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).select(F.from_json("j", schema.METADATA).alias("m")).select("m.*")
    assert again.collect() == df.collect()


def test_append_only_new_documents(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v long")
    W.append_json(rows, out, "id")
    W.append_json(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), out, "id")
    assert sorted(r.id for r in spark.read.schema(rows.schema).json(out).collect()) == ["a", "b", "c"]


def test_feature_matrix_and_weights(spark, tmp_path):
    f = spark.createDataFrame([(1, "%b", 1.0), (1, "%x", 0.5), (2, "%x", 2.0), (2, "%c", 1.0)], "id long, feature string, value double")
    got = {r.id: (r.binary, r["%x"]) for r in W.feature_matrix(f).collect()}
    assert got == {1: ("%b", 0.5), 2: ("%c", 2.0)}
    W.save_weights(f, str(tmp_path / "w"))
    assert W.load_weights(spark, str(tmp_path / "w")).count() == 4


def test_stream_of_feedback_keeps_the_latest(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(r, "paper string, at timestamp_ntz, value string")
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    rows(("p", day(1), "old"), ("q", day(2), "only")).write.parquet(str(src))
    for extra in (None, rows(("p", day(3), "new"), ("q", day(1), "late"))):
        if extra is not None:
            extra.write.mode("append").parquet(str(src))
        stream = ingest.arriving_rows(spark, str(src), "paper string, at timestamp_ntz, value string")
        ingest.upsert_latest(stream, out, "paper", "at", str(tmp_path / "ck")).awaitTermination()
    assert {r.paper: r.value for r in spark.read.parquet(f"{out}/1").collect()} == {"p": "new", "q": "only"}


def test_lists_in_lists_are_expanded(spark, tmp_path):
    sha = "0123456789" * 4
    a, b, c = (str(tmp_path / f"{n}.txt") for n in "abc")
    (tmp_path / "a.txt").write_text(f"x.pdf\n# note\n\n{b}\n{c}\ndir/\n")
    (tmp_path / "b.txt").write_text(f"{a}\ny.pdf\nx.pdf\n{sha}\n{c}\n")
    (tmp_path / "c.txt").write_text(f"{c}\n z.pdf \nwhat\n")
    inputs = spark.createDataFrame([(a,), ("y.pdf",), (None,), (" ",), (a,)], "entry string")
    got = {r.entry: (r.kind, r.depth) for r in R.expand_inputs(spark, inputs).collect()}
    assert got == {"x.pdf": ("file", 1), "y.pdf": ("file", 0), "z.pdf": ("file", 2), "dir/": ("folder", 1), sha: ("id", 2), "what": ("unknown", 2)}
    with pytest.raises(ValueError, match="deeper than 1"):
        R.expand_inputs(spark, inputs, depth=1)
    with pytest.raises(ValueError, match="over 1 lists"):
        R.expand_inputs(spark, inputs, most_lists=1)
    assert R.expand_inputs(spark, inputs.filter("entry = 'none'")).count() == 0
