"""Distant supervision: names and titles found in token sequences by optional-token patterns, and labels made of them.

A pattern is an array of elements, each a token test that may be skipped if it is ``optional``. It is an automaton
whose state is the number of elements behind it; a fold over tokens carries the set of states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.text import normalize_characters
from ..llm.common import cut
from .control import numbered
from .sequence import spans

ELEMENT = "array<struct<kind:string,word:string,optional:boolean>>"


def plain_tokens(tokens: Column) -> Column:
    """Tokens as patterns compare them: plain signs, lower case. Tokens hold no newline, so they are normalised together."""
    return F.when(F.size(tokens) > 0, F.split(F.lower(normalize_characters(F.array_join(tokens, "\n", ""))), "\n")).otherwise(F.array().cast("array<string>"))


def name_pattern(name: Column) -> Column:
    """The pattern of a person's name.

    A single letter (with or without a full stop) but the last token stands for every word that begins with it; a longer token
    but the last may be shortened to its initial; the last one may be followed by signs and digits, as footnote marks are.
    Tokens inside the name are optional, and a name of two tokens may have a middle initial.
    """
    words = F.filter(F.split(F.lower(normalize_characters(F.translate(name, "()?*+^", ""))), " "), lambda w: w != "")
    short = lambda w: w.rlike(r"^[a-z]\.?\z")
    middle = F.array(F.struct(F.lit("letter").alias("kind"), F.lit("").alias("word"), F.lit(True).alias("optional")))

    def elements(words: Column) -> Column:
        last = F.size(words) - 1
        kind = lambda w, i: F.when(i == last, "last").when(short(w), "initial").otherwise("name")
        return F.transform(words, lambda w, i: F.struct(kind(w, i).alias("kind"), F.when((i < last) & short(w), F.left(w, F.lit(1))).otherwise(w).alias("word"), ((i > 0) & (i < last)).alias("optional")))

    return bound(bound(words, elements), lambda e: F.when(F.size(e) == 2, F.concat(F.slice(e, 1, 1), middle, F.slice(e, 2, 1))).otherwise(e))


def text_pattern(text: Column) -> Column:
    """The pattern of a string: all of its tokens, in any case."""
    words = F.filter(F.split(F.lower(normalize_characters(text)), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(F.lit("exact").alias("kind"), w.alias("word"), F.lit(False).alias("optional")))


def fits(element: Column, token: Column) -> Column:
    kind, word = element["kind"], element["word"]
    rest = F.substr(token, F.length(word) + 1)
    initial = F.left(word, F.lit(1))
    return (
        F.when(kind == "exact", token == word)
        .when(kind == "name", (token == word) | (token == initial) | (token == F.concat(initial, F.lit("."))))
        .when(kind == "initial", token.startswith(word) & rest.rlike(r"^(?:\.?|[a-z]+)\z"))
        .when(kind == "last", token.startswith(word) & rest.rlike(r"^[\W0-9]*\z"))
        .otherwise(token.rlike(r"^[a-z]\.?\z"))
    )


def matched_length(pattern: Column, tokens: Column) -> Column:
    """How many of the first tokens the pattern takes at most; null if it doesn't take any such run. Name both columns' values once (``bound``)."""
    n = F.size(pattern)
    # an element that is optional may be passed
    passed = lambda s: bound(s, lambda s: F.aggregate(F.sequence(F.lit(1), n), F.slice(s, 1, 1), lambda out, j: F.concat(out, F.array(F.get(s, j) | (F.get(out, j - 1) & F.get(pattern, j - 1)["optional"])))))

    def step(s: Column, x: Column) -> Column:
        on = F.transform(F.sequence(F.lit(0), n), lambda j: F.when(j > 0, F.get(s["states"], j - 1) & fits(F.get(pattern, j - 1), x["t"])).otherwise(F.lit(False)))
        return bound(passed(on), lambda on: F.struct(on.alias("states"), F.when(F.get(on, n), x["i"]).otherwise(s["end"]).alias("end")))

    start = F.struct(passed(F.transform(F.sequence(F.lit(0), n), lambda j: j == 0)).alias("states"), F.lit(None).cast("int").alias("end"))
    # an element takes a token at most
    read = F.transform(F.slice(tokens, F.lit(1), n), lambda t, i: F.struct((i + 1).alias("i"), t.alias("t")))
    return F.when(n > 0, F.aggregate(read, start, step, lambda s: s["end"]))


def first_match(pattern: Column, tokens: Column) -> Column:
    """Struct of ``start`` and ``stop`` of the pattern's first match in plain tokens, the longest from there; null if there is none.

    Only places whose token fits the first element (which must not be optional) are tried, and of those only places
    before a token that begins with the last element's word, if that is needed. Most others are told by the first letter.
    """

    def search(pattern: Column, tokens: Column) -> Column:
        size, first, n = F.size(tokens), F.get(pattern, F.lit(0)), F.greatest(F.size(pattern), F.lit(1))
        near = lambda letter: F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.get(tokens, i).startswith(letter))
        end = F.try_element_at(pattern, F.lit(-1))
        needed = ~end["optional"] & end["kind"].isin("exact", "last")
        ends = lambda i: bound(F.when(needed, end["word"]).otherwise(""), lambda w: F.exists(F.slice(tokens, i + 1, n), lambda t: t.startswith(w)))
        begins = F.filter(bound(F.left(first["word"], F.lit(1)), near), lambda i: ends(i) & fits(first, F.get(tokens, i)))
        tried = F.transform(begins, lambda i: F.struct(i.alias("start"), (i + bound(F.slice(tokens, i + 1, n), lambda t: matched_length(pattern, t))).alias("stop")))
        return F.when(F.size(pattern) > 0, F.array_min(F.filter(tried, lambda m: m["stop"].isNotNull())))

    return bound(pattern, lambda p: bound(tokens, lambda t: search(p, t)))


def find_names(papers: DataFrame) -> DataFrame:
    """``id, n, name, start, stop`` of the authors found: each one's first occurrence in ``tokens``. A paper stays in its row."""
    place = lambda a, i, m: F.struct(i.alias("n"), a.alias("name"), m["start"].alias("start"), m["stop"].alias("stop"))
    found = bound(plain_tokens(F.col("tokens")), lambda t: F.transform("authors", lambda a, i: bound(first_match(name_pattern(a), t), lambda m: place(a, i, m))))
    return papers.select("id", F.inline(F.filter(found, lambda x: x["start"].isNotNull())))


def labelled(papers: DataFrame, author_tag: str = "A", title_tag: str = "T") -> DataFrame:
    """``papers`` (``id, tokens, title, authors`` and more) with ``labels``, between ``<S>`` and ``</S>``.

    The first occurrence of each author and then of the title becomes B, I, E or W of its tag; a later one takes the tokens that
    it shares with earlier ones. Papers without tokens, authors or title, or in which the title isn't found, go. A paper stays
    one row throughout; nothing is shuffled.
    """
    tagged = lambda m, tag: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(tag).alias("tag"))

    def label(i: Column, m: Column) -> Column:
        kind = F.when(m["stop"] - m["start"] == 1, "W_").when(i == m["start"], "B_").when(i == m["stop"] - 1, "E_").otherwise("I_")
        return F.coalesce(F.concat(kind, m["tag"]), F.lit("O"))

    def marks(plain: Column, title: Column) -> Column:
        names = F.filter(F.transform("authors", lambda a: first_match(name_pattern(a), plain)), lambda m: m.isNotNull())
        return F.concat(F.transform(names, lambda m: tagged(m, author_tag)), F.array(tagged(title, title_tag)))

    def written(marks: Column) -> Column:
        last = lambda i: F.try_element_at(F.filter(marks, lambda m: (m["start"] <= i) & (i < m["stop"])), F.lit(-1))
        # before the first mark and behind the last one no token is looked at
        around = F.struct(F.array_min(F.transform(marks, lambda m: m["start"])).alias("low"), F.array_max(F.transform(marks, lambda m: m["stop"])).alias("high"))
        inside = lambda r: F.transform(F.sequence(r["low"], r["high"] - 1), lambda i: bound(last(i), lambda m: label(i, m)))
        others = lambda n: F.array_repeat(F.lit("O"), n)
        return bound(around, lambda r: F.concat(F.array(F.lit("<S>")), others(r["low"]), inside(r), others(F.size("tokens") - r["high"]), F.array(F.lit("</S>"))))

    def labels(plain: Column) -> Column:
        return bound(first_match(text_pattern(F.col("title")), plain), lambda t: F.when(t.isNotNull(), bound(marks(plain, t), written)))

    rows = papers.filter(F.col("title").isNotNull() & F.col("authors").isNotNull() & (F.size("tokens") > 0))
    # a generator, so that no filter on the labels works them out a second time
    return rows.select("*", F.explode(F.filter(F.array(bound(plain_tokens(F.col("tokens")), labels)), lambda x: x.isNotNull())).alias("labels"))


def label_in_bulk(papers: DataFrame, excluded: DataFrame | None = None, min_year: int = 0, most: int = 0, check_authors: bool = False, first_tokens: int = 0) -> DataFrame:
    """Labelled papers for training, in the order of their ids: at most ``most`` (0: all) of those that can be labelled.

    Papers whose id is in ``excluded`` don't take part, nor, with a ``min_year``, those of earlier or unknown ``year``. With
    ``check_authors`` a paper counts only if its labels give as many author spans as it has authors. ``first_tokens`` limits the
    tokens that are read (0: all). The stop is global: papers are counted by ranges of ids, not in one task. All papers are labelled
    once, of which only the ids are kept and shuffled; then those that are taken are labelled again.
    """
    rows = papers.filter(F.col("year") >= min_year) if min_year > 0 else papers
    rows = rows.withColumn("tokens", F.slice("tokens", 1, first_tokens)) if first_tokens > 0 else rows
    counts = lambda df: df.filter(F.size(F.filter(spans(F.col("labels")), lambda s: s["tag"] == "A")) == F.size("authors")) if check_authors else df
    allowed = lambda df: df if excluded is None else df.join(excluded.select("id").distinct(), "id", "left_anti")
    if most <= 0:
        return counts(labelled(allowed(rows)))
    able = cut(allowed(counts(labelled(rows)).select("id")))
    taken = cut(numbered(able, "id").filter(F.col("index") < most).groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("_most")))
    last = taken.agg(F.max("_id")).first()[0]
    rows = rows.filter(F.col("id").isNull() | (F.col("id") <= F.lit(last))).join(taken, F.col("id").eqNullSafe(F.col("_id")))
    again = counts(labelled(rows)).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("id")))
    return again.filter(F.col("_n") <= F.col("_most")).drop("_n", "_id", "_most")
