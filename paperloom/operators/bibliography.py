"""Bibliographies: entries of a section, records of an entry, the style of a section, and citations of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.names import author_list
from ..functions.text import ref_year

_INITIALS = r"(?:\p{Lu}\. ?)+"
_NAME = r"\p{Lu}[\p{L}'\-]+"
_YEAR = "[12][0-9]{3}"
#: From an initial on, up to a stop that does not follow one.
_PEOPLE = r"\p{Lu}\.(?:\b\p{Lu}\.|[^.\"])+"

#: Record styles in the order of preference: how entries begin, and the groups of a whole entry. All patterns are
#: linear (no look-around, no nested repetition of the same class), so they also run in engines without backtracking.
STYLES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "close_paren": ("paren", rf"^([0-9]+)\) +([^.]+?)(?:, et al)?\. +([^.?]+)[.?] +(.*?) +({_YEAR});.*$", ("key", "authors", "title", "venue", "year")),
    "bracket_quoted": ("bracket", r"""^\[([0-9]+)\] (.+?)[,.:] ["“'](.+?),?["”'] (?:[Ii]n )?(.*?)\.?$""", ("key", "authors", "title", "venue")),
    "named_year": ("named", rf"^([^0-9(\[]+?) ({_YEAR})[a-z]?[.,:] ([^.?!]+)[.?!] (.*?)\.?$", ("authors", "year", "title", "venue")),
    "named_year_parens": ("named", rf"^([^0-9(\[]+?) \(({_YEAR})[a-z]?\)[.,:]? ([^.?!]+)[.?!] (.*?)\.?$", ("authors", "year", "title", "venue")),
    "dot_colon": ("dot", rf"^([0-9]+)\. ([^:]+): ([^.]+)\. (.*?),? ?\(({_YEAR})\).*$", ("key", "authors", "title", "venue", "year")),
    "dot_no_title": ("dot", rf"^([0-9]+)\. +({_NAME}, {_INITIALS}(?:; {_NAME}, {_INITIALS})*) ([^0-9]*) ({_YEAR})[.,].*$", ("key", "authors", "venue", "year")),
    "dot_plain": ("dot", rf"^([0-9]+)\. ({_PEOPLE})\. ([^.]+)\. (.*?),? ({_YEAR})\.?$", ("key", "authors", "title", "venue", "year")),
    "bracket_commas": ("bracket", rf"^\[([0-9]+)\] ({_INITIALS}{_NAME}(?:(?:, and|,| and) {_INITIALS}{_NAME})*), ([^,\"]+), (.*?),? \(?({_YEAR})\)?\.?$", ("key", "authors", "title", "venue", "year")),
    "bracket_plain": ("bracket", rf"^\[([0-9]+)\] ({_PEOPLE})\. ([^.\"]+)\. (.*?),? ({_YEAR})\.?$", ("key", "authors", "title", "venue", "year")),
    "bracket_name": ("bracket_name", rf"^\[([^\]]*[^\]0-9][^\]]*)\] (.+?)[.,] ([^.,]+)[.,] (?:[Ii]n )?(.*?),? ({_YEAR})\..*$", ("key", "authors", "title", "venue", "year")),
}
#: What begins an entry after a line or block mark, with its number.
MARKERS = {"bracket": r"\[([0-9]+)\]", "dot": r"([0-9]+)\. ", "paren": r"([0-9]+)\)"}
#: Pieces of a section that a fold takes at a time.
BLOCK = 256


def segment_numbered(section: Column, marker: str) -> Column:
    """Entries of a section text: from marker 1 on, each cut before the next number in turn.

    A number that is out of turn does not cut, so a missing one leaves the rest in one entry. A fold over the pieces
    between possible markers carries the next number; it goes by blocks of pieces, since each step copies what has been
    found, and gives places only.
    """
    pattern = MARKERS[marker]
    text = lambda p: F.regexp_extract(p, f"^{pattern}", 1)
    number = lambda p: bound(text(p), lambda t: F.when(t.try_cast("int").cast("string") == t, t.try_cast("int")))
    state = lambda at, following: F.struct(at.alias("at"), following.alias("next"))

    def starts(numbers: Column) -> Column:
        size, none = F.size(numbers), F.array().cast("array<int>")

        def step(s: Column, i: Column) -> Column:
            due = F.coalesce(F.get(numbers, i) == s["next"], F.lit(False))
            return F.when(due, state(F.concat(s["at"], F.array(i)), s["next"] + 1)).otherwise(s)

        def block(s: Column, i: Column) -> Column:
            within = F.aggregate(F.sequence(i, F.least(i + (BLOCK - 1), size - 1)), state(none, s["next"]), step)
            return bound(within, lambda w: state(F.concat(s["at"], F.array(w["at"])), w["next"]))

        return F.aggregate(F.sequence(F.lit(0), size - 1, F.lit(BLOCK)), state(F.array().cast("array<array<int>>"), F.lit(1)), block, lambda s: F.flatten(s["at"]))

    def entries(pieces: Column, at: Column) -> Column:
        stop = lambda k: F.coalesce(F.get(at, k + 1), F.size(pieces))
        # places in turn, not a slice, which may read the whole array
        joined = lambda i, to: F.when(to == i + 1, F.get(pieces, i)).otherwise(F.array_join(F.transform(F.sequence(i, to - 1), lambda j: F.get(pieces, j)), "<lb>"))
        return F.transform(at, lambda i, k: bound(stop(k), lambda to: F.trim(F.replace(F.regexp_replace(joined(i, to), "-<lb>", ""), F.lit("<lb>"), F.lit(" ")))))

    return bound(F.split(section, rf"(?:<lb>|<bb>|^)(?={pattern})"), lambda p: bound(F.transform(p, number), lambda n: bound(starts(n), lambda at: entries(p, at))))


def segment_named(section: Column) -> Column:
    """Blocks as entries; none if the first one that is not empty looks numbered."""
    parts = F.filter(F.transform(F.split(section, "<bb>"), lambda p: F.trim(F.replace(F.regexp_replace(p, "-<lb>", ""), F.lit("<lb>"), F.lit(" ")))), lambda p: p != "")
    return F.when(F.get(parts, F.lit(0)).rlike(r"^(\[[0-9]+\]|[0-9]+[.)])"), F.array().cast("array<string>")).otherwise(parts)


def segment(section: Column, how: str) -> Column:
    return segment_numbered(section, how) if how in MARKERS else segment_named(section)


def parse(entry: Column, style: str) -> Column:
    """Struct of key, authors, title, venue, year of an entry; null if the style's pattern does not fit."""
    _, pattern, groups = STYLES[style]
    part = lambda name: F.regexp_extract(entry, pattern, groups.index(name) + 1) if name in groups else F.lit("")
    year = part("year").try_cast("int") if "year" in groups else ref_year(part("venue"))
    fields = [part(n).alias(n) for n in ("key", "authors", "title", "venue")]
    return F.when(entry.rlike(pattern), F.struct(*fields, year.alias("year")))


def parse_first(entry: Column, *styles: str) -> Column:
    """The record of the first style that fits."""
    return F.coalesce(*[parse(entry, s) for s in styles])


def clean_records(records: DataFrame, longest: int = 512) -> DataFrame:
    """Titles without quotes, commas and stops at their ends; no record with an empty or over-long title or authors."""
    out = records.withColumn("title", F.regexp_replace("title", r"""^["'“”.,\s]+|["'“”.,\s]+$""", ""))
    good = [F.length(c).between(1, longest - 1) for c in ("title", "authors")]
    return out.filter(good[0] & good[1] & (F.length("venue") < longest))


def with_authors(records: DataFrame) -> DataFrame:
    return records.withColumn("author_list", author_list(F.col("authors")))


def select_style(sections: DataFrame, known: DataFrame | None = None, styles: tuple[str, ...] = tuple(STYLES)) -> DataFrame:
    """``section, style, n, key .. year``: each section's records by its best style.

    ``sections`` has ``section, body`` (with ``<lb>`` and ``<bb>`` marks). A style scores its number of clean records
    plus 10,000 for each whose title and year are in ``known`` (``title, year``); ties go to the earlier style.
    """
    kinds = list(dict.fromkeys(STYLES[s][0] for s in styles))
    cut = F.array(*[F.struct(F.lit(k).alias("kind"), segment(F.col("body"), k).alias("entries")) for k in kinds])
    entries = sections.select("section", F.inline(cut)).select("section", "kind", F.posexplode("entries").alias("n", "entry"))
    tries = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).alias("style"), F.when(F.col("kind") == STYLES[s][0], parse(F.col("entry"), s)).alias("r")) for i, s in enumerate(styles)])
    rows = entries.select("section", "n", F.inline(F.filter(tries, lambda t: t["r"].isNotNull())))
    rows = clean_records(rows.select("section", "rank", "style", "n", "r.*"))
    if known is not None:
        rows = rows.join(known.select("title", "year", F.lit(True).alias("known")).distinct(), ["title", "year"], "left")
    score = F.sum(F.when(F.col("known"), 10_001).otherwise(1) if known is not None else F.lit(1))
    best = rows.groupBy("section", "rank").agg(score.alias("score")).groupBy("section").agg(F.max_by("rank", F.struct("score", -F.col("rank"))).alias("rank"))
    return rows.join(best, ["section", "rank"]).select("section", "style", "n", "key", "authors", "title", "venue", "year")


# citations

NUMBER_LIST = r"\[([0-9]+(?: ?[,;\-–] ?[0-9]+)*)\]"


def sentences(text: Column) -> Column:
    """Parts of a text that end in a stop, question or exclamation mark before a blank."""
    return F.filter(F.split(text, r"(?<=[.!?]) +(?=[\p{Lu}\[(])"), lambda s: s != "")


def markers(contexts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, sentence, context, place, marker``: bracketed number lists of each sentence, ``place`` among its markers."""
    rows = contexts.select(F.col(id_col).alias("id"), F.posexplode(sentences(F.col(text_col))).alias("sentence", "context"))
    return rows.select("id", "sentence", "context", F.posexplode(F.regexp_extract_all("context", F.lit(NUMBER_LIST), 1)).alias("place", "marker"))


def expand_numbers(marker: Column) -> Column:
    """Numbers of a marker's list; ``n-m`` (without blanks) stands for all from n to m, and for none if m is less."""
    pieces = F.split(marker, " ?[,;] ?")

    def one(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^([0-9]+)[\-–]([0-9]+)$", 1).try_cast("int"), F.regexp_extract(p, r"^([0-9]+)[\-–]([0-9]+)$", 2).try_cast("int")
        single = F.filter(F.array(p.try_cast("int")), lambda x: x.isNotNull())
        return F.when(a.isNotNull() & (a <= b), F.sequence(a, F.greatest(a, b))).when(a.isNotNull(), F.array().cast("array<int>")).otherwise(single)

    return F.flatten(F.transform(pieces, one))


def resolve(found: DataFrame, records: DataFrame, section_col: str) -> DataFrame:
    """Mentions whose number is a record of their section: an equi-join on section and number."""
    numbers = found.withColumn("n", F.explode(expand_numbers(F.col("marker"))))
    return numbers.join(records.select(section_col, "n").distinct(), [section_col, "n"])


def with_offsets(found: DataFrame) -> DataFrame:
    """Add ``start`` and ``stop`` (0-based, end exclusive) of the marker in its context: after ``place`` earlier ones."""
    head = F.array_join(F.slice(F.split("context", NUMBER_LIST), F.lit(1), F.col("place") + 1), "")
    earlier = F.aggregate(F.slice(F.regexp_extract_all("context", F.lit(NUMBER_LIST), 0), F.lit(1), F.col("place")), F.lit(0), lambda s, m: s + F.length(m))
    return found.withColumn("start", F.length(head) + earlier).withColumn("stop", F.col("start") + F.length("marker") + 2)


def long_contexts(found: DataFrame, least: int = 35) -> DataFrame:
    return found.filter(F.length("context") - (F.col("stop") - F.col("start")) >= least)


def predominant_style(found: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, style``: the most frequent opening sign of a document's mentions ( ( [ or other ); ties to the one that
    reaches the number first. ``found`` has ``sign`` and ``at`` (the order of mentions)."""
    n = F.row_number().over(Window.partitionBy(id_col, "sign").orderBy("at"))
    reached = found.withColumn("k", n).groupBy(id_col, "sign").agg(F.max("k").alias("n"), F.max("at").alias("at"))
    return reached.groupBy(id_col).agg(F.max_by("sign", F.struct("n", -F.col("at"))).alias("style"))
