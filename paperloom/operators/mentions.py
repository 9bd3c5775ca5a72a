"""Citation mentions: markers of each style, narrative citations, sentence contexts and a document's own style.

``units`` are ``id, unit, text``: a document's paragraphs. ``records`` are its bibliography, ``id, n`` and what
the style's key needs. Offsets count characters from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.text import superscripts_to_brackets
from ..llm.common import cut
from .bibliography import expand_numbers

# What encloses a superscript, what the markers of a style look like and how their parts are set apart.
SUPER, UNSUPER = "⍐", "⍗"
_NUMBER = r"[1-9][0-9]*(?: *- *[1-9][0-9]*)?"
NUMBERS = rf"{_NUMBER}(?: *[,;|] *{_NUMBER})*"
MARKERS: dict[str, tuple[str, str]] = {
    "number": (rf"[\[(]{NUMBERS}[\])]|\.{SUPER}{NUMBERS}{UNSUPER}", r" *[,;|] *"),
    "paren_number": (r"\([0-9, \p{Pd}]+\)", "[, ;]+"),
    "named": (r"[\[(][^\[\]()]+ [12][0-9]{3}[a-z]?[\])]", "; ?"),
    "bracket_name": (r"\[[^\]]+\]", "; ?"),
}
SHORT_YEAR = r"[\[(][12][0-9]{3}[a-z]?[\])]"
#: Signs before a mention that its sentence may end with: "... sentence.(1,2)".
REWOUND = f"([.{SUPER}"


def running(sizes: Column, block: int = 256) -> Column:
    """Running totals of an array of numbers. A fold copies what it has at each step, so long arrays go by blocks."""
    fold = lambda xs: F.aggregate(xs, F.array().cast("array<int>"), lambda out, x: F.concat(out, F.array(F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + x)))

    def by_blocks(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: fold(F.slice(xs, b * block + 1, block)))
        tops = lambda bs: fold(F.transform(bs, lambda x: F.try_element_at(x, F.lit(-1))))
        moved = lambda bs, before: F.flatten(F.transform(bs, lambda xs, b: F.transform(xs, lambda x: x + F.when(b > 0, F.get(before, b - 1)).otherwise(0))))
        return bound(blocks, lambda bs: bound(tops(bs), lambda before: moved(bs, before)))

    return bound(sizes, lambda xs: F.when(F.size(xs) <= block, fold(xs)).otherwise(by_blocks(xs)))


def places(units: DataFrame, pattern: str, *extra: Column) -> DataFrame:
    """``id, unit, k, marker, start, stop``: all matches of a pattern. ``extra`` columns may use ``head``, the text between the last match and this
    one, the others and ``text``.

    A unit stays in its row, where the offsets are added up; nothing is shuffled.
    """

    def found(markers: Column) -> Column:
        heads = F.slice(F.split("text", pattern), F.lit(1), F.size(markers))
        pairs = F.arrays_zip(heads.alias("head"), markers.alias("marker"))
        stops = lambda ms: running(F.transform(ms, lambda m: F.length(m["head"]) + F.length(m["marker"])))
        placed = lambda ms: F.zip_with(ms, stops(ms), lambda m, stop: F.struct(m["head"].alias("head"), m["marker"].alias("marker"), stop.alias("stop")))
        return F.when(F.size(markers) > 0, bound(pairs, placed))

    rows = units.select("id", "unit", "text", F.posexplode(bound(F.regexp_extract_all("text", F.lit(pattern), 0), found)).alias("k", "m"))
    rows = rows.select("id", "unit", "text", "k", F.col("m.head").alias("head"), F.col("m.marker").alias("marker"), F.col("m.stop").alias("stop"))
    rows = rows.withColumn("start", F.col("stop") - F.length("marker"))
    return rows.select("id", "unit", "k", "marker", *extra, "stop", "start")


def plain_key(c: Column) -> Column:
    """A name key as it is compared: no case, no punctuation, single blanks, no letter after a year."""
    bare = F.regexp_replace(F.lower(c), r"\p{P}+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"([12][0-9]{3})[a-z]\z", "$1"))


def author_key(authors: Column) -> Column:
    """How a text names the authors: one or two last words of names, or the first and *et al.*; null if there are none."""
    last = F.transform(authors, lambda a: F.substring_index(F.trim(a), " ", -1))
    first, n = F.get(last, F.lit(0)), F.size(authors)
    return F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(" and "), F.get(last, F.lit(1)))).when(n > 2, F.concat(first, F.lit(" et al.")))


def record_key(style: str) -> Column:
    """What a marker of the style says of a record: its number, its authors and year, or its own ``key``."""
    if style == "named":
        return plain_key(F.concat(author_key(F.col("authors")), F.lit(" "), F.col("year").cast("string")))
    return plain_key(F.col("key")) if style == "bracket_name" else F.col("n").cast("string")


def marked(units: DataFrame, records: DataFrame, style: str, *extra: Column) -> DataFrame:
    """``id, unit, n, start, stop`` of the records that the style's markers name, and ``extra`` columns of the markers, which may use ``text``.

    Numbers n-m (without blanks) stand for all from n to m. Where records share a key the first is meant. A marker
    that had to begin with the full stop before a superscript begins after it.
    """
    pattern, delimiter = MARKERS[style]
    start = (F.col("start") + F.col("marker").startswith(".").cast("int")).alias("start")
    found = places(units, pattern, "text").select("id", "unit", "k", "marker", "stop", start, "text")
    found = found.select("id", "unit", "k", "marker", "stop", "start", *extra)
    meat = F.regexp_replace("marker", rf"^\.?[\[({SUPER}]|[\]){UNSUPER}]\z", "")
    parts = F.transform(F.split(meat, delimiter), lambda p: F.trim(p))
    if style in ("number", "paren_number"):
        parts = F.flatten(F.transform(parts, lambda p: expand_numbers(p).cast("array<string>")))
    else:
        parts = F.transform(parts, plain_key)
    more = [c for c in found.columns if c not in ("id", "unit", "k", "marker", "stop", "start")]
    asked = found.select("id", "unit", "stop", "start", *more, F.explode(parts).alias("key"))
    known = records.select("id", "n", record_key(style).alias("key")).filter("key <> ''").groupBy("id", "key").agg(F.min("n").alias("n"))
    return asked.join(known, ["id", "key"]).select("id", "unit", "n", "start", "stop", *more)


def narrative(units: DataFrame, records: DataFrame, gap: int = 0, any_year: bool = False) -> DataFrame:
    """``id, unit, n, start, stop`` of narrative citations: the authors' key, then a year in brackets: Name et al. (2005).

    ``records`` are ``id, n, authors, year``. Up to ``gap`` words may stand between key and year. The year must be the
    record's, unless ``any_year``. The runs of words before each bracketed year that have as many words as a key has are joined with the
    keys as a whole. Of the keys before a year the leftmost counts, of equal ones the first record's; as no key reaches over a
    year, citations never overlap.
    """
    width = 4 + gap
    normal = lambda t: plain_key(F.regexp_replace(t, r"['’]s\z", ""))
    tail = F.split(F.substring_index(F.translate("head", "\n\t\r", "   "), " ", -2 * width), " ")
    back = lambda tail, t, i: F.length(F.array_join(F.slice(tail, i + 1, 2 * width), " ")) - F.length(F.regexp_extract(t, r"^\p{P}*", 0))
    words = bound(tail, lambda tail: F.filter(F.transform(tail, lambda t, i: F.struct(normal(t).alias("word"), back(tail, t, i).alias("back"))), lambda w: w["word"] != ""))

    # no word holds a newline
    dated = lambda key, year: key if any_year else F.concat(key, F.lit("\n"), year)
    keys = records.select("id", "n", "year", F.split(plain_key(author_key(F.col("authors"))), " ").alias("names")).filter("names[0] <> ''")
    sizes = sorted(x[0] for x in keys.select(F.size("names")).filter(F.size("names") <= 2 * width).distinct().collect())
    known = keys.groupBy("id", dated(F.array_join("names", "\n"), F.col("year").cast("string")).alias("key")).agg(F.min("n").alias("n"))

    def runs(words: Column) -> Column:
        """Key, size and distance of its start from the year, of the runs that end at most ``gap`` words before it."""
        run = lambda at, size: F.struct(F.array_join(F.transform(F.slice(words, at + 1, size), lambda w: w["word"]), "\n").alias("key"), F.lit(size).alias("size"), F.get(words, at)["back"].alias("back"))
        ends = [(F.size(words) - skipped - size, size) for size in sizes for skipped in range(gap + 1)]
        return F.filter(F.array(*[F.when(at >= 0, run(at, size)) for at, size in ends]), lambda x: x.isNotNull())

    none = F.array().cast("array<struct<key:string,size:int,back:int>>")
    year = F.regexp_extract("marker", "[0-9]{4}", 0)
    asked = places(units, SHORT_YEAR, (bound(words, runs) if sizes else none).alias("runs"), year.cast("int").cast("string").alias("year"))
    asked = asked.select("id", "unit", "start", "stop", "year", F.inline("runs")).select("id", "unit", dated(F.col("key"), F.col("year")).alias("key"), (F.col("start") - F.col("back")).alias("start"), "size", "stop")
    hits = asked.join(known, ["id", "key"]).groupBy("id", "unit", "stop").agg(F.min(F.struct("start", -F.col("size"), "n")).alias("r"))
    return hits.select("id", "unit", F.col("r.n").alias("n"), F.col("r.start").alias("start"), "stop")


def sentence_context(text: Column, start: Column, stop: Column) -> Column:
    """Struct of ``context, start, stop``: the sentence around a mention and the mention's offsets in it.

    The sentence begins after the last full stop before the mention; a mention that begins with a bracket, a full stop or a
    superscript belongs to the sentence that ends right before it. A superscript that the sentence begins with is left out
    if it ends before the mention. The sentence ends with the first full stop after the mention. Blanks around it go.
    """
    head, sign = F.left(text, start), F.substr(text, start + 1, F.lit(1))
    back = F.when(F.instr(F.lit(REWOUND), sign) > 0, F.regexp_replace(head, rf"[(\[.{SUPER}]+\z", "")).otherwise(head)
    rest = F.substr(text, stop + 1)
    end = stop + bound(F.length(F.substring_index(rest, ".", 1)), lambda n: n + F.when(n < F.length(rest), 1).otherwise(0))

    def past_superscript(begin: Column) -> Column:
        closed = begin + F.length(F.substring_index(F.substr(text, begin + 1), UNSUPER, 1))
        return F.when((F.substr(text, begin + 1, F.lit(1)) == SUPER) & (closed < start), closed + 1).otherwise(begin)

    def cut(begin: Column) -> Column:
        whole = F.substr(text, begin + 1, end - begin)
        blank = F.length(F.regexp_extract(whole, r"^[\x00-\x20]*", 0))
        return bound(begin + blank, lambda b: F.struct(F.regexp_replace(whole, r"^[\x00-\x20]+|[\x00-\x20]+\z", "").alias("context"), (start - b).cast("int").alias("start"), (stop - b).cast("int").alias("stop")))

    begin = bound(back, lambda b: F.length(b) - F.length(F.substring_index(b, ".", -1)))
    return bound(bound(begin, past_superscript), cut)


def with_contexts(found: DataFrame, units: DataFrame, least: int = 35) -> DataFrame:
    """``id, unit, place, n, context, start, stop`` of mentions whose sentence has ``least`` characters besides them; ``place`` is the mention's offset in the unit."""
    rows = found.join(units.select("id", "unit", "text"), ["id", "unit"])
    long = F.filter(F.array(sentence_context(F.col("text"), F.col("start"), F.col("stop"))), lambda c: F.length(c["context"]) - (c["stop"] - c["start"]) >= least)
    # a generator, so that the context is worked out once
    return rows.select("id", "unit", F.col("start").alias("place"), "n", F.inline(long))


def document_styles(signs: DataFrame, least_square: int = 4) -> DataFrame:
    """``id, style`` from ``id, sign, unit, place, n``: see :func:`keep_predominant`."""
    counts = signs.groupBy("id", "sign").agg(F.count("*").alias("n"), F.max(F.struct("unit", "place", "n")).alias("last"))
    # a document has at most four signs
    best = counts.groupBy("id").agg(F.collect_list(F.struct("n", "last", "sign")).alias("all"), F.max("n").alias("most"), F.max(F.when(F.col("sign") == "[", F.col("n"))).alias("square"))
    tied = F.transform(F.filter("all", lambda x: x["n"] == F.col("most")), lambda x: F.struct(x["last"].alias("last"), x["sign"].alias("sign")))
    best = best.select("id", F.array_min(tied)["sign"].alias("first"), "square")
    style = F.when((F.col("first") == "(") & (F.col("square") > least_square), "[").otherwise(F.col("first"))
    return best.select("id", style.alias("style"))


def opening_sign(text: Column, start: Column) -> Column:
    sign = F.substr(text, start + 1, F.lit(1))
    return F.when(sign.isin("(", "[", SUPER), sign).otherwise("")


def keep_predominant(found: DataFrame, least_square: int = 4) -> DataFrame:
    """The mentions in their document's style, with superscript signs as round brackets, and the ``style``: ( [ ⍐ or none.

    The style is the opening sign of most mentions, of several the one that got there first (by unit, offset and
    number); [ wins over ( if it opens more than ``least_square``. Where most open otherwise all are kept. A sign's
    counts are summed by document first, and only the counts are compared.
    """
    rows = found.withColumn("sign", opening_sign(F.col("context"), F.col("start")))
    kept = rows.join(document_styles(rows, least_square), "id").filter((F.col("style") == "") | (F.col("sign") == F.col("style")))
    return kept.select("id", "unit", "place", "n", superscripts_to_brackets("context").alias("context"), "start", "stop", "style")


def kept_in_style(units: DataFrame, records: DataFrame, style: str, least: int = 35, least_square: int = 4) -> DataFrame:
    """:func:`keep_predominant` of :func:`with_contexts` of :func:`marked`, in one pass over the texts and one more for those kept.

    Whether a context is long enough and the opening sign are told in the unit's row. Only they and the offsets, which are
    materialised, are counted; the texts are joined with the mentions that stay.
    """
    # a context holds its mention, so the text has the same sign there
    size = F.transform(F.array(sentence_context(F.col("text"), F.col("start"), F.col("stop"))), lambda c: F.length(c["context"]))
    found = marked(units, records, style, F.get(size, F.lit(0)).alias("size"), opening_sign(F.col("text"), F.col("start")).alias("sign"))
    rows = cut(found.filter(F.col("size") - (F.col("stop") - F.col("start")) >= least).select("id", "unit", F.col("start").alias("place"), "stop", "n", "sign"))
    kept = rows.join(document_styles(rows, least_square), "id").filter((F.col("style") == "") | (F.col("sign") == F.col("style")))
    kept = kept.join(units.select("id", "unit", "text"), ["id", "unit"])
    context = F.array(sentence_context(F.col("text"), F.col("place"), F.col("stop")))
    kept = kept.select("id", "unit", "place", "n", "style", F.inline(context))
    return kept.select("id", "unit", "place", "n", superscripts_to_brackets("context").alias("context"), "start", "stop", "style")
