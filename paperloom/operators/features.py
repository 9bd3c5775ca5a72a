"""Token features: masks, stop words, numbers, punctuation, geometry changes, frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The eleven stop words of the header features.
STOP_WORDS = ("a", "an", "the", "in", "of", "for", "from", "and", "as", "but", "to")
#: Mask names and the pattern a whole token has to match.
CASE_MASKS = {
    "%Xxx": "[A-Z][a-z]*", "%xxx": "[a-z]+", "%letters": "[a-zA-Z]+", "%dig": "[0-9]+", "%hasNum": ".*[0-9]+.*",
    "%letDot": r"[A-Z]\.", "%hasNonAscii": r".*[^\x00-\x7F]+.*", "%capWordColon": "[a-zA-Z]+:", "%hasAt": ".*@.*",
}
#: Punctuation features and the pattern to be found.
PUNCTUATION = {
    "%pInitialQuote": r"\p{Pi}", "%pEndQuote": r"\p{Pf}", "%pDoubleDash": r"\p{Pd}\p{Pd}", "%pComma": ",$", "%pColon": ":$",
    "%pSemicolon": ";$", "%pEnding": r"(\.$|\p{Pf}$)", "%pPairedBraces": r"\p{Ps}.*\p{Pe}",
}
NUMBERS = {
    "%pRange": r"^[0-9]+-[0-9]+\p{P}?$", "%hasYear": "(19[0-9]{2}|20[0-9]{2})", "%pVolume": r"^[0-9](\([0-9]+\))?\p{P}?$",
    "%hasDigit": r"[0-9]+\p{P}?", "%ordinal": r"[0-9]+(st|nd|rd|th)\p{P}?",
}
EDITOR_WORDS = ("eds.", "ed.", "editor", "editors")


def case_masks(token: Column) -> Column:
    """Names of the masks that the whole token matches, in their fixed order."""
    found = F.array(*[F.when(token.rlike(f"^({p})$"), F.lit(name)) for name, p in CASE_MASKS.items()])
    return F.filter(found, lambda x: x.isNotNull())


def stop_flags(token: Column) -> list[Column]:
    stop = token.isin(*STOP_WORDS)
    return [stop.alias("stop"), (~stop & token.rlike("^[a-z]+$")).alias("uncapns"), token.isin("and", ",").alias("is_and")]


def length_features(token: Column) -> list[Column]:
    n = F.least(F.length(token), F.lit(10)) / 10.0
    return [n.alias("adj_len"), ((n - 0.5) * (n - 0.5)).alias("adj_len_sq")]


def pattern_flags(token: Column, patterns: dict[str, str]) -> list[Column]:
    return [token.rlike(p).alias(name.strip("%")) for name, p in patterns.items()]


def digit_length(token: Column) -> Column:
    """min(length, 5) of an all-digit token (with one sign of punctuation at most), else null."""
    return F.when(token.rlike(r"^[0-9]+\p{P}?$"), F.least(F.length(token), F.lit(5)))


def affixes(token: Column) -> list[Column]:
    return [
        F.regexp_replace(F.lower(token), r"\p{P}", "").alias("no_punct"),
        F.left(token, F.lit(4)).alias("prefix"),
        F.right(token, F.lit(4)).alias("suffix"),
    ]


def trigrams(token: Column, start: str = "", end: str = "$") -> Column:
    """Runs of three characters of the token between two marks."""
    t = F.concat(F.lit(start), token, F.lit(end))
    n = F.length(t) - 2
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def in_reading_order():
    return Window.partitionBy("doc_id").orderBy("line_no", "pos")


def sequence_of(toks: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``seq`` (from 1) and ``total``; keep the first ``limit`` tokens of a document (a header cut)."""
    out = toks.withColumn("seq", F.row_number().over(in_reading_order()))
    if limit is not None:
        out = out.filter(F.col("seq") <= limit)
    return out.withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))


def with_sentinels(seqs: DataFrame) -> DataFrame:
    """Add a null token before and after each document's tokens."""
    ends = seqs.groupBy("doc_id").agg(F.max("seq").alias("n"))
    ends = ends.select("doc_id", F.explode(F.array(F.lit(0), F.col("n") + 1)).alias("seq"))
    return seqs.select("doc_id", "seq", "token").union(ends.select("doc_id", "seq", F.lit(None).cast("string")))


def location_bin(seq: Column, total: Column, bins: int = 12) -> Column:
    return F.floor(bins * (seq - 1) / total).cast("int")


def change_features(toks: DataFrame) -> DataFrame:
    """Changes of font, line and height towards the token before and after, and the log of the gap between lines."""
    w = in_reading_order()
    height = F.col("y1") - F.col("y0")
    out = toks.withColumn("height", height)
    for name, c in (("font", "font"), ("line", "line_no"), ("h", "height")):
        out = out.withColumn(f"{name}_cb", F.coalesce(F.lag(c).over(w) != F.col(c), F.lit(True))).withColumn(f"{name}_cf", F.coalesce(F.lead(c).over(w) != F.col(c), F.lit(True)))
    gap = lambda a, b: F.when(a > b, F.log1p(a - b)).otherwise(0.0)
    return out.withColumn("gap_b", F.coalesce(gap(F.col("y0"), F.lag("y1").over(w)), F.lit(0.0))).withColumn("gap_f", F.coalesce(gap(F.lead("y0").over(w), F.col("y1")), F.lit(0.0)))


def min_max(c: str, by: str = "doc_id") -> Column:
    """The column scaled to 0 .. 1 within each group; 0.5 where it is constant."""
    w = Window.partitionBy(by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, 0.5).otherwise((F.col(c) - low) / (high - low))


def smooth_frequency(n: Column) -> Column:
    """log10 of a count less 0.6 (if there is one) plus 0.1."""
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    return F.log10(F.when(n > 0, n - 0.6).otherwise(n) + 0.1)


def has_editor(token: Column) -> Column:
    return F.lower(F.replace(token, F.lit(","), F.lit(""))).isin(*EDITOR_WORDS)
