"""Sections of HTML pages: headings, their tree and the text below each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import REFERENCE_HEADINGS

#: What holds no text of a page, with its content.
UNREAD = (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script\s*>", r"(?is)<style[^>]*>.*?</style\s*>", r"(?is)<nav[^>]*>.*?</nav\s*>", r"(?is)<footer[^>]*>.*?</footer\s*>", r"(?is)<head[ >].*?</head\s*>")
#: Tags that stand within a word or a sentence; any other ends a word.
INLINE = r"(?i)</?(b|i|u|em|strong|a|span|sup|sub|code|small)(\s[^>]*)?>"
HEADING = r"(?i)<h([1-6])(\s[^>]*)?>"
#: A heading reaches to its end tag, to the next block if it was left open, or to the end.
HEADING_TEXT = r"(?is)^(.*?)(</h[1-6]\s*>|<(p|div|ul|ol|table|article|section)[\s>]|\z)"
#: Character references, decoded in this order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
LEVELS = range(1, 7)


def plain(html: Column) -> Column:
    """Text of a piece of HTML: no tags, character references decoded, runs of blanks as one."""
    c = F.regexp_replace(F.regexp_replace(html, INLINE, ""), "<[^>]*>", " ")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_reference_heading(heading: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(heading)), r"\p{P}+$", "").isin(*REFERENCE_HEADINGS)


def sections(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, n, level, heading, parent, last, text``: a row a section of each page.

    Section 0 is what stands before the first heading, with level 0 and no heading; it is there only if it has text.
    ``parent`` is the nearest section before with a lower level (0 if none), ``last`` the last section below this one (its
    own number if none). A page of sections numbered 0, 1, 2, ... is one shuffle. Sections under a reference heading are left out,
    but keep their number. A null page has no sections; pages that share a key are not told apart.
    """
    clean = F.translate(html, "\x01", " ")
    for pattern in UNREAD:
        clean = F.regexp_replace(clean, pattern, " ")
    pieces = F.split(F.concat(F.lit("0"), F.regexp_replace(clean, HEADING, "\x01$1")), "\x01")
    rows = pages.filter(F.col(html).isNotNull()).select(key, F.posexplode(pieces).alias("n", "piece"))
    rows = rows.withColumn("level", F.left("piece", F.lit(1)).cast("int")).withColumn("rest", F.substr("piece", F.lit(2)))
    rows = rows.withColumn("head", F.when(F.col("level") > 0, F.regexp_extract("rest", HEADING_TEXT, 1)))
    rows = rows.select(key, "n", "level", plain(F.col("head")).alias("heading"), plain(F.substr("rest", F.coalesce(F.length("head"), F.lit(0)) + 1)).alias("text"))
    w = Window.partitionBy(key).orderBy("n")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    above = F.coalesce(*[F.when(F.col("level") == x, F.max(F.when(F.col("level") < x, F.col("n"))).over(before)) for x in LEVELS], F.lit(0))
    end = F.coalesce(*[F.when(F.col("level") == x, F.min(F.when(F.col("level") <= x, F.col("n"))).over(after)) for x in LEVELS], F.max("n").over(Window.partitionBy(key)) + 1)
    out = rows.withColumn("parent", F.when(F.col("level") > 0, above)).withColumn("last", F.when(F.col("level") > 0, end - 1).otherwise(F.lit(0)))
    out = out.filter((F.col("level") > 0) | (F.col("text") != "")).filter(F.col("heading").isNull() | ~is_reference_heading(F.col("heading")))
    return out.select(key, "n", "level", "heading", "parent", "last", "text")
