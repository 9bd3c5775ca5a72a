"""End to end: documents as text to metadata, references and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bibliography as B
from ..operators import layout as L


def extract(docs: DataFrame, id_col: str = "id", text_col: str = "text", least_context: int = 35) -> DataFrame:
    """``id, title, emails, year, abstract, references, mentions`` of each document.

    Lines after the last reference heading are its bibliography, parsed by the style that yields most records; the text
    before it is searched for citations, which are kept if they resolve to a record and their sentence says enough.
    The text of a document never leaves its row; records and mentions meet it again in one join each.
    """
    lines = F.split(text_col, "\n")
    word = lambda l: F.lower(F.regexp_replace(F.trim(l), r"[\p{P}0-9 ]+", ""))
    at = F.array_max(F.transform(lines, lambda l, i: F.when(word(l).isin(*L.REFERENCE_HEADINGS), i)))
    parts = docs.select(F.col(id_col).alias("id"), lines.alias("lines"), at.alias("at"))
    parts = parts.withColumn("body", F.when(F.col("at").isNull(), F.col("lines")).otherwise(F.slice("lines", F.lit(1), F.coalesce("at", F.lit(0)))))
    section = F.concat(F.lit("<bb>"), F.array_join(F.slice("lines", F.col("at") + 2, F.size("lines")), "<lb>"))
    sections = parts.filter("at is not null").select(F.col("id").alias("section"), section.alias("body"))
    records = B.with_authors(B.select_style(sections)).withColumn("number", F.coalesce(F.col("key").try_cast("int"), F.col("n") + 1))

    flat = parts.select("id", F.array_join("body", " ").alias("body"))
    marks = B.with_offsets(B.markers(flat, "id", "body"))
    marks = B.long_contexts(marks, least_context)
    numbered = records.select(F.col("section").alias("id"), F.col("number").alias("n"))
    mentions = B.resolve(marks, numbered, "id")
    mention = F.struct(F.col("sentence"), F.col("start").alias("startOffset"), F.col("n").alias("referenceID"), F.col("stop").alias("endOffset"), "context")
    grouped = mentions.groupBy("id").agg(F.array_sort(F.collect_list(mention)).alias("mentions"))
    record = F.struct(F.col("number"), "title", F.col("author_list").alias("author"), "venue", "year")
    refs = records.groupBy(F.col("section").alias("id")).agg(F.array_sort(F.collect_list(record)).alias("references"))

    first = F.get("lines", F.lit(0))
    abstract = F.get(F.filter("lines", lambda l: l.rlike(r"(?i)^abstract ?\p{P}?")), F.lit(0))
    toks = F.flatten(F.transform("body", lambda l: F.split(l, " ")))
    head = parts.select(
        "id", T.clean_title(first).alias("title"), F.flatten(F.transform(F.filter(toks, lambda t: t.contains("@")), T.emails)).alias("emails"),
        T.ref_year(F.array_join(F.slice("body", 1, 10), " ")).alias("year"), L.clean_abstract(F.regexp_replace(abstract, r"(?i)^abstract ?\p{P}? ?", "")).alias("abstract"),
    )
    return head.join(refs, "id", "left").join(grouped, "id", "left")


def precedence(crf_title: Column, pdf_title: Column) -> tuple[Column, Column]:
    """Title and its source: a title of the file's own data wins unless it is a bad one."""
    good = ~L.bad_title(pdf_title)
    return F.when(good, pdf_title).otherwise(crf_title), F.when(good, "META").when(crf_title.isNotNull(), "CRF").otherwise("INVALID")


def to_labeled(metadata: DataFrame) -> DataFrame:
    """Metadata in the form of gold data: year 0 as null, authors as structs; e-mails, creator and source go."""
    author = F.transform("authors", lambda a: F.struct(a.alias("name"), F.lit(None).cast("string").alias("email"), F.array().cast("array<string>").alias("affiliations")))
    return metadata.select("id", "title", author.alias("authors"), F.lit(None).cast("string").alias("venue"), F.nullif("year", F.lit(0)).alias("year"), F.col("abstractText").alias("abstract"))
