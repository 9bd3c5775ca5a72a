"""Readers: directories of files, JSON lines, gold tables, gazetteers, TEI and article XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.names import invert_around_comma
from ..functions.text import title_or_empty


def files(spark: SparkSession, *paths: str, suffix: str = ".pdf") -> DataFrame:
    """``id, path, content`` of all files below the paths whose name ends in ``suffix``; the id is the bare name.

    ``content`` is read only where a query uses it, so keep anti joins on ``id`` below whatever needs it.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(list(paths))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return rows.select(F.left(name, F.length(name) - len(suffix)).alias("id"), "path", "content")


def file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``entry``: the lines of list files, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("entry")).filter((F.col("entry") != "") & ~F.col("entry").startswith("#"))


def expand_inputs(spark: SparkSession, inputs: DataFrame, depth: int = 16, most_lists: int = 10_000) -> DataFrame:
    """``entry, kind, depth``: the column ``entry`` of ``inputs`` with list files (``.txt``) replaced by their lines, those of lists in lists too.

    A fixed point: a round reads the lists that no round has read, so a list that names itself or one above it ends there;
    each entry comes once, at its least depth. ``kind`` is *file* (``.pdf``), *id* (40 hexadecimal digits), *folder* (a slash at
    the end) or *unknown*, for the caller to skip. Only names of lists reach the driver: over ``most_lists`` in a round, or lists nested
    deeper than ``depth``, raise an error, as does a list that isn't there. Null and blank entries and comments are dropped.
    """
    fresh = inputs.select(F.trim("entry").alias("entry")).filter((F.col("entry") != "") & ~F.col("entry").startswith("#")).distinct()
    found, read = fresh.withColumn("depth", F.lit(0)), set()
    for level in range(1, depth + 2):
        named = fresh.filter(F.col("entry").endswith(".txt")).limit(most_lists + 1).collect()
        if len(named) > most_lists:
            raise ValueError(f"over {most_lists} lists at depth {level - 1}")
        waiting = sorted({r.entry for r in named} - read)
        if not waiting:
            break
        if level > depth:
            raise ValueError(f"lists are nested deeper than {depth}")
        read.update(waiting)
        fresh = file_list(spark, waiting).distinct()
        found = found.union(fresh.withColumn("depth", F.lit(level)))
    kind = F.when(F.col("entry").endswith(".pdf"), "file").when(F.col("entry").rlike("^[0-9a-f]{40}$"), "id").when(F.col("entry").endswith("/"), "folder").otherwise("unknown")
    out = found.filter(~F.col("entry").endswith(".txt")).groupBy("entry").agg(F.min("depth").alias("depth"))
    return out.select("entry", kind.alias("kind"), "depth")


def object_key(identifier: Column) -> Column:
    """Key of an object store: the first four characters, a slash, the rest."""
    return F.concat(F.left(identifier, F.lit(4)), F.lit("/"), F.substr(identifier, F.lit(5)))


def papers(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth from JSON lines, authors in reading order; ``key`` is the id without its first four characters."""
    rows = spark.read.schema(schema.PAPER).json(path)
    return rows.withColumn("authors", F.transform("authors", invert_around_comma)).withColumn("key", F.substr("id", F.lit(5)))


def gold_table(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A ragged gold table: ``id`` (lower case) and the array ``value`` of all further cells."""
    cells = F.split("value", "\t")
    return spark.read.text(path).filter("trim(value) <> ''").select(F.lower(F.get(cells, F.lit(0))).alias("id"), F.slice(cells, 2, F.size(cells)).alias(value))


def bibliography_cells(cells: Column) -> Column:
    """Cells ``title|year|venue|a:b`` as an array of records."""

    def record(c: Column) -> Column:
        p = F.split(c, r"\|")
        return F.struct(F.get(p, F.lit(0)).alias("title"), F.get(p, F.lit(1)).try_cast("int").alias("year"), F.get(p, F.lit(2)).alias("venue"), F.split(F.get(p, F.lit(3)), ":").alias("authors"))

    return F.transform(cells, record)


def gazetteer_directory(spark: SparkSession, path: str) -> DataFrame:
    """``gazetteer, entry`` of a directory with a file a gazetteer."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1)
    return spark.read.text(path).select(name.alias("gazetteer"), F.col("value").alias("entry"))


def ngram_frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ngram string, freq int").option("sep", "\t").csv(path)


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``token, vector`` from a text file of a word and its components a line."""
    p = F.split("value", " ")
    return spark.read.text(path).select(F.get(p, F.lit(0)).alias("token"), F.transform(F.slice(p, 2, F.size(p)), lambda x: x.cast("double")).alias("vector"))


_TEI_BIBL = """STRUCT<analytic: STRUCT<title: STRING, author: ARRAY<STRUCT<persName: STRUCT<forename: STRING, surname: STRING>>>>,
    monogr: STRUCT<title: STRING, author: ARRAY<STRUCT<persName: STRUCT<forename: STRING, surname: STRING>>>, imprint: STRUCT<date: STRING>>>"""


def tei_headers(rows: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """``id, title, abstract, surnames`` of TEI documents (a row a document)."""
    x = lambda path: F.xpath(xml_col, F.lit(path))
    title = F.coalesce(F.get(x("//titleStmt/title/text()"), F.lit(0)), F.lit(""))
    return rows.select(
        F.col(id_col).alias("id"), title_or_empty(title).alias("title"), F.trim(F.array_join(x("//profileDesc/abstract//text()"), " ")).alias("abstract"),
        x("//sourceDesc//analytic/author/persName/surname/text()").alias("surnames"),
    )


def tei_references(rows: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """``id, n, title, authors, venue, year`` of each reference of TEI documents.

    Title and authors come from the analytic part, else from the monograph, whose title else is the venue.
    """
    listed = F.regexp_extract(xml_col, "(?s)<listBibl[^>]*>(.*)</listBibl>", 1)
    cells = F.regexp_extract_all(listed, F.lit("(?s)<biblStruct[^>]*>.*?</biblStruct>"), 0)
    each = rows.select(F.col(id_col).alias("id"), F.posexplode(cells).alias("n", "cell"))
    each = each.withColumn("b", F.from_xml("cell", _TEI_BIBL))
    article = F.col("b.analytic.title")
    people = F.when(F.size(F.coalesce("b.analytic.author", F.array())) > 0, F.col("b.analytic.author")).otherwise(F.coalesce("b.monogr.author", F.array()))
    names = F.transform(people, lambda a: F.concat_ws(" ", a["persName"]["forename"], a["persName"]["surname"]))
    year = F.regexp_extract(F.regexp_extract("cell", r"<date[^>]*?(?:when=\"([0-9]{4})|>[^<]*)", 0), "([0-9]{4})", 1).try_cast("int")
    return each.select("id", "n", title_or_empty(F.coalesce(article, F.col("b.monogr.title"), F.lit(""))).alias("title"), names.alias("authors"), F.when(article.isNotNull(), F.col("b.monogr.title")).alias("venue"), year.alias("year"))


def article_xml(rows: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """``id, title, year, venue, abstract, authors`` of journal articles; authors with their affiliations by reference.

    Of several dates the first counts; the abstract is its paragraphs, in sections or not.
    """
    x = lambda path: F.xpath(xml_col, F.lit(path))
    one = lambda path: F.get(x(path), F.lit(0))
    given, surname = x("//article-meta//contrib[@contrib-type='author']/name/given-names/text()"), x("//article-meta//contrib[@contrib-type='author']/name/surname/text()")
    names = F.zip_with(given, surname, lambda g, s: F.concat_ws(" ", g, s))
    return rows.select(
        F.col(id_col).alias("id"), one("//article-meta/title-group/article-title/text()").alias("title"), one("//article-meta/pub-date/year/text()").try_cast("int").alias("year"),
        one("//journal-meta//journal-title/text()").alias("venue"), F.trim(F.array_join(x("//article-meta/abstract//p/text()"), "\n")).alias("abstract"), names.alias("authors"),
    )


def affiliations(contributors: DataFrame, places: DataFrame) -> DataFrame:
    """``id, author, affiliations``: contributors ``id, author, ref`` joined with ``id, ref, affiliation``."""
    found = contributors.join(places, ["id", "ref"], "left")
    return found.groupBy("id", "author").agg(F.array_sort(F.collect_list("affiliation")).alias("affiliations"))
