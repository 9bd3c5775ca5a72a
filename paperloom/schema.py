"""Schemas of the document model."""

from __future__ import annotations

from pyspark.sql import types as T

FONT = T.StructType([T.StructField("name", T.StringType()), T.StructField("pt_size", T.FloatType()), T.StructField("space_width", T.FloatType())])
TOKEN = T.StructType([T.StructField("token", T.StringType()), T.StructField("font", FONT), *[T.StructField(c, T.FloatType()) for c in ("x0", "y0", "x1", "y1")]])
SECTION = T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())])
BIB_RECORD = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("author", T.ArrayType(T.StringType())), T.StructField("venue", T.StringType()),
    T.StructField("citeRegEx", T.StringType()), T.StructField("shortCiteRegEx", T.StringType()), T.StructField("year", T.IntegerType()),
])
CITATION = T.StructType([T.StructField("referenceID", T.IntegerType()), T.StructField("context", T.StringType()), T.StructField("startOffset", T.IntegerType()), T.StructField("endOffset", T.IntegerType())])
METADATA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("emails", T.ArrayType(T.StringType())), T.StructField("sections", T.ArrayType(SECTION)), T.StructField("references", T.ArrayType(BIB_RECORD)),
    T.StructField("referenceMentions", T.ArrayType(CITATION)), T.StructField("year", T.IntegerType()), T.StructField("abstractText", T.StringType()), T.StructField("creator", T.StringType()),
])
PAPER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("year", T.IntegerType()), T.StructField("venue", T.StringType()),
])
AUTHOR = T.StructType([T.StructField("name", T.StringType()), T.StructField("email", T.StringType()), T.StructField("affiliations", T.ArrayType(T.StringType()))])
REFERENCE = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())), T.StructField("venue", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("volume", T.StringType()), T.StructField("pageRange", T.StructType([T.StructField("first", T.StringType()), T.StructField("last", T.StringType())])),
])
MENTION = T.StructType([T.StructField("reference", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("inContext", T.StringType())])
LABELED = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("authors", T.ArrayType(AUTHOR)), T.StructField("venue", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("abstract", T.StringType()), T.StructField("sections", T.ArrayType(SECTION)),
    T.StructField("references", T.ArrayType(REFERENCE)), T.StructField("mentions", T.ArrayType(MENTION)),
])
FEEDBACK = T.StructType([T.StructField("paperId", T.StringType()), T.StructField("timeAdded", T.TimestampType()), T.StructField("value", T.StringType())])
