"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Language identification drops texts that it rejects; line deduplication deletes later copies of line runs (and
texts of which nothing is left); SimHash keeps one document of each near-duplicate group; mixing takes documents
to the sources' target weights, repeated ones as repeated rows; the last stage encodes and decodes each text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import byte_bpe, language_id, line_dedup, shingle_similarity, simhash_dedup
from paperloom.llm.common import shared_folder
from paperloom.llm.queries import mixed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_row(docs: DataFrame) -> DataFrame:
    """Add ``row``, which tells rows apart that have no id or share one: smallest ids first, none last, then by text."""
    none = F.lit(0).cast(docs.schema["doc_id"].dataType)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", none).alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    return docs.withColumn("row", row)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; learned from those that are not held out. ``lang`` is filled in where it is null."""
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs, model, keep=["text", "lang", "source", "n_chars"])
    return found.filter(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those left without a word go."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS), min_words=5)
    kept = found.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Documents link at two or fewer differing bits of the SimHash, or if their sets of five-word shingles have a
    Jaccard similarity of 0.8 or more. Different texts that share an id, or have none, are documents of their own;
    a group keeps one without an id only if none of it has any.
    """
    docs = with_row(docs)
    groups = simhash_dedup.near_duplicates(docs, "row", size=3, k=2)
    found = shingle_similarity.merge(groups, shingle_similarity.links(docs, "row", size=5, least=0.8), "row")
    keep = found.filter(F.col("row") == F.col("component_id")).select("row").distinct()
    return docs.join(keep, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; different texts that share an id, or have none, are told apart."""
    docs = with_row(docs)
    taken = mixed(docs, spark, sf_dir, "row").filter("epochs > 0").select("row", "epochs")
    return docs.join(taken, "row").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))).select(*COLUMNS)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["source"])


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_decode),
]

#: No SQL: XXH64 fingerprints and byte-level BPE aren't to be had there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
    return docs
