"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows,
empty tables and extra columns of any name; what it makes of them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from plumbline.llm.support import clear, new_folder, read, unused

#: Not in SQL: near-duplicate components, token ids and bin packing; tests hold the stages against brute force.
ORACLE_SQL = None

#: Words that a document must have, before and after it loses lines.
LEAST = 10
_SPACE = r"\x20\x09-\x0D"


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they now are."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that are too frequent at their host.

    Null and empty texts go, as they have no words; repeated rows share one fate.
    """
    return _sized(quality_rules.clean(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; lines of 8 words or more also up to one word.

    What is left of a document is judged again: one that has under ``LEAST`` words now,
    as a copy that lost all its lines, goes.  Null and empty texts so go as well.
    """
    left = line_dedup.dedup(docs, exact_words=1)
    words = F.regexp_count("text", F.lit(rf"[^{_SPACE}]++"))  # possessive: a word of any length is read once
    return _sized(left.where(F.coalesce(words >= LEAST, F.lit(False))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that shingle links join.

    Rows that share an id are told apart by their texts, so unlike texts under one id
    both stay; repeated rows become one.  Texts without words are linked with nothing.
    Rows with a null id stay as they are.
    """
    key, comp = unused(docs, "_key"), unused(docs, "_comp")
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    groups = ngram_join.join(named, doc=key).select(F.col("doc_id").alias("k"), F.col("component_id").alias(comp))
    first = groups.join(named.select(F.col(key).alias("k"), "doc_id"), "k").groupBy(comp).agg(F.min(F.struct("doc_id", "k")).alias("f")).select(F.col("f.k").alias(key))
    one = named.join(first, key, "left_semi").dropDuplicates([key]).drop(key)
    return one.unionByName(docs.where(F.col("doc_id").isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled under weights raked to source, language and topic targets.

    Null categories are categories; texts without words are not sampled; repeated rows
    share one fate.
    """
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of at most 2048 tokens.

    Null text is empty text: one end id.  Every row is packed, repeated ones too.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixture),
    ("best_fit_packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear(spark)  # what the stage has written on its way; its result stands
    return docs
