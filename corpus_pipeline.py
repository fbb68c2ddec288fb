"""From raw documents to token ids: five stages, each one operator of :mod:`curbline.llm`.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of ``documents``.  Its result is written as Parquet and read again as the next one's ``docs``.  Rows with a null
doc_id pass the filters of later stages unless their own text is judged (toxicity); an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from curbline.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go; all others stay as they are."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).filter("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document without lines stays, with an empty text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, that with the smallest id stays.

    Rows of equal id go together, and only if all of them are copies of a smaller id.
    """
    classes = ngram_join.join_classes(docs, words=5, percent=80)
    copies = classes.groupBy("doc_id").agg(F.min(F.col("component_id") < F.col("doc_id")).alias("gone")).filter("gone").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an exact or edited copy of a benchmark item go, with all rows of their id."""
    hits = decontaminate.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, "doc_id", "left_anti").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), path).drop("text"), path)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_copies),
    ("bpe", encode_tokens),
]

#: Model scores, alignments and merges are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
