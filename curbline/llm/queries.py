"""The contract queries of the ten operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, language_id, line_dedup, ngram_join, secrets, substring_dedup, toxicity, warc
from .common import id_remainder, stage, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), index).select("doc_id", "held_out", "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start", "end")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stage(warc.write_archives(table(spark, sf_dir, "pages")), "warc")
    records = warc.read_archives(archives)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)>$", 1).try_cast("long")
    return records.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "digest_ok", "error")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=51)
    passages = F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"), passages.alias("passages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(line(base), 256).alias("base_sha256"), line("secrets").alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)))
    profiles = language_id.fit_profiles(docs.filter("not held_out"))
    return language_id.identify(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_bpe": op6_bpe,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secrets": op9_secrets,
    "op10_language_id": op10_language_id,
}
