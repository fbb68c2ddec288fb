"""A policy of categories and prompts, prompt vectors kept between runs, and result records of the two picture checks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORY = "array<struct<id:string,label:string,prompts:array<string>>>"
SCHEMA = f"version string, scope string, ambiguous_action string, reference {CATEGORY}, advertising {CATEGORY}"
VECTORS = "policy string, revision string, at int, kind string, category string, prompt string, vector array<float>"
#: A policy is written by hand; more prompts than this are taken for a mistake.
MOST_PROMPTS = 10_000


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """(version, policy, at, kind, category, label, prompt): lower-cased prompts in file order, references first; ``policy`` is the file's SHA-256."""
    raw = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("policy"), F.from_json(F.decode("content", "utf-8"), SCHEMA).alias("p"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p.{k}").alias("categories")) for k in ("reference", "advertising")])
    prompts = F.flatten(F.transform(kinds, lambda k: F.flatten(F.transform(k["categories"], lambda c: F.transform(c["prompts"], lambda t: F.struct(k["kind"].alias("kind"), c["id"].alias("category"), c["label"].alias("label"), F.lower(t).alias("prompt")))))))
    return raw.select(F.col("p.version").alias("version"), "policy", F.posexplode(prompts).alias("at", "x")).select("version", "policy", "at", "x.*")


def prompt_vectors(policy: DataFrame, cache: str, revision: str, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """Unit vectors of the policy's prompts, read from ``cache`` if it holds this policy and model revision, else made and added.

    A policy has few prompts (MOST_PROMPTS, checked), so they are embedded at once.  Vectors have to be finite, one to a prompt.
    """
    spark = policy.sparkSession
    rows = policy.orderBy("at").limit(MOST_PROMPTS + 1).collect()
    if not rows or len(rows) > MOST_PROMPTS:
        raise ValueError(f"a policy has 1 to {MOST_PROMPTS} prompts")
    key = rows[0]["policy"]
    part = f"{cache.rstrip('/')}/{key}-{revision}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        made = np.asarray(embed([r["prompt"] for r in rows]), np.float64)
        if made.ndim != 2 or len(made) != len(rows) or not np.isfinite(made).all():
            raise ValueError("prompt vectors must be finite, one row for each prompt")
        made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-8)
        data = [(key, revision, r["at"], r["kind"], r["category"], r["prompt"], v.tolist()) for r, v in zip(rows, made)]
        spark.createDataFrame(data, VECTORS).coalesce(1).write.mode("overwrite").parquet(part)
    return spark.read.schema(VECTORS).parquet(part)


def advert_records(scored: DataFrame, evidence: str = "evidence", error: str = "error", unavailable: str = "unavailable", threshold: float = 90.0) -> DataFrame:
    """(id, status, decision, accepted, ad_rejected, checked, ad_score, reason): complete, partial, unavailable and error are kept apart.

    A check that cannot run accepts; an unreadable picture is an error and neither accepted nor rejected.
    """
    from .text import advert_decision

    broken, off = F.col(error).isNotNull(), F.col(unavailable).isNotNull()
    verdict = advert_decision(F.col(evidence), threshold)
    status = F.when(broken, "error").when(off | F.col(evidence).isNull(), "unavailable").when(F.col(f"{evidence}.complete"), "complete").otherwise("partial")
    out = scored.select("id", status.alias("status"), verdict.alias("v"), F.col(f"{evidence}.score").alias("score"), error, unavailable)
    checked = F.col("status").isin("complete", "partial")
    decision = F.when(F.col("status") == "error", "error").when(checked, F.col("v.decision")).otherwise("accept")
    reason = F.when(F.col("status") == "error", "processing_error").when(checked, F.col("v.reason")).otherwise("check_unavailable")
    return out.select(
        "id", "status", decision.alias("decision"), (decision == "accept").alias("accepted"), (decision == "reject").alias("ad_rejected"), checked.alias("checked"),
        F.when(checked, F.col("score")).alias("ad_score"), reason.alias("reason"), F.coalesce(F.col(error), F.col(unavailable)).alias("diagnostic"),
    )


def write_records(records: DataFrame, path: str) -> int:
    """One JSON object a picture below ``path``; returns 2 if any check failed or could not run, else 0."""
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return 0 if records.filter(F.col("status").isin("error", "unavailable")).isEmpty() else 2
