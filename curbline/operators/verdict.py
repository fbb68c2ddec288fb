"""Kept or excluded, with exactly one reason: the ordered rules, alone or in a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import with_columns_of
from .context import confirmed_wavy, near_median, neighbourhood
from .rules import LOW_QUALITY, SEQUENCE_OUTLIER, Rules, hard_reason

NEEDED = (
    "collection", "rank", "is_pano", "gps_accuracy", "pixel_density", "privacy_blur", "orientation", "orientation_confidence",
    "orientation_views", "blurred_area", "cpbd", "waviness_label", "ad_rejected", "quality_score", "issues",
)
STALE = ("excluded", "rules_excluded", "reviewer_label", "sequence", "low_quality", "context")


def judge(pictures: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Add ``context``, ``issues``, ``excluded`` and ``low_quality``; earlier verdict columns are replaced.

    All rows act as neighbours, excluded and unscored ones too.  Issues of other origin stay in front of the rules' own.
    """
    rules = rules or Rules()
    df = with_columns_of(pictures.drop(*[c for c in STALE if c in pictures.columns]), NEEDED)
    df = neighbourhood(df, rules.window, ("quality_score", "blurred_area", "waviness_label"))
    n = F.size("__near")
    df = df.withColumns({"__n": n, "__hard": hard_reason(rules)})
    in_context = F.col("__n") >= rules.min_neighbours
    df = df.withColumn("__reason", F.coalesce("__hard", F.when(in_context & confirmed_wavy(rules.min_wavy_neighbours), "wavy")))
    open_ = F.col("__reason").isNull()
    df = df.withColumns({"__median": F.when(open_ & in_context, near_median("quality_score")), "__area": F.when(open_ & in_context, near_median("blurred_area"))})
    score = F.col("quality_score")
    outlier = F.coalesce(F.col("__median") - score >= rules.max_below_neighbours, F.lit(False))
    floor = F.when(F.coalesce("is_pano", F.lit(False)) | in_context, rules.floor_in_context).otherwise(rules.floor_alone)
    low = F.coalesce(score < floor, F.lit(False))
    earlier = F.filter(F.coalesce("issues", F.array().cast("array<string>")), lambda x: ~x.isin(LOW_QUALITY, SEQUENCE_OUTLIER))
    flagged = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    issues = F.when(open_, F.concat(earlier, flagged(outlier, SEQUENCE_OUTLIER), flagged(low, LOW_QUALITY))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("issues", issues)
    excluded = F.coalesce("__reason", F.get("issues", F.lit(0)))
    context = F.when(in_context, F.struct(F.col("__n").alias("neighbours"), F.col("__median").alias("topiq_median"), F.col("__area").alias("blurred_median")))
    df = df.withColumns({"excluded": excluded, "context": context})
    kept = [c for c in df.columns if not c.startswith("__")]
    return df.select(*kept, F.coalesce(F.col("excluded") != "", F.lit(False)).alias("low_quality"))


def judge_again(pictures: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Judge anew, but rows with ``context_fetched`` keep their stored verdict; they still act as neighbours."""
    stored = {"excluded": "string", "issues": "array<string>", "low_quality": "boolean"}
    df = pictures.withColumns({c: F.lit(None).cast(t) for c, t in stored.items() if c not in pictures.columns})
    legacy = F.coalesce("excluded", "rules_excluded") if "rules_excluded" in df.columns else F.col("excluded")
    df = df.withColumn("__stored", F.struct(legacy.alias("excluded"), "issues", "low_quality"))
    held = F.coalesce("context_fetched", F.lit(False)) if "context_fetched" in df.columns else F.lit(False)
    keep = df.withColumn("stored_verdict", F.col("__stored")).drop("__stored")
    new = judge(keep, rules)
    old = F.col("stored_verdict")
    return new.withColumns({c: F.when(held, old[c]).otherwise(F.col(c)) for c in ("excluded", "issues", "low_quality")}).drop("stored_verdict")


def judge_uploads(in_order: DataFrame, position: str, rules: Rules | None = None, upload: str | None = None) -> DataFrame:
    """Ad-hoc sequences: rows in upload order become ranks 1, 2, ... of one collection, or of that which ``upload`` names; only measurements are read."""
    fields = [c for c in (*NEEDED[2:-1], "id", "camera") if c in in_order.columns]
    rows = in_order.select(*[F.col(c).cast("string").alias(c) if c == "id" else F.col(c) for c in fields], (F.col(upload).cast("string") if upload else F.lit("upload")).alias("collection"), (F.col(position) + 1).cast("int").alias("rank"))
    return judge(rows, rules)
