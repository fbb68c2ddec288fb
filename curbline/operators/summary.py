"""Summaries, histograms, review orders and output projections over judged pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def sequence_summary(judged: DataFrame, position: str = "position") -> DataFrame:
    """Per collection: pictures, median score (4 dp), excluded, camera of the first row."""
    rows = judged.filter(F.col("collection").isNotNull() & (F.col("collection").cast("string") != ""))
    out = rows.groupBy("collection").agg(
        F.count("*").alias("pictures"),
        F.round(F.percentile("quality_score", F.lit(0.5)), 4).alias("median"),
        F.count_if(F.col("excluded").isNotNull()).alias("excluded"),
        F.min_by("camera", position).alias("camera"),
    )
    return out.orderBy(F.asc_nulls_last("median"), "collection")


def histogram(df: DataFrame, column: str, position: str = "position") -> DataFrame:
    """Counts of the non-null values, most frequent first, first seen first among equals."""
    out = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))
    return out.orderBy(F.desc("n"), "first_seen")


def totals(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("pictures"), F.count_if(F.col("excluded").isNull()).alias("kept"), F.count_if(F.col("excluded").isNotNull()).alias("excluded"), F.count_if(F.col("context").isNotNull()).alias("in_context"))


#: Review orders; ``position`` settles what they leave open.
def review_order(kind: str, position: str = "position") -> list[Column]:
    score = F.coalesce("quality_score", F.lit(0.0))
    return {
        "worst": [F.col("excluded").isNull(), score, F.col(position)],
        "best": [F.desc(score), F.col(position)],
        "sequence": [F.asc_nulls_first("collection"), F.coalesce("rank", F.lit(0)), F.col(position)],
    }[kind]


def review_filter(kind: str, value: str | None = None) -> Column:
    """all, kept, excluded, one exact reason, or one sequence."""
    return {"all": F.lit(True), "kept": F.col("excluded").isNull(), "excluded": F.col("excluded").isNotNull(), "reason": F.col("excluded") == value, "sequence": F.col("collection") == value}[kind]


def review_rows(judged: DataFrame, order: str = "worst", kind: str = "all", value: str | None = None, position: str = "position") -> DataFrame:
    """The review page's rows with their place in the order.

    Rows are dealt by ranges of the order, sorted and written; a row's place is its place in its range and the sizes of
    the ranges before it, so that no task holds all rows.
    """
    by = review_order(order, position)
    rows = judged.filter(review_filter(kind, value)).repartitionByRange(*by).sortWithinPartitions(*by)
    low = 2**33  # monotonically_increasing_id: the partition in the upper bits, the row in the lower 33
    uid = F.monotonically_increasing_id()
    dealt = written(rows.withColumns({"__range": F.floor(uid / low).cast("int"), "__row": uid.bitwiseAND(F.lit(low - 1))}), "review")
    return dealt.join(F.broadcast(_before(dealt.groupBy("__range").agg(F.count("*").alias("n")))), "__range").withColumn("place", F.col("__row") + F.col("before") + 1).drop("__range", "__row", "before")


def _before(sizes: DataFrame) -> DataFrame:
    """(__range, before): the sum of n over all earlier ranges; one row for each range, no more than there are tasks."""
    return sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("before"))


CARD = ("id", "collection", "rank", "camera", "is_pano", "datetime", "license", "quality_score", "sharpness", "blurred_area", "cpbd", "privacy_blur", "privacy_record", "orientation", "orientation_confidence", "waviness_label", "ad_rejected", "excluded", "issues", "context", "lon_lat")


def cards(judged: DataFrame, thumb: Column | None = None, full: Column | None = None, viewer: Column | None = None) -> DataFrame:
    """Contact-sheet projection: 21 columns, and the links that callers give as expressions."""
    have = [F.col(c) if c in judged.columns else F.lit(None).alias(c) for c in CARD]
    links = [(c if c is not None else F.lit(None).cast("string")).alias(n) for n, c in (("thumb", thumb), ("full", full), ("viewer", viewer))]
    return judged.select(*have, *links)


def tag_payload(judged: DataFrame, key: str = "street_view_quality", action: str = "add") -> DataFrame:
    """One row for each tag: two for every issue of a picture that has a collection and an instance."""
    eligible = F.col("collection").isNotNull() & F.col("instance_api").isNotNull() & (F.size("issues") > 0)
    tags = F.transform(
        "issues",
        lambda i: F.array(
            F.struct(F.lit(key).alias("key"), i.alias("value"), F.lit(action).alias("action")),
            F.struct(F.concat(F.lit(f"detection_model[{key}="), i, F.lit("]")).alias("key"), F.col("model").alias("value"), F.lit(action).alias("action")),
        ),
    )
    return judged.filter(eligible).select("id", "collection", F.posexplode(F.flatten(tags)).alias("at", "tag")).select("id", "collection", "at", "tag.*")


def report_comment(median: str = "context.topiq_median") -> Column:
    """Message of a report: the issues, the score, what the neighbours have, and the model; numbers rounded half up, unknown ones left out."""
    two = lambda c: F.col(c).cast("decimal(30,20)").cast("decimal(10,2)").cast("string")
    score = F.when(F.col("quality_score").isNotNull(), F.concat(F.lit("; score "), two("quality_score"))).otherwise("")
    near = F.when(F.col(median).isNotNull(), F.concat(F.lit(" vs sequence median "), two(median))).otherwise("")
    return F.concat(F.lit("Automated detection ("), F.array_join("issues", ", "), score, near, F.lit(") by "), F.col("model"))


def script_json(c: Column) -> Column:
    """JSON that may stand in a script element."""
    return F.replace(c, F.lit("</"), F.lit("<\\/"))


def consensus(df: DataFrame, metrics: list[str], key: str) -> DataFrame:
    """Mean over the metrics of each row's percentile rank: (rows with a smaller value) / (rows - 1), nulls smallest.

    Ranks come from the distinct values and their counts, summed up within ranges of values.
    """
    total = df.count()
    out = df
    for k, m in enumerate(metrics):
        counts = df.groupBy(F.col(m).alias("v")).agg(F.count("*").alias("n")).repartitionByRange(F.asc_nulls_first("v"))
        dealt = written(counts.withColumn("__range", F.spark_partition_id()), "ranks")
        within = F.sum("n").over(Window.partitionBy("__range").orderBy(F.asc_nulls_first("v"))) - F.col("n")
        rank = dealt.withColumn("within", within).join(F.broadcast(_before(dealt.groupBy("__range").agg(F.sum("n").alias("n")))), "__range")
        rank = rank.select(F.col("v").alias(f"__v{k}"), ((F.col("within") + F.col("before")) / F.lit(float(max(1, total - 1)))).alias(f"__r{k}"))
        out = out.join(rank, out[m].eqNullSafe(rank[f"__v{k}"]))
    ranks = [F.col(f"__r{k}") for k in range(len(metrics))]
    return out.select(key, (sum(ranks[1:], ranks[0]) / F.lit(float(len(metrics)))).alias("consensus"))
