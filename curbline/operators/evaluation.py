"""Workloads that evaluate measures: AUC, thresholds at a matched alarm rate, score drops, rotations, resumed scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import skip_known
from .scratch import written


def long_form(df: DataFrame, measures: list[str], keep: list[str]) -> DataFrame:
    """One row for each measure of a row: (*keep, measure, score)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("score")) for m in measures])
    return df.select(*keep, F.explode(pairs).alias("__m")).select(*keep, "__m.measure", "__m.score")


def auc_table(df: DataFrame, measures: list[str], label: str) -> DataFrame:
    """(measure, positives, negatives, auc): rank-sum AUC with mid ranks for ties.

    Unscored and unlabelled rows do not count; without both labels the AUC is null.  Distinct scores are dealt by range, so
    that a measure's ranks are summed up over many tasks.
    """
    rows = long_form(df.filter(F.col(label).isNotNull()), measures, [label]).filter("score is not null")
    steps = rows.groupBy("measure", "score").agg(F.count("*").alias("n"), F.count_if(F.col(label).cast("int") == 1).alias("pos"))
    dealt = written(steps.repartitionByRange("measure", "score").withColumn("range", F.spark_partition_id()), "auc")
    sizes = dealt.groupBy("measure", "range").agg(F.sum("n").alias("size"))
    before = sizes.select("measure", "range", (F.sum("size").over(Window.partitionBy("measure").orderBy("range")) - F.col("size")).alias("before"))
    below = F.sum("n").over(Window.partitionBy("measure", "range").orderBy("score")) - F.col("n")
    # One row for each measure and range: no more than measures times tasks.
    ranked = dealt.withColumn("below", below).join(F.broadcast(before), ["measure", "range"])
    rank = F.col("before") + F.col("below") + (F.col("n") + 1) / F.lit(2.0)
    out = ranked.groupBy("measure").agg(F.sum(rank * F.col("pos")).alias("ranks"), F.sum("pos").alias("positives"), (F.sum("n") - F.sum("pos")).alias("negatives"))
    p, n = F.col("positives"), F.col("negatives")
    return out.select("measure", "positives", "negatives", F.when((p > 0) & (n > 0), (F.col("ranks") - p * (p + 1) / F.lit(2.0)) / (p * n)).alias("auc"))


def detection_table(df: DataFrame, variant: str, baseline: str, rule: Column, measures: list[str]) -> DataFrame:
    """Per variant: pictures, the rule's flag rate, and each measure's at the threshold that flags as many baseline rows as the rule.

    Higher scores count as worse.  Thresholds are exact percentiles: their state holds the baseline's distinct scores, so
    round measures that have more of them than fit in memory.
    """
    flagged = df.withColumn("__flag", F.coalesce(rule, F.lit(False)).cast("double"))
    base = flagged.filter(F.col(variant) == baseline)
    rate = base.agg(F.avg("__flag")).first()[0]
    if rate is None:
        raise ValueError(f"no rows of the variant {baseline!r}")
    limits = base.agg(*[F.percentile(m, F.lit(1.0 - rate)).alias(m) for m in measures]).first()
    over = [F.avg((F.col(m) > F.lit(limits[m])).cast("double")).alias(m) for m in measures]
    return flagged.groupBy(variant).agg(F.count("*").alias("pictures"), F.avg("__flag").alias("rule"), *over)


def score_drops(df: DataFrame, base: str, variants: list[str], min_drop: float = 0.10) -> DataFrame:
    """Per variant: pairs, median, 90th percentile and maximum of base - variant, and how many reach ``min_drop``."""
    drops = long_form(df, variants, [base]).withColumn("drop", F.col(base) - F.col("score")).filter("drop is not null")
    half, tenth = F.percentile("drop", F.lit(0.5)), F.percentile("drop", F.lit(0.9))
    return drops.groupBy(F.col("measure").alias("variant")).agg(F.count("*").alias("pictures"), half.alias("median"), tenth.alias("p90"), F.max("drop").alias("most"), F.count_if(F.col("drop") >= min_drop).alias("reach"))


def rotation_table(df: DataFrame, truth: str, predicted: str, confidence: str, sure: float = 0.9) -> DataFrame:
    """Per true rotation: pictures, how many are recognised, and how many are wrong with a confidence of ``sure`` or more."""
    right = F.coalesce(F.col(predicted) == F.col(truth), F.lit(False))
    return df.groupBy(F.col(truth).alias("rotation")).agg(F.count("*").alias("pictures"), F.count_if(right).alias("recognised"), F.count_if(~right & (F.col(confidence) >= sure)).alias("sure_but_wrong"))


def unscored(pictures: DataFrame, scored: DataFrame | None, key: str = "id") -> DataFrame:
    """What a resumed scoring run still has to do: pictures whose id is not in the output yet."""
    return pictures if scored is None else skip_known(pictures, scored, key)


def area_samples(items: DataFrame, areas: DataFrame, lon_lat: str = "lon_lat") -> DataFrame:
    """Items with the ``area`` that holds them, once for each such area, bounds included.

    ``areas`` (area, lon_min, lat_min, lon_max, lat_max) is small by nature; over 10000 of them are an error.
    """
    if areas.limit(10_001).count() > 10_000:
        raise ValueError("at most 10000 areas are joined by broadcast")
    lon, lat = F.get(lon_lat, F.lit(0)), F.get(lon_lat, F.lit(1))
    return items.join(F.broadcast(areas), lon.between(F.col("lon_min"), F.col("lon_max")) & lat.between(F.col("lat_min"), F.col("lat_max"))).drop("lon_min", "lat_min", "lon_max", "lat_max")
