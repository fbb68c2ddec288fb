"""A fixed projection of the driver's tables onto the picture model, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rules import Rules

#: The projection's orientation confidences are uniform, so the rule is run at 0.95.
RULES = Rules(min_orientation_confidence=0.95)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures made of events: sequences are users, ranks follow time."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        i.cast("string").alias("id"),
        i.alias("position"),
        F.col("user_id").cast("string").alias("collection"),
        rank.alias("rank"),
        F.col("event_type").alias("camera"),
        (i % 4 == 0).alias("is_pano"),
        F.when(i % 17 != 0, F.least(F.col("value"), F.lit(100.0)) / F.lit(100.0)).alias("quality_score"),
        ((i * 37 % 1000) / F.lit(2500.0)).alias("blurred_area"),
        F.when(i % 11 != 0, (i * 53 % 1000) / F.lit(1000.0)).alias("cpbd"),
        ((i * 7 % 560) / F.lit(10000.0)).alias("privacy_blur"),
        F.when(i % 3 != 0, (12 + i % 61).cast("double")).alias("pixel_density"),
        F.when(i % 7 != 0, (i % 40).cast("double")).alias("gps_accuracy"),
        F.when(i % 5 == 0, "wavy").when(i % 5 == 1, "review").when(i % 5 != 2, "no_strong_evidence").alias("waviness_label"),
        (i % 97 == 0).alias("ad_rejected"),
        ((i % 4) * 90).cast("int").alias("orientation"),
        ((i * 131 % 1000) / F.lit(999.0)).alias("orientation_confidence"),
        F.when(i % 23 != 0, F.concat(F.lit("https://instance"), (i % 3).cast("string"), F.lit(".example/api"))).alias("instance_api"),
        F.lit("scorer-1").alias("model"),
    )


def gappy(df: DataFrame) -> DataFrame:
    """Ranks with gaps and ties."""
    r = F.col("rank")
    return df.withColumn("rank", (r + F.floor(r / 7) - (r % 5 == 0).cast("int")).cast("int"))


PICTURES_SQL = """
pictures as (
  select cast(event_id as varchar) as id, event_id as position, cast(user_id as varchar) as collection,
    cast(row_number() over (partition by user_id order by ts, event_id) as integer) as rank,
    event_type as camera, event_id % 4 = 0 as is_pano,
    case when event_id % 17 <> 0 then least(value, 100.0::double) / 100.0::double end as quality_score,
    (event_id * 37 % 1000) / 2500.0::double as blurred_area,
    case when event_id % 11 <> 0 then (event_id * 53 % 1000) / 1000.0::double end as cpbd,
    (event_id * 7 % 560) / 10000.0::double as privacy_blur,
    case when event_id % 3 <> 0 then (12 + event_id % 61)::double end as pixel_density,
    case when event_id % 7 <> 0 then (event_id % 40)::double end as gps_accuracy,
    case when event_id % 5 = 0 then 'wavy' when event_id % 5 = 1 then 'review' when event_id % 5 <> 2 then 'no_strong_evidence' end as waviness_label,
    event_id % 97 = 0 as ad_rejected, cast(event_id % 4 * 90 as integer) as orientation,
    (event_id * 131 % 1000) / 999.0::double as orientation_confidence,
    case when event_id % 23 <> 0 then 'https://instance' || (event_id % 3) || '.example/api' end as instance_api,
    'scorer-1' as model
  from events)"""

GAPPY_SQL = "ranked as (select * replace (cast(rank + rank // 7 - (case when rank % 5 = 0 then 1 else 0 end) as integer) as rank) from pictures)"

METADATA_SQL = "case when gps_accuracy > {gps} then 'gps_inaccurate' when pixel_density < 15 then 'low_resolution' end"
NOT_SHARP_SQL = "(case when cpbd is null then blurred_area >= 0.33 else (blurred_area >= 0.33 and cpbd < 0.15) or (blurred_area >= 0.20 and cpbd < 0.12) end)"
HARD_SQL = f"""case when pixel_density < 15 then 'low_resolution' when ad_rejected then 'advertisement'
    when privacy_blur > 0.05 then 'privacy_blur' when orientation <> 0 and orientation_confidence >= 0.95 then 'wrong_orientation'
    when {NOT_SHARP_SQL} then 'not_sharp' end"""


def verdict_sql(source: str = "pictures", extra: str = "", window: int = 10) -> str:
    """CTEs up to ``judged``: context over the neighbours (the row itself excluded), then the ordered rules."""
    return f"""with {PICTURES_SQL}{extra},
near as (
  select *, count(*) over w as n, median(quality_score) over w as med, median(blurred_area) over w as area_med,
    count(waviness_label) over w as measured, count(*) filter (waviness_label = 'wavy') over w as wavy
  from {source} window w as (partition by collection order by rank range between {window} preceding and {window} following exclude current row)),
reasoned as (
  select *, coalesce({HARD_SQL}, case when n >= 2 and waviness_label = 'wavy' and measured >= 2 and wavy / measured::double >= 0.3 then 'wavy' end) as reason from near),
flagged as (
  select *, reason is null and n >= 2 and coalesce(med - quality_score >= 0.12, false) as outlier,
    reason is null and coalesce(quality_score < case when is_pano or n >= 2 then 0.32 else 0.40 end, false) as low from reasoned),
judged as (
  select *, coalesce(reason, case when outlier then 'sequence_outlier' when low then 'low_quality' end) as excluded,
    case when reason is not null then '' else concat_ws(',', case when outlier then 'sequence_outlier' end, case when low then 'low_quality' end) end as issues from flagged)
"""
