"""Streaming ingest of picture records (an extra).

A row can be judged alone as it comes.  Its neighbours may still arrive up to ``window`` ranks later, so sequences are
judged in batch once they are complete: every micro-batch names the sequences it touched, and only those are judged anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rules, hard_reason
from ..operators.verdict import NEEDED, judge
from ..schema import with_columns_of


def read_records(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def hard_verdicts(records: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The exclusions that need no neighbours, on a stream: stateless, append only."""
    return with_columns_of(records, NEEDED).withColumn("excluded", hard_reason(rules or Rules()))


def judge_touched(stored: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], rules: Rules | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: sequences met in the batch are judged again over all their stored rows."""

    def run(batch: DataFrame, epoch: int) -> None:
        touched = batch.select("collection").dropna().distinct()
        write(judge(stored().join(touched, "collection", "left_semi"), rules), epoch)

    return run


def late_counts(events: DataFrame, time: str, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Windowed counts behind a watermark, for monitoring an ingest."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("n"))
