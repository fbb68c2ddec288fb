"""Stratified samples: a cap for each sequence and area, or one picture of each sequence.

Draws are ordered by a seeded hash of the id, so a sample repeats exactly and needs no global state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.lit(seed))


def capped(df: DataFrame, area: str, sequence: str, per_sequence: int, per_area: int | None = None, order: list[Column] | None = None, key: str = "id", seed: int = 0) -> DataFrame:
    """At most ``per_sequence`` rows of each sequence in an area, then ``per_area`` rows of each area, then distinct ids."""
    order = order or [draw_order(key, seed), F.col(key)]
    out = df.withColumn("__k", F.row_number().over(Window.partitionBy(area, sequence).orderBy(*order))).filter(F.col("__k") <= per_sequence)
    if per_area is not None:
        out = out.withColumn("__k", F.row_number().over(Window.partitionBy(area).orderBy(*order))).filter(F.col("__k") <= per_area)
    return out.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(area))).filter("__k = 1").drop("__k")


def one_per_sequence(df: DataFrame, sequence: str, known: DataFrame | None = None, n: int | None = None, order: list[Column] | None = None, key: str = "id", seed: int = 0) -> DataFrame:
    """One drawn row of each sequence that is not known yet, at most n of them."""
    order = order or [draw_order(key, seed), F.col(key)]
    rows = df.filter(F.col(sequence).isNotNull())
    rows = rows.join(known.select(sequence).distinct(), sequence, "left_anti") if known is not None else rows
    out = rows.withColumn("__k", F.row_number().over(Window.partitionBy(sequence).orderBy(*order))).filter("__k = 1").drop("__k")
    return out.orderBy(*order).limit(n) if n is not None else out


def collection_page(items: DataFrame, collection: str, limit: int | None = None, after_rank: int | None = None) -> DataFrame:
    """A collection's items by rank, from behind a rank on."""
    rows = items.filter(F.col("collection") == collection)
    rows = rows.filter(F.col("rank") > after_rank) if after_rank is not None else rows
    rows = rows.orderBy("rank", "id")
    return rows.limit(limit) if limit is not None else rows
