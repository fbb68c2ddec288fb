"""What a picture's neighbours in its sequence say.

One RANGE window over (collection, rank) gathers the neighbours of every row; the row itself is taken out by its own
identity, so that another picture of equal rank stays a neighbour and gaps in the ranks count as distance.
Rows without a collection or rank never enter the window.  A sequence of any length is cut in ``slab`` ranks and
the rows within ``window`` of a slab's edge are handed to the next slab as well, so that the largest task is
bounded by a slab and not by the longest sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLAB = 4096


def median_of(values: Column) -> Column:
    """Exact median of an array of doubles without nulls; null for an empty one."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        half = F.floor(n / 2).cast("int")
        return F.when(n > 0, F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / F.lit(2.0)))

    return F.get(F.transform(F.array(F.array_sort(values)), middle), F.lit(0))  # sorted once


def neighbourhood(df: DataFrame, window: int, carry: tuple[str, ...], slab: int = SLAB) -> DataFrame:
    """Add ``__near``: array<struct> of the ``carry`` columns of all neighbours (empty for rows judged alone)."""
    placed = F.col("collection").isNotNull() & (F.col("collection").cast("string") != "") & F.col("rank").isNotNull()
    df = df.withColumn("__uid", F.monotonically_increasing_id())
    own = F.floor(F.col("rank") / slab).cast("long")
    # Rows near a slab's edge are repeated there as guests.
    slabs = F.sequence(F.floor((F.col("rank") - window) / slab), F.floor((F.col("rank") + window) / slab))
    dealt = df.filter(placed).withColumn("__slab", F.explode(slabs)).withColumn("__guest", F.col("__slab") != own)
    w = Window.partitionBy("collection", "__slab").orderBy("rank").rangeBetween(-window, window)
    everyone = F.collect_list(F.struct(F.col("__uid").alias("uid"), *carry)).over(w)
    near = dealt.withColumn("__all", everyone).filter(~F.col("__guest"))
    near = near.withColumn("__near", F.filter("__all", lambda x: x["uid"] != F.col("__uid"))).drop("__all", "__slab", "__guest")
    kind = near.schema["__near"].dataType.simpleString()
    alone = df.filter(~F.coalesce(placed, F.lit(False))).withColumn("__near", F.array().cast(kind))
    return near.unionByName(alone).drop("__uid")


def near_median(name: str) -> Column:
    """Median of a neighbour column over the neighbours that have it."""
    return median_of(F.filter(F.transform("__near", lambda x: x[name]), lambda v: v.isNotNull()))


def confirmed_wavy(min_share: float) -> Column:
    """A wavy picture of which at least two neighbours are measured and ``min_share`` of these are wavy."""
    if min_share > 1:
        return F.lit(False)
    measured = F.size(F.filter("__near", lambda x: x["waviness_label"].isNotNull()))
    wavy = F.size(F.filter("__near", lambda x: x["waviness_label"] == "wavy"))
    return F.coalesce((F.col("waviness_label") == "wavy") & (measured >= 2) & (wavy / measured >= min_share), F.lit(False))
