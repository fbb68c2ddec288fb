"""Vector operators: normalising, cosines, prompt categories and view aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8
POLICY_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(EPS))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def category_scores(pictures: DataFrame, prompts: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(key, kind, category, score): mean of the two largest cosines over each category's prompts.

    ``prompts`` (kind, category, prompt vector) is a policy table of a fixed size; it is gathered to one row, whose size is
    checked in prompts and bytes, and sent with the plan instead of a row for each (picture, prompt).
    """
    n, numbers = prompts.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if n > 4096 or 8 * numbers > POLICY_BYTES:
        raise ValueError(f"{n} prompts of {numbers} numbers are more than a policy has; at most 4096 and {POLICY_BYTES} bytes are broadcast")
    groups = prompts.groupBy("kind", "category").agg(F.collect_list(F.struct("vector", F.greatest(norm(F.col("vector")), F.lit(EPS)).alias("norm"))).alias("prompts"))
    own = pictures.select(key, F.col(vector).alias("own"), F.greatest(norm(F.col(vector)), F.lit(EPS)).alias("own_norm"))
    best = F.sort_array(F.transform("prompts", lambda p: dot(F.col("own"), p["vector"]) / (F.col("own_norm") * p["norm"])), asc=False)
    mean = F.transform(F.array(F.slice(best, 1, 2)), lambda t: F.aggregate(t, F.lit(0.0), lambda s, x: s + x) / F.size(t))
    return own.crossJoin(F.broadcast(groups)).select(key, "kind", "category", F.get(mean, F.lit(0)).alias("score"))


def best_categories(scores: DataFrame, key: str = "id", kinds: tuple[str, ...] = ("reference", "advertising")) -> DataFrame:
    """Best category of each kind; the lowest category wins a tie."""
    out = []
    for kind in kinds:
        best = F.max_by(F.struct("category", "score"), F.when(F.col("kind") == kind, F.struct(F.col("score").alias("s"), (-F.col("category")).alias("c"))))
        out.append(best.alias(kind))
    return scores.groupBy(key).agg(*out)


def ranking(scores: DataFrame, key: str = "id") -> DataFrame:
    """Array of categories by similarity (4 dp), in category order among equals."""
    entry = F.struct((-F.round("score", 4)).alias("neg"), "category", "kind", F.round("score", 4).alias("similarity"))
    return scores.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["category"].alias("category"), e["kind"].alias("kind"), e["similarity"].alias("similarity"))).alias("ranking"))


def view_scores(views: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Worst and mean of every metric over a picture's views, 4 dp."""
    return views.groupBy(key).agg(*[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("worst", lambda c: F.round(F.min(c), 4)), ("mean", lambda c: F.round(F.avg(c), 4)))])


def second_best_rotated(views: Column) -> Column:
    """Second most confident rotated view of a 360° picture; else no rotation, at the least confidence of its views."""
    rotated = F.sort_array(F.transform(F.filter(views, lambda v: v["rotation"] != 0), lambda v: F.struct(v["confidence"].alias("confidence"), v["rotation"].alias("rotation"))), asc=False)
    upright = F.struct(F.array_min(F.transform(views, lambda v: v["confidence"])).alias("confidence"), F.lit(0).alias("rotation"))
    return F.when(F.size(rotated) >= 2, F.get(rotated, F.lit(1))).otherwise(upright)


def mean_probability(views: Column) -> Column:
    """Rotation of a flat picture: argmax of the views' mean probabilities, and that probability (views: array of 4 doubles)."""
    mean = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.aggregate(views, F.lit(0.0), lambda s, v: s + F.get(v, k)) / F.size(views))
    best = F.array_max(mean)
    return F.struct((F.array_position(mean, best).cast("int") * 90 - 90).alias("rotation"), best.alias("confidence"))
