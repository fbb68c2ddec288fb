"""Plug-in models: what a scorer or embedder must offer, and the orientation classifier.

Weights are not part of the library.  A stage without its model adds no columns, and a missing check never excludes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vectors import mean_probability, second_best_rotated
from .pixels import Prepared


class Scorer(Protocol):
    def __call__(self, picture: Prepared) -> dict: ...


class Backbone(Protocol):
    def embed_views(self, views: list[np.ndarray]) -> np.ndarray: ...


_loaded: dict[str, object] = {}


def once(name: str, load: Callable[[], object]):
    """A worker loads a model once, whatever number of batches it sees."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def embed(views: DataFrame, load: Callable[[], Backbone], name: str = "backbone") -> DataFrame:
    """Add ``vector`` to rows (key columns, height, width, channels, data); views of one shape are embedded together."""
    from ..sources.files import pixels_of

    schema = views.drop("data", "height", "width", "channels").withColumn("vector", F.array().cast("array<float>")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(name, load)
        for frame in frames:
            vectors = [None] * len(frame)
            for _, part in frame.reset_index(drop=True).groupby(["height", "width"]):
                images = [pixels_of(r.height, r.width, r.channels, r.data) for r in part.itertuples()]
                for i, v in zip(part.index, np.asarray(model.embed_views(images), np.float32)):
                    vectors[i] = v
            yield frame.drop(columns=["data", "height", "width", "channels"]).assign(vector=vectors)

    return views.mapInPandas(run, schema)


def fit_orientation(rows: DataFrame, vector: str = "vector", rotation: str = "rotation", c: float = 1.0) -> PipelineModel:
    """Multinomial logistic regression on standardised vectors; ``rotation`` is 0, 90, 180 or 270."""
    n = max(1, rows.count())
    ready = rows.select(array_to_vector(F.col(vector)).alias("raw"), (F.col(rotation) / 90).cast("double").alias("label"))
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[scale, LogisticRegression(maxIter=500, regParam=1.0 / (c * n), standardization=False)]).fit(ready)


def predict_orientation(model: PipelineModel, views: DataFrame, key: str = "id", is_pano: str = "is_pano", vector: str = "vector", position: str = "view") -> DataFrame:
    """(key, orientation, orientation_confidence, orientation_views) from one row for each view."""
    scored = model.transform(views.withColumn("raw", array_to_vector(F.col(vector)))).withColumn("p", vector_to_array("probability"))
    best = F.array_max("p")
    view = F.struct(F.col(position).alias("at"), F.struct(((F.array_position("p", best) - 1) * 90).cast("int").alias("rotation"), F.round(best, 4).alias("confidence")).alias("v"), F.col("p"))
    rows = scored.groupBy(key, is_pano).agg(F.sort_array(F.collect_list(view)).alias("views"))  # a picture has at most four views
    flat = mean_probability(F.transform("views", lambda v: v["p"]))
    pano = second_best_rotated(F.transform("views", lambda v: v["v"]))
    pick = lambda f: F.when(F.col(is_pano), pano[f]).otherwise(flat[f])
    return rows.select(key, pick("rotation").alias("orientation"), F.round(pick("confidence"), 4).alias("orientation_confidence"), F.when(F.col(is_pano), F.transform("views", lambda v: v["v"])).alias("orientation_views"))


def auc(df: DataFrame, score: str, label: str) -> float | None:
    """Rank-sum AUC with mid ranks for ties; null without both labels."""
    steps = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    from pyspark.sql import Window

    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = steps.select("pos", "n", (below + (F.col("n") + 1) / 2).alias("rank")).agg(F.sum(F.col("rank") * F.col("pos")), F.sum("pos"), F.sum("n")).first()
    ranks, pos, n = r
    return None if not pos or pos == n else (ranks - pos * (pos + 1) / 2) / (pos * (n - pos))
