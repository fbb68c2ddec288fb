"""File sources and sinks: JSON lines, image files, trailers, duplicates and the review page."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, missing keys are null.  The schema is explicit."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Explicit nulls are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_duplicates(judged: DataFrame, path: str) -> None:
    """One row for each removed picture, with what it duplicates."""
    write_jsonl(judged.filter("not kept").select("id", "duplicate_of"), path, "append")


def list_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Image files below the given folders: (id, path, length), without reading their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.filter(is_image(F.col("path"))).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), "path", "length")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(jpg|jpeg|png|webp)$")


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(is_image(F.col("path"))).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), "path", "content")


def decoded(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, height, width, channels, data) through the JVM's decoder, pixels in BGR order; files that fail have a height of -1."""
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    return images.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data").withColumnRenamed("origin", "path")


def pixels_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB picture of a decoded row; transparency is composited on white."""
    a = np.frombuffer(bytes(data), np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    rgb = a[..., 2::-1]
    if channels == 4:
        alpha = a[..., 3:].astype(np.float32) / 255
        rgb = np.rint(rgb * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return np.ascontiguousarray(rgb)


def guard(height: int, width: int, max_pixels: int = 40_000_000, min_side: int = 96) -> str | None:
    """Why a picture is not examined, if so."""
    if height <= 0 or width <= 0:
        return "picture cannot be decoded"
    if height * width > max_pixels:
        return "picture too large"
    return "picture too small" if min(height, width) < min_side else None


MEASURED = (
    "path string, width int, height int, is_pano boolean, sharpness double, blurred_area double, cpbd double, "
    "waviness_label string, waviness_score double, dhash long, quality_score double, model string, error string"
)


def measure(images: DataFrame, scorer: Callable[[pixels.Prepared], dict] = pixels.brightness_score, with_waviness: bool = True) -> DataFrame:
    """Measurements of decoded pictures; a picture that fails gets an ``error`` and null measurements, which never exclude it.

    Pixels end here: no later shuffle carries them.  Keep spark.sql.execution.arrow.maxRecordsPerBatch small (16 to 64).
    """
    names = [x.split()[0] for x in MEASURED.split(", ")]
    has_boxes, has_size = "privacy_boxes" in images.columns, "original_size" in images.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions import waviness

        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                row = dict.fromkeys(names) | {"path": r.path, "width": r.width, "height": r.height}
                try:
                    if reason := guard(r.height, r.width):
                        raise ValueError(reason)
                    img = pixels_of(r.height, r.width, r.channels, r.data)
                    pano = pixels.is_equirectangular(r.width, r.height)
                    boxes = r.privacy_boxes if has_boxes and r.privacy_boxes is not None else ()
                    size = r.original_size if has_size and r.original_size is not None and len(r.original_size) else (None,)
                    row |= {"is_pano": pano, "dhash": pixels.dhash(img)} | pixels.sharpness(img, pano, boxes, size[0])
                    if with_waviness:
                        row |= {k: v for k, v in waviness.check(img).items() if k in row}
                    score = scorer(pixels.prepare(img, pano))
                    row |= {"quality_score": score.get("quality_score"), "model": score.get("model")}
                except Exception as e:  # one broken picture must not end the job; the row says what happened
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return images.mapInPandas(run, MEASURED)


def review_page(cards: DataFrame, title: str = "Review") -> str:
    """A static page with the cards as embedded JSON.  A page is read by people: the caller chooses what goes on it."""
    rows = [json.loads(r[0]) for r in cards.select(F.to_json(F.struct("*"))).toLocalIterator()]
    data = json.dumps(rows, ensure_ascii=False).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><div id="cards"></div><script>const pictures = {data};</script>'


def send_tags(payload: DataFrame, send: Callable[[str, str, list[dict]], None] | None = None) -> DataFrame | None:
    """Without ``send`` a dry run: the JSON that would be sent for each picture.  Otherwise every executor sends its own pictures'."""
    tags = payload.groupBy("id", "collection").agg(F.sort_array(F.collect_list(F.struct("at", "key", "value", "action"))).alias("tags"))
    tags = tags.select("id", "collection", F.transform("tags", lambda t: F.struct(t["key"].alias("key"), t["value"].alias("value"), t["action"].alias("action"))).alias("semantics"))
    if send is None:
        return tags.select("id", "collection", F.to_json(F.struct("semantics")).alias("body"))

    def each(rows) -> None:
        for r in rows:
            send(r["collection"], r["id"], [s.asDict() for s in r["semantics"]])

    tags.foreachPartition(each)
    return None
