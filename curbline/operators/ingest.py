"""From catalogue items to picture records, and the joins that build a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPTICS = "properties.`pers:interior_orientation`"


def is_pano(fov: Column) -> Column:
    """Null field of view stays unknown."""
    return fov >= 360


def _href(links: Column, rel: str) -> Column:
    return F.rtrim(F.get(F.filter(links, lambda x: x["rel"] == rel), F.lit(0))["href"], F.lit("/"))


def instance_api(links: Column) -> Column:
    """The first ``via`` link with /api, else the first ``root`` link."""
    return F.coalesce(F.concat(_href(links, "via"), F.lit("/api")), _href(links, "root"))


def asset_url(href: Column, api: Column) -> Column:
    """Hrefs relative to the instance's host become absolute."""
    host = F.regexp_replace(F.coalesce(api, F.lit("")), r"/api(?!.*/api).*$", "")
    return F.when(href.startswith("/"), F.concat(host, href)).otherwise(href)


def camera_label(maker: Column, model: Column) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(maker, F.lit("")), F.nullif(model, F.lit(""))), F.lit(""))


def flatten_items(items: DataFrame) -> DataFrame:
    """Picture records of nested catalogue items (see ``schema.ITEM``)."""
    p = F.col("properties")
    api = instance_api(F.col("links"))
    return items.select(
        "id", "collection",
        is_pano(F.col(f"{OPTICS}.field_of_view")).alias("is_pano"),
        camera_label(F.col(f"{OPTICS}.camera_manufacturer"), F.col(f"{OPTICS}.camera_model")).alias("camera"),
        F.col(f"{OPTICS}.sensor_array_dimensions").alias("original_size"),
        p["datetime"].alias("datetime"),
        F.col("properties.`geovisio:rank_in_collection`").alias("rank"),
        F.col("properties.`quality:horizontal_accuracy`").alias("gps_accuracy"),
        F.col("properties.`panoramax:horizontal_pixel_density`").alias("pixel_density"),
        p["license"].alias("license"),
        api.alias("instance_api"),
        asset_url(F.try_element_at("assets", F.lit("hd"))["href"], api).alias("hd_url"),
        asset_url(F.try_element_at("assets", F.lit("thumb"))["href"], api).alias("thumb_url"),
        F.col("geometry.coordinates").alias("lon_lat"),
    )


def in_bbox(bbox: tuple[float, float, float, float], lon_lat: str = "lon_lat") -> Column:
    """(lon_min, lat_min, lon_max, lat_max), bounds included."""
    if len(bbox) != 4:
        raise ValueError("a bounding box has four numbers: lon_min, lat_min, lon_max, lat_max")
    lon, lat = F.get(lon_lat, F.lit(0)), F.get(lon_lat, F.lit(1))
    return lon.between(float(bbox[0]), float(bbox[2])) & lat.between(float(bbox[1]), float(bbox[3]))


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    parts = tuple(float(x) for x in text.split(","))
    if len(parts) != 4:
        raise ValueError("a bounding box has four numbers: lon_min, lat_min, lon_max, lat_max")
    return parts  # type: ignore[return-value]


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def last_of(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The last row of every key: later inputs override earlier ones."""
    names = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*names), version).alias("__row")).select(*key, "__row.*")


def join_metadata(images: DataFrame, metadata: DataFrame, version: str | None = None) -> DataFrame:
    """Images (id from their stem) with their metadata; a picture without any keeps its id alone."""
    right = last_of(metadata, ["id"], version) if version else metadata
    return images.join(right, "id", "left")


def skip_known(items: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return items.join(known.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Field by field, what the new row has wins; keys of either side stay."""
    left, right = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    both = left.join(right, key, "full_outer")
    columns = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c != key]

    def pick(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        return F.col(f"n.{c}") if c not in old.columns else F.when(F.col("n.__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return both.select(key, *[pick(c).alias(c) for c in columns])


def union_jobs(*jobs: DataFrame) -> DataFrame:
    """All rows of all jobs; columns that a job lacks are null."""
    out = jobs[0]
    for job in jobs[1:]:
        out = out.unionByName(job, allowMissingColumns=True)
    return out


def join_uploads(uploads: DataFrame, predictions: DataFrame, fields: tuple[str, ...] = ("collection", "rank", "camera", "privacy_blur", "privacy_record")) -> DataFrame:
    """Uploads whose name is a known picture's take its metadata, privacy record and sequence where they have none."""
    right = predictions.select("id", *[F.col(c).alias(f"__{c}") for c in fields if c in predictions.columns])
    joined = uploads.join(right, "id", "left")
    taken = {c: F.coalesce(F.col(c), F.col(f"__{c}")) if c in uploads.columns else F.col(f"__{c}") for c in fields if c in predictions.columns}
    return joined.withColumns(taken).drop(*[f"__{c}" for c in fields])


def early_filter(items: DataFrame, rules) -> DataFrame:
    """Cheap exclusions before anything is downloaded: metadata and privacy."""
    from .rules import metadata_reason, privacy_exceeded

    return items.filter(metadata_reason(rules).isNull() & ~privacy_exceeded(rules.max_privacy_blur))


def natural_key(name: Column, width: int = 12) -> Column:
    """Sort key of natural file order: numbers are padded."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def first_by_id(df: DataFrame, position: str, key: str = "id") -> DataFrame:
    """Distinct by key, first in order wins."""
    w = Window.partitionBy(key).orderBy(position)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
