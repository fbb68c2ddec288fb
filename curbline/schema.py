"""Explicit schemas of the picture model; a column that an input lacks counts as null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTION = "struct<class:string,confidence:double,xywh:array<double>,bbox:array<double>>"
VIEW = "struct<rotation:int,confidence:double>"

#: Measurements and identity of a picture, as the rules read them.
PICTURE: dict[str, str] = {
    "id": "string", "collection": "string", "rank": "int", "is_pano": "boolean", "camera": "string",
    "original_size": "array<int>", "datetime": "string", "license": "string", "lon_lat": "array<double>",
    "gps_accuracy": "double", "pixel_density": "double", "instance_api": "string", "hd_url": "string",
    "privacy_blur": "double", "privacy_patches": "int", "privacy_record": "string",
    "orientation": "int", "orientation_confidence": "double", "orientation_views": f"array<{VIEW}>",
    "sharpness": "double", "blurred_area": "double", "cpbd": "double",
    "waviness_label": "string", "waviness_score": "double",
    "ad_rejected": "boolean", "ad_score": "double", "ad_checked": "boolean", "ad_reason": "string",
    "quality_score": "double", "issues": "array<string>", "context_fetched": "boolean", "model": "string",
}

#: Catalogue item, nested as STAC nests it (DDL).
ITEM = (
    "id string, collection string, geometry struct<type:string,coordinates:array<double>>, "
    "links array<struct<rel:string,href:string,instance_name:string>>, assets map<string,struct<href:string>>, "
    "properties struct<license:string,datetime:string,`geovisio:rank_in_collection`:int,"
    "`quality:horizontal_accuracy`:double,`panoramax:horizontal_pixel_density`:double,"
    "`pers:interior_orientation`:struct<camera_manufacturer:string,camera_model:string,field_of_view:double,sensor_array_dimensions:array<int>>>"
)


def with_columns_of(df: DataFrame, names: tuple[str, ...] | list[str]) -> DataFrame:
    """Add null columns for the named picture columns that df lacks."""
    return df.withColumns({c: F.lit(None).cast(PICTURE[c]) for c in names if c not in df.columns})
