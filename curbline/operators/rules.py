"""Thresholds of the verdict and the predicates that apply them, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW_QUALITY, SEQUENCE_OUTLIER = "low_quality", "sequence_outlier"


@dataclass(frozen=True)
class Rules:
    """Limits of every rule.  0 turns a metadata limit off; an area limit outside (0, 1) and a share above 1 turn theirs off."""

    max_privacy_blur: float | None = 0.05
    min_wavy_neighbours: float = 0.30
    min_orientation_confidence: float = 0.99
    max_gps_accuracy: float = 0.0
    min_pixel_density: float = 15.0
    max_blurred_area: float = 0.33
    confirm_cpbd: float = 0.15
    soft_blurred_area: float = 0.20
    soft_cpbd: float = 0.12
    max_below_neighbours: float = 0.12
    floor_in_context: float = 0.32
    floor_alone: float = 0.40
    window: int = 10
    min_neighbours: int = 2


def _yes(c: Column) -> Column:
    """Null counts as no."""
    return F.coalesce(c, F.lit(False))


def first_match(*cases: tuple[str, Column | None]) -> Column:
    """Name of the first rule that applies, else null; rules given as None are off."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(_yes(when), name) for name, when in cases if when is not None])


def metadata_reason(rules: Rules) -> Column:
    gps = F.col("gps_accuracy") > rules.max_gps_accuracy if rules.max_gps_accuracy else None
    density = F.col("pixel_density") < rules.min_pixel_density if rules.min_pixel_density else None
    return first_match(("gps_inaccurate", gps), ("low_resolution", density))


def privacy_exceeded(limit: float | None) -> Column:
    """Strictly more than the limit; unknown shares and no limit never exclude."""
    return F.lit(False) if limit is None else _yes(F.col("privacy_blur") > limit)


def wrong_orientation(min_confidence: float) -> Column:
    """Two confident rotated views of a 360° picture; else the picture's own rotation.  Empty views count as none."""
    turned = lambda v: (v["rotation"] != 0) & (v["confidence"] >= min_confidence)
    views = F.col("orientation_views")
    flat = (F.col("orientation") != 0) & (F.col("orientation_confidence") >= min_confidence)
    return _yes(F.when(F.size(F.coalesce(views, F.array().cast(views_type()))) > 0, F.size(F.filter(views, turned)) >= 2).otherwise(flat))


def views_type() -> str:
    return "array<struct<rotation:int,confidence:double>>"


def not_sharp(rules: Rules) -> Column:
    if not 0 < rules.max_blurred_area < 1:
        return F.lit(False)
    area, cpbd = F.col("blurred_area"), F.col("cpbd")
    confirmed = (area >= rules.max_blurred_area) & (cpbd < rules.confirm_cpbd)
    soft = (area >= rules.soft_blurred_area) & (cpbd < rules.soft_cpbd)
    return _yes(F.when(cpbd.isNull(), area >= rules.max_blurred_area).otherwise(confirmed | soft))


def hard_reason(rules: Rules) -> Column:
    """First hard exclusion: metadata, advertisement, privacy blur, orientation, sharpness."""
    return F.coalesce(
        metadata_reason(rules),
        first_match(
            ("advertisement", F.col("ad_rejected")),
            ("privacy_blur", privacy_exceeded(rules.max_privacy_blur)),
            ("wrong_orientation", wrong_orientation(rules.min_orientation_confidence)),
            ("not_sharp", not_sharp(rules)),
        ),
    )
