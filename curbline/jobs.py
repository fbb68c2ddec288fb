"""Whole jobs over DataFrames: build a data set, judge it, and write its tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import dedupe, ingest, sampling, summary
from .operators.evaluation import area_samples
from .operators.rules import Rules
from .operators.scratch import written
from .operators.verdict import judge
from .schema import PICTURE, with_columns_of
from .sources import assets, files

# The areas that are sampled by default (lon_min, lat_min, lon_max, lat_max).
AREAS = [
    (2.30, 48.84, 2.38, 48.88), (4.80, 45.73, 4.88, 45.78), (-1.72, 48.09, -1.64, 48.13), (1.40, 43.58, 1.48, 43.63), (5.35, 43.27, 5.42, 43.32), (3.03, 50.61, 3.10, 50.65),
    (-1.59, 47.20, -1.52, 47.23), (-0.62, 44.82, -0.55, 44.86), (7.72, 48.56, 7.78, 48.60), (5.70, 45.15, 5.78, 45.20), (-3.00, 48.00, -2.80, 48.15), (2.90, 45.60, 3.10, 45.75),
    (6.80, 45.85, 6.95, 45.95), (-1.65, 49.60, -1.55, 49.66), (3.85, 43.59, 3.91, 43.63), (8.70, 41.90, 8.76, 41.94), (6.00, 48.60, 6.30, 48.80), (5.00, 47.30, 5.07, 47.34),
]


def default_areas(spark) -> DataFrame:
    return spark.createDataFrame([(k, *a) for k, a in enumerate(AREAS)], "area int, lon_min double, lat_min double, lon_max double, lat_max double")


def fetch(items: DataFrame, folder: str, get: assets.Fetch, areas: DataFrame | None = None, known: DataFrame | None = None, rules: Rules | None = None, per_area: int = 30, per_sequence: int = 2, seed: int = 0, new_sequences: bool = False, asset: str = "sd", read_privacy: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new, fetched): records sampled by area that are not known and not excluded by metadata or privacy, and where their files are.

    ``known`` has the ids (and with ``new_sequences`` the collections) that were judged before.
    """
    spark = items.sparkSession
    href = ingest.asset_url(F.try_element_at("assets", F.lit(asset))["href"], ingest.instance_api(F.col("links")))
    links = items.select("id", href.alias("url"))
    records = ingest.flatten_items(items)
    if known is not None and new_sequences:
        # The rows of no collection stay: a null matches nothing.
        records = ingest.skip_known(records, known.filter("collection is not null"), "collection")
    drawn = sampling.capped(area_samples(records, areas if areas is not None else default_areas(spark)), "area", "collection", per_sequence, per_area, seed=seed)
    drawn = ingest.skip_known(drawn, known) if known is not None else drawn
    drawn = assets.remote_privacy(drawn, get) if read_privacy else drawn.withColumns({c: F.lit(None).cast(PICTURE[c]) for c in ("privacy_blur", "privacy_patches", "privacy_record")})
    new = written(ingest.early_filter(drawn, rules or Rules()).drop("area"), "fetch")
    got = assets.download(new.select("id").join(links, "id"), folder, get)
    return new, got


def settle(new: DataFrame, hashes: DataFrame, old: DataFrame | None = None, reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metadata, duplicates): new records without the copies among them or of ``reference``, upserted into the old ones.

    ``hashes`` is (id, position, sha1, dhash) of the files read; records without a file go.
    """
    judged = dedupe.drop_duplicates(hashes, reference)
    kept = new.join(judged.filter("kept").select("id"), "id", "left_semi")
    return (kept if old is None else ingest.upsert(old, kept)), judged.filter("not kept").select("id", "duplicate_of")


def predict(images: DataFrame, metadata: DataFrame, scorer: Callable[..., dict], rules: Rules | None = None, alone: bool = False) -> tuple[DataFrame, DataFrame]:
    """(judged, broken): decoded pictures measured, joined to their metadata and judged; those that cannot be read are told apart.

    ``alone`` judges every picture without its sequence.
    """
    measured = written(files.measure(images, scorer).withColumn("id", ingest.file_stem(F.col("path"))), "measured")
    good = measured.filter("error is null").drop("error", "width", "height")
    mine = [c for c in metadata.columns if c == "id" or c not in good.columns]
    rows = ingest.join_metadata(good, metadata.select(*mine))
    rows = rows.withColumn("rank", F.lit(None).cast("int")) if alone else rows
    return judge(rows, rules), measured.filter("error is not null").select("id", "path", "error")


def report(judged: DataFrame) -> dict[str, DataFrame]:
    """What a run ends with: totals, reasons, and sequences with the worst median first."""
    placed = with_columns_of(judged, ["collection", "camera"])
    placed = placed if "position" in placed.columns else placed.withColumn("position", F.col("id"))
    return {"totals": summary.totals(placed), "reasons": summary.histogram(placed, "excluded"), "sequences": summary.sequence_summary(placed)}


def tag(judged: DataFrame, send: Callable[[str, str, list[dict]], None] | None = None, comment: Column | None = None) -> DataFrame | None:
    """Tags of all pictures with issues: without ``send`` the requests as they would be, with a report comment if one is given."""
    payload = files.send_tags(summary.tag_payload(judged), send)
    if payload is None:
        return None
    requests = payload.join(judged.select("id", "instance_api", *([comment.alias("report")] if comment is not None else [])), "id")
    target = F.concat_ws("/", F.col("instance_api"), F.lit("collections"), F.col("collection"), F.lit("items"), F.col("id"))
    return requests.select("id", F.concat(F.lit("PATCH "), target).alias("request"), "body", *(["report"] if comment is not None else []))
