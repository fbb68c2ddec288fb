"""A Python data source over a catalogue: searches by box and reads collections page by page.

Pages come from a ``transport`` (url -> parsed JSON); the default one reads JSON files below a folder, as no
network is assumed.  Options: path, collection, bbox, limit, startAfterRank.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import ITEM

PAGE = 100


def from_folder(root: str) -> Callable[[str], dict]:
    return lambda url: json.loads(Path(root, url).read_text(encoding="utf-8"))


def collection_items(transport: Callable[[str], dict], first: str, limit: int | None = None, start_after: int | None = None) -> Iterator[dict]:
    """Items along the ``next`` links.  A first item at or before the offset means that the server ignored it: that is an error."""
    url, seen = first, 0
    while url:
        page = transport(url)
        for item in page.get("features", []):
            rank = item.get("properties", {}).get("geovisio:rank_in_collection")
            if not seen and start_after is not None and rank is not None and rank <= start_after:
                raise ValueError(f"the catalogue ignored startAfterRank={start_after}: its first item has rank {rank}")
            yield item
            seen += 1
            if limit is not None and seen >= limit:
                return
        url = next((x["href"] for x in page.get("links", []) if x.get("rel") == "next"), None)


class CatalogueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "curbline_catalogue"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> DataSourceReader:
        return CatalogueReader(self.options)


class CatalogueReader(DataSourceReader):
    """One partition for each named collection, or one for a search."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.options.get("collection", "search").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        limit, after = (int(o[k]) if k in o else None for k in ("limit", "startafterrank" if "startafterrank" in o else "startAfterRank"))
        box = [float(x) for x in o["bbox"].split(",")] if "bbox" in o else None
        found = 0
        for item in collection_items(from_folder(o["path"]), f"{partition.value}.json", limit if box is None else None, after):
            at = (item.get("geometry") or {}).get("coordinates") or [None, None]
            if box is None or None not in at[:2] and box[0] <= at[0] <= box[2] and box[1] <= at[1] <= box[3]:
                yield (json.dumps(item),)
                found += 1
                if found == limit:  # of the items within the box
                    return


def read_catalogue(spark, path: str, **options):
    """Items of a catalogue with the nested item schema."""
    from pyspark.sql import functions as F

    spark.dataSource.register(CatalogueSource)
    raw = spark.read.format("curbline_catalogue").options(path=path, **options).load()
    return raw.select(F.from_json("item", ITEM).alias("i")).select("i.*")
