"""Assets of catalogue items: files fetched once, privacy records read from the ends of remote files.

Network access is a function that callers give (``fetch``): executors call it, and tests pass one that reads a folder.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.privacy import record_of, with_blurred_share
from ..schema import DETECTION

TAIL = 65536
#: How far into a file its size is looked for, one read after the other.
HEADS = (TAIL, 8 * TAIL, 32 * TAIL)
#: (status, bytes) of a URL; the range is that of a Range header, None for the whole file.
Fetch = Callable[[str, str | None], tuple[int, bytes]]


def http(token: str | None = None, timeout: float = 120.0) -> Fetch:
    """Plain HTTP reads, with a bearer token if one is given."""

    def fetch(url: str, range_: str | None) -> tuple[int, bytes]:
        from urllib.request import Request, urlopen

        headers = {"User-Agent": "curbline"} | ({"Authorization": f"Bearer {token}"} if token else {}) | ({"Range": range_} if range_ else {})
        with urlopen(Request(url, headers=headers), timeout=timeout) as r:
            # A server that ignores the range would send everything: only what was asked for is read.
            return r.status, r.read() if r.status == 206 or range_ is None else b""

    return fetch


def download(items: DataFrame, folder: str, fetch: Fetch, url: str = "url", delay: float = 0.2) -> DataFrame:
    """(id, path, bytes, status) after each item's asset lies in ``folder``, which all executors have to share.

    A file that is there and not empty is not fetched again (``present``).  New ones are written beside their place under a
    name of the attempt and moved there, so a lost or repeated task leaves no half file.  A failure is a status, not an error.
    """

    def one(id_: str, address: str | None) -> tuple[str | None, int | None, str]:
        target = Path(folder, f"{id_}.jpg")
        try:
            if target.parent.resolve() != Path(folder).resolve():
                raise ValueError("the id is no file name")
            if target.exists() and target.stat().st_size:
                return str(target), target.stat().st_size, "present"
            if not address:
                raise ValueError("no address")
            target.parent.mkdir(parents=True, exist_ok=True)
            status, data = fetch(address, None)
            if status != 200:
                raise OSError(f"status {status}")
            part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
            part.write_bytes(data)
            os.replace(part, target)
            time.sleep(delay)
            return str(target), len(data), "fetched"
        except Exception as e:  # the other pictures go on
            return None, None, f"error: {type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [(i, *one(i, u)) for i, u in zip(frame["id"], frame["url"])]
            yield pd.DataFrame(done, columns=["id", "path", "bytes", "status"]).astype({"bytes": "Int64"})

    return items.select(F.col("id").cast("string").alias("id"), F.col(url).alias("url")).mapInPandas(run, "id string, path string, bytes long, status string")


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the frame header; None if it is not within these bytes."""
    at = 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("broken JPEG header")
        kind = data[at + 1]
        if kind == 0xFF:  # a fill byte
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD7:  # no length follows
            at += 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def remote_record(fetch: Fetch, url: str | None, whole_files: bool = False) -> tuple[list[dict] | None, int | None, int | None, str]:
    """(detections, width, height, state) of a remote original: ``record``, ``none``, or why it is unknown."""
    try:
        if not url:
            return None, None, None, "no address"
        status, tail = fetch(url, f"bytes=-{TAIL}")
        whole = None
        if status != 206:
            if not whole_files:
                return None, None, None, "no range support"
            status, whole = fetch(url, None)
            tail = whole[-TAIL:]
        found = record_of(tail)
        if found is None:
            return None, None, None, "none"
        for size in HEADS:
            shape = jpeg_size(whole if whole is not None else fetch(url, f"bytes=0-{size - 1}")[1])
            if shape is not None:
                return found, *shape, "record"
            if whole is not None:
                break
        raise OSError("no frame header")
    except Exception as e:  # an unknown share never excludes
        return None, None, None, f"error: {type(e).__name__}"


def remote_privacy(items: DataFrame, fetch: Fetch, url: str = "hd_url", whole_files: bool = False) -> DataFrame:
    """Add the privacy columns from the last bytes of each remote original and, where it has a record, its first ones.

    No record in an original means that nothing was blurred; a file that cannot be read in part has an unknown share.
    """
    names = items.columns
    schema = items.select(*names, F.lit(None).cast(f"array<{DETECTION}>").alias("__found"), F.lit(None).cast("int").alias("__w"), F.lit(None).cast("int").alias("__h"), F.lit(None).cast("string").alias("__state")).schema
    floats = lambda v: None if v is None else [float(x) for x in v]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [remote_record(fetch, u, whole_files) for u in frame[url]]
            found = [None if g[0] is None else [{"class": d["class"], "confidence": d.get("confidence"), "xywh": floats(d.get("xywh")), "bbox": floats(d.get("bbox"))} for d in g[0]] for g in got]
            yield frame.assign(__found=found, __w=pd.array([g[1] for g in got], "Int32"), __h=pd.array([g[2] for g in got], "Int32"), __state=[g[3] for g in got])

    out = with_blurred_share(items.mapInPandas(run, schema), "__found", "__w", "__h")
    none, state = F.col("__state") == "none", F.col("__state")
    out = out.withColumns({"privacy_blur": F.when(none, 0.0).otherwise(F.col("privacy_blur")), "privacy_patches": F.when(none, 0).otherwise(F.col("privacy_patches")), "privacy_record": F.when(state == "record", "sgblur").otherwise(state)})
    return out.drop("__found", "__w", "__h", "__state")
