import json

import numpy as np
import pytest

from curbline.functions import pixels, waviness
from curbline.sources import catalogue, files


def textured(w, h, seed):
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    base = np.stack([40 + 120 * x / w, 40 + 120 * y / h, 60 + 60 * (x + y) / (w + h)], -1) + ((x // 24 + y // 24) % 2 * 50)[..., None]
    return np.clip(base + np.random.default_rng(seed).normal(0, 12, (h, w, 1)), 0, 255).astype(np.uint8)


def facade(kind, amount):
    y, x = np.meshgrid(np.arange(720), np.arange(960), indexing="ij")
    shift = {"straight": 0 * y, "sine": amount * np.sin(2 * np.pi * y / 240), "bow": amount * 4 * (y / 720 - 0.5) ** 2, "perspective": (x - 480) * amount * y / 720 / 480}[kind]
    img = np.where((x + shift) % 105 < 6, 40, 200) + np.random.default_rng(2).normal(0, 3, (720, 960))
    return np.clip(np.repeat(img[..., None], 3, 2), 0, 255).astype(np.uint8)


def test_blur_lowers_sharpness():
    img = textured(1024, 768, 1)
    soft = np.stack([pixels.gaussian(img[..., c].astype(np.float32), 2) for c in range(3)], -1).astype(np.uint8)
    a, b = pixels.sharpness(img, False), pixels.sharpness(soft, False)
    assert a["sharpness"] > b["sharpness"] and a["blurred_area"] == 0 and b["blurred_area"] > 0.9


def test_views_and_hash():
    pano = textured(2048, 1024, 2)
    p = pixels.prepare(pano)
    assert p.is_pano and [v.shape for v in p.views()] == [(512, 512, 3)] * 4
    flat = pixels.prepare(textured(640, 480, 3))
    assert not flat.is_pano and max(flat.image.shape[:2]) == 512
    assert [v.shape for v in pixels.pano_views(pano, 64)] == [(64, 64, 3)] * 4
    ramp = np.repeat(np.tile(np.linspace(250, 5, 320), (240, 1))[..., None], 3, 2).astype(np.uint8)
    assert pixels.dhash(ramp) == 0 and pixels.dhash(ramp[:, ::-1]) == -1
    assert (pixels.rotate(pixels.rotate(ramp, 90), 270) == ramp).all()


@pytest.mark.parametrize(("kind", "amount", "label"), [("straight", 0, "no_strong_evidence"), ("sine", 8, "wavy"), ("sine", 16, "wavy"), ("bow", 16, "no_strong_evidence"), ("perspective", 30, "no_strong_evidence")])
def test_bending(kind, amount, label):
    assert waviness.analyse(facade(kind, amount))["waviness_label"] == label


def test_bending_survives_blur_and_noise_alone_is_none():
    soft = lambda img, r: np.stack([np.clip(pixels.gaussian(img[..., c].astype(np.float32), r), 0, 255) for c in range(3)], -1).astype(np.uint8)
    got = waviness.analyse(soft(facade("sine", 16), 2))
    assert got["waviness_label"] == "wavy" and got["support"] >= 3
    assert waviness.analyse(soft(facade("straight", 0), 3))["waviness_label"] == "no_strong_evidence"
    noise = np.random.default_rng(8).integers(0, 256, (720, 960, 3), dtype=np.uint8)
    assert waviness.analyse(noise)["waviness_label"] != "wavy"


def test_edge_spread_is_the_length_of_the_monotone_run():
    row = np.array([0, 0, 10, 20, 30, 30, 20, 20, 5, 0], np.float32)
    g = np.tile(row, (5, 1))
    widths = pixels.edge_spread(g, np.array([2 * 10 + 2, 2 * 10 + 3, 2 * 10 + 8]))
    assert widths.tolist() == [3, 3, 2]
    assert pixels.uncovered((10, 10), [(0.0, 0.0, 0.31, 0.5), (0.9, 0.9, 1.5, 2.0)]).sum() == 100 - 4 * 5 - 1
    assert pixels.uncovered((4, 4), None).all()


def test_bending_needs_evidence():
    assert waviness.analyse(np.full((720, 960, 3), 128, np.uint8))["waviness_label"] == "insufficient_evidence"
    assert waviness.check(np.zeros((512, 1024, 3), np.uint8))["waviness_label"] is None
    with pytest.raises(ValueError):
        waviness.Settings(decision=101)


def test_measure_reports_broken_pictures(spark):
    img = textured(160, 120, 5)
    data = [("a", 120, 160, 3, bytearray(img[..., ::-1].tobytes())), ("b", 10, 10, 3, bytearray(300))]
    got = {r["path"]: r for r in files.measure(spark.createDataFrame(data, "path string, height int, width int, channels int, data binary")).collect()}
    assert got["a"]["error"] is None and got["a"]["quality_score"] == round(float(img.mean()) / 255, 4)
    assert got["b"]["error"] and got["b"]["quality_score"] is None


def test_jsonl_and_catalogue(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"a","n":1}\n\n{"id":"b"}\n')
    assert sorted(tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, n int").collect()) == [("a", 1), ("b", None)]
    item = lambda i, r: {"id": i, "collection": "c", "geometry": {"type": "Point", "coordinates": [float(r), 0.0]}, "properties": {"geovisio:rank_in_collection": r}}
    (tmp_path / "c.json").write_text(json.dumps({"features": [item("a", 1), item("b", 2)], "links": [{"rel": "next", "href": "c2.json"}]}))
    (tmp_path / "c2.json").write_text(json.dumps({"features": [item("d", 3)]}))
    assert sorted(r["id"] for r in catalogue.read_catalogue(spark, str(tmp_path), collection="c").collect()) == ["a", "b", "d"]
    assert [r["id"] for r in catalogue.read_catalogue(spark, str(tmp_path), collection="c", bbox="1.5,-1,2.5,1").collect()] == ["b"]
    with pytest.raises(ValueError):
        list(catalogue.collection_items(catalogue.from_folder(str(tmp_path)), "c.json", start_after=1))


def test_streaming_hard_verdicts(spark, tmp_path):
    from curbline.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id":"a","pixel_density":3}\n{"id":"b"}\n')
    stream = ingest.hard_verdicts(ingest.read_records(spark, str(tmp_path / "in"), "id string, pixel_density double"))
    q = stream.select("id", "excluded").writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"]: r["excluded"] for r in spark.table("verdicts").collect()} == {"a": "low_resolution", "b": None}
