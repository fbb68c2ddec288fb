"""Assets, policies, evaluation and whole jobs, with a folder in place of the network."""

from pathlib import Path

import numpy as np
import pytest

from curbline import jobs
from curbline.functions import policy
from curbline.operators import evaluation
from curbline.operators.privacy import python_round4
from curbline.schema import ITEM
from curbline.sources import assets

RECORD = b"[{'class': 'face', 'confidence': 0.9, 'xywh': [0, 0, 100, 50]}]"


def jpeg(record=RECORD, filler=70_000, width=200, height=100):
    out = b"\xff\xd8"
    while filler > 0:
        n = min(filler, 60_000)
        out += b"\xff\xe1" + (n + 2).to_bytes(2, "big") + bytes(n)
        filler -= n
    out += b"\xff\xc0\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes(10) + b"\xff\xda\x00\x02" + bytes(80_000)
    return out + (b"\xff\xfe" + (len(record) + 2).to_bytes(2, "big") + record if record else b"") + b"\xff\xd9"


def from_folder(root, ranges=True, log=None):
    def fetch(url, range_):
        data = Path(root, url).read_bytes()
        if log is not None:
            with open(log, "a") as f:
                f.write(f"{url} {range_}\n")
        if range_ is None or not ranges:
            return 200, data
        first, last = range_.removeprefix("bytes=").split("-")
        return 206, data[-int(last) :] if first == "" else data[int(first) : int(last) + 1]

    return fetch


def test_privacy_from_the_ends_of_remote_files(spark, tmp_path):
    (tmp_path / "far.jpg").write_bytes(jpeg())
    (tmp_path / "clean.jpg").write_bytes(jpeg(None))
    (tmp_path / "bad.jpg").write_bytes(b"no picture" + jpeg()[2:])
    rows = spark.createDataFrame([("a", "far.jpg"), ("b", "clean.jpg"), ("c", "bad.jpg"), ("d", "gone.jpg"), ("e", None)], "id string, hd_url string")
    log = tmp_path / "log"
    got = {r["id"]: r for r in assets.remote_privacy(rows, from_folder(tmp_path, log=str(log))).collect()}
    assert (got["a"]["privacy_blur"], got["a"]["privacy_patches"], got["a"]["privacy_record"]) == (0.25, 1, "sgblur")
    assert (got["b"]["privacy_blur"], got["b"]["privacy_record"]) == (0.0, "none")
    assert got["c"]["privacy_blur"] is None and got["c"]["privacy_record"] == "error: ValueError"
    assert got["d"]["privacy_record"] == "error: FileNotFoundError" and got["e"]["privacy_record"] == "no address"
    assert "far.jpg bytes=0-524287" in log.read_text() and "far.jpg None" not in log.read_text()
    whole = from_folder(tmp_path, ranges=False)
    assert assets.remote_record(whole, "far.jpg")[3] == "no range support"
    assert assets.remote_record(whole, "far.jpg", whole_files=True)[1:] == (200, 100, "record")


def test_downloads_are_idempotent(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"picture")
    rows = spark.createDataFrame([("a", "x"), ("b", "gone"), ("../c", "x")], "id string, url string")
    run = lambda: {r["id"]: r["status"] for r in assets.download(rows, str(tmp_path / "out"), from_folder(tmp_path), delay=0).collect()}
    first, again = run(), run()
    assert first["a"] == "fetched" and again["a"] == "present" and first["b"].startswith("error: FileNotFoundError") and first["../c"].startswith("error: ValueError")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.jpg"]


def test_jpeg_size_needs_the_frame_header():
    assert assets.jpeg_size(jpeg()[:65536]) is None and assets.jpeg_size(jpeg(filler=0)) == (200, 100)
    with pytest.raises(ValueError):
        assets.jpeg_size(b"PNG")


def test_policy_and_kept_vectors(spark, tmp_path):
    path = tmp_path / "policy.json"
    path.write_text('{"version": "1", "reference": [{"id": "s", "label": "S", "prompts": ["A Road", "b"]}], "advertising": [{"id": "f", "label": "F", "prompts": ["Flyer"]}]}')
    rows = policy.read_policy(spark, str(path))
    assert [(r["at"], r["kind"], r["category"], r["prompt"]) for r in rows.orderBy("at").collect()] == [(0, "reference", "s", "a road"), (1, "reference", "s", "b"), (2, "advertising", "f", "flyer")]
    calls = []

    def embed(prompts):
        calls.append(prompts)
        return np.arange(1, 2 * len(prompts) + 1).reshape(-1, 2)

    one, two = (policy.prompt_vectors(rows, str(tmp_path / "cache"), "r1", embed).orderBy("at").collect() for _ in range(2))
    assert one == two and len(calls) == 1 and abs(np.linalg.norm(one[2]["vector"]) - 1) < 1e-6
    policy.prompt_vectors(rows, str(tmp_path / "cache"), "r2", embed)
    assert len(calls) == 2
    with pytest.raises(ValueError):
        policy.prompt_vectors(rows, str(tmp_path / "cache"), "r3", lambda p: np.full((3, 2), np.nan))


def test_rounding_is_that_of_python(spark):
    rng = np.random.default_rng(5)
    near = (rng.integers(0, 10000, 3000) + 0.5) / 10000
    values = [0.0, 1.0, 0.5, 0.03125, 0.09375, *rng.random(3000), *near, *np.nextafter(near, 0), *np.nextafter(near, 1), *(rng.integers(0, 32768, 2000) / 32768)]
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = rows.select("v", python_round4(rows["v"]).alias("r")).collect()
    assert all(r["r"] == (None if r["v"] is None else round(r["v"], 4)) for r in got)


def test_auc_edges(spark):
    rows = spark.createDataFrame([(1, 0.9, 1.0), (1, 0.5, 1.0), (0, 0.5, 1.0), (0, 0.1, None), (None, 0.3, 1.0)], "label int, a double, b double")
    got = {r["measure"]: r for r in evaluation.auc_table(rows, ["a", "b"], "label").collect()}
    assert got["a"]["auc"] == 0.875 and got["b"]["auc"] == 0.5
    assert evaluation.auc_table(rows.filter("label = 1"), ["a"], "label").first()["auc"] is None
    assert evaluation.auc_table(rows.limit(0), ["a"], "label").count() == 0
    with pytest.raises(ValueError):
        evaluation.detection_table(rows.withColumn("v", evaluation.F.lit("x")), "v", "y", evaluation.F.lit(True), ["a"])


def item(id_, lon, href="far.jpg", density=20.0):
    optics = (None, None, 90.0, None)
    return (id_, f"c{id_[0]}", ("Point", [lon, 48.85]), [("root", "https://i.example/api", None)], {"hd": (href,), "sd": (href,)}, ("CC", None, 1, 1.0, density, optics))


def test_fetch_settle_and_tag(spark, tmp_path):
    (tmp_path / "far.jpg").write_bytes(jpeg())
    (tmp_path / "clean.jpg").write_bytes(jpeg(None))
    items = spark.createDataFrame([item("a", 2.35, "clean.jpg"), item("b", 2.35), item("c", 60.0, "clean.jpg"), item("d", 2.35, "clean.jpg", 3.0), item("e", 2.35, "clean.jpg"), item("f", 2.31, "clean.jpg")], ITEM)
    known = spark.createDataFrame([("e", "ce")], "id string, collection string")
    new, got = jobs.fetch(items, str(tmp_path / "out"), from_folder(tmp_path), known=known)
    assert sorted(r["id"] for r in new.collect()) == ["a", "f"]  # b is blurred, c lies elsewhere, d is too coarse, e is known
    assert {r["id"]: r["status"] for r in got.collect()} == {"a": "fetched", "f": "fetched"}
    hashes = spark.createDataFrame([("a", 0, "s", 1), ("f", 1, "s", 1)], "id string, position long, sha1 string, dhash long")
    kept, copies = jobs.settle(new, hashes, old=new.limit(0))
    assert [r["id"] for r in kept.collect()] == ["a"] and [(r["id"], r["duplicate_of"]) for r in copies.collect()] == [("f", 0)]
    judged = spark.createDataFrame([("p", "c", "https://i.example/api", ["low_quality"], "m"), ("q", "c", None, ["low_quality"], "m")], "id string, collection string, instance_api string, issues array<string>, model string")
    sent = jobs.tag(judged).collect()
    assert [r["request"] for r in sent] == ["PATCH https://i.example/api/collections/c/items/p"] and '"value":"low_quality"' in sent[0]["body"]


def test_predict_tells_broken_pictures_apart(spark):
    rng = np.random.default_rng(0)
    good = [(f"/x/{n}.jpg", 120, 160, 3, rng.integers(0, 255, (120, 160, 3), np.uint8).tobytes()) for n in ("one", "two")]
    images = spark.createDataFrame([*good, ("/x/bad.jpg", -1, -1, -1, b"")], "path string, height int, width int, channels int, data binary")
    meta = spark.createDataFrame([("one", "c", 1, 3.0)], "id string, collection string, rank int, pixel_density double")
    judged, broken = jobs.predict(images, meta, lambda picture: {"quality_score": 0.9, "model": "m"})
    got = {r["id"]: r["excluded"] for r in judged.collect()}
    assert got["one"] == "low_resolution" and set(got) == {"one", "two"}
    assert [r["id"] for r in broken.collect()] == ["bad"]
    assert jobs.report(judged)["totals"].first()["pictures"] == 2


def test_advert_records_keep_four_states(spark, tmp_path):
    evidence = "struct<score:double,complete:boolean,clear_layout:boolean,substantial_text:boolean,commercial_intent:boolean,strong_poster:boolean>"
    ad = (95.0, True, True, True, True, False)
    rows = spark.createDataFrame([("a", ad, None, None), ("b", None, None, None), ("c", ad, "unreadable", None), ("d", (95.0, False, True, True, True, False), None, None)], f"id string, evidence {evidence}, error string, unavailable string")
    records = policy.advert_records(rows)
    assert {r["id"]: (r["status"], r["decision"], r["ad_rejected"]) for r in records.collect()} == {"a": ("complete", "reject", True), "b": ("unavailable", "accept", False), "c": ("error", "error", False), "d": ("partial", "accept", False)}
    assert policy.write_records(records, str(tmp_path / "r")) == 2 and policy.write_records(records.filter("id = 'a'"), str(tmp_path / "r")) == 0
