import random

import pytest
from pyspark.sql import functions as F

from curbline.functions import text as texts
from curbline.operators import dedupe, ingest, privacy, sampling, summary, vectors
from curbline.operators.rules import Rules, metadata_reason, not_sharp
from curbline.schema import DETECTION


def greedy(rows, distance, reference=()):
    """Plain greedy removal over (position, sha, hash)."""
    seen = list(reference)
    out = {}
    shas = {s: p for p, s, _ in reference}
    for p, s, h in rows:
        dup = shas.get(s)
        if dup is None:
            dup = next((q for q, _, g in seen if bin((g ^ h) & (2**64 - 1)).count("1") <= distance), None)
        out[p] = dup
        if dup is None:
            seen.append((p, s, h))
            shas[s] = p
    return out


@pytest.mark.parametrize("with_reference", [False, True])
def test_greedy_dedupe_is_the_first_independent_set(spark, with_reference):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(12)]

    def one():
        h = r.choice(base)
        for _ in range(r.randint(0, 5)):
            h ^= 1 << r.randrange(64)
        return h - 2**64 if h >= 2**63 else h

    hashes = [one() for _ in range(150)]
    data = [(i, f"sha{h}", h) for i, h in enumerate(hashes)]
    ref = [(i, f"sha{h}", h) for i, h in enumerate([one() for _ in range(10)] + hashes[:2])] if with_reference else []
    schema = "position long, sha1 string, dhash long"
    got = dedupe.drop_duplicates(spark.createDataFrame(data, schema), spark.createDataFrame(ref, schema) if ref else None)
    expected = greedy(data, 6, [(i - len(ref), s, h) for i, s, h in ref])
    assert {x["position"]: x["duplicate_of"] for x in got.collect()} == expected
    assert {x["position"]: x["kept"] for x in got.collect()} == {p: d is None for p, d in expected.items()}


def test_union_area_and_share(rows):
    box = lambda c, *v: {"class": c, "xywh": [float(x) for x in v]}
    d = [{"id": 1, "width": 2048, "height": 1536, "detections": [box("face", 448, 0, 416, 384)]}, {"id": 2, "width": 1000, "height": 1000, "detections": [box("face", 0, 0, 100, 100), box("plate", 50, 50, 100, 100), box("sign", 0, 0, 900, 900), box("face", 5, 5, 10, 10)]}, {"id": 3, "width": 100, "height": 100, "detections": []}, {"id": 4, "width": 100, "height": 100}, {"id": 5, "width": 100, "height": 100, "detections": [box("face", 0, 200, 50, 50)]}]
    for x in d:
        x["detections"] = [(b["class"], None, b["xywh"], None) for b in x["detections"]] if "detections" in x else None
    got = {r["id"]: r for r in privacy.with_blurred_share(rows(d, f"id int, width int, height int, detections array<{DETECTION}>")).collect()}
    assert (got[1]["privacy_blur"], got[1]["privacy_patches"], got[1]["privacy_boxes"][0]) == (0.0508, 1, [0.2188, 0.0, 0.4219, 0.25])
    assert (got[2]["privacy_blur"], got[2]["privacy_patches"]) == (round((2 * 100**2 - 50**2) / 1e6, 4), 2)
    assert (got[3]["privacy_blur"], got[4]["privacy_blur"], got[4]["privacy_patches"]) == (0.0, None, None)
    assert (got[5]["privacy_blur"], got[5]["privacy_patches"]) == (0.0, 1)


def test_trailer_record(spark):
    def jpeg(body):
        return b"\xff\xd8 pixels" + b"\xff\xfe" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"

    good = jpeg(b"[{'class': 'face', 'confidence': None, 'xywh': (1, 2, 30, 40)}]")
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(jpeg(b"hello"))), (3, None), (4, bytearray(b"x" * 70000 + good))], "id int, content binary")
    got = {r["id"]: r["detections"] for r in privacy.trailer_detections(df).collect()}
    assert got[1][0]["xywh"] == [1.0, 2.0, 30.0, 40.0] and got[2] is None and got[3] is None and got[4][0]["class"] == "face"


def test_header_forms(spark):
    df = spark.createDataFrame([('{"info":[{"class":"face","xywh":[0,0,20,20]}]}',), ('[{"class":"plate"}]',), ("{}",)], "t string")
    assert [len(r[0]) for r in df.select(privacy.header_detections(F.col("t"))).collect()] == [1, 1, 0]


def test_metadata_and_sharpness_tables(rows):
    m = [(15.0, 40.0, "gps_inaccurate"), (4.0, 11.0, "low_resolution"), (4.0, 16.0, None), (None, None, None)]
    df = rows([{"gps_accuracy": a, "pixel_density": d, "e": e} for a, d, e in m], "gps_accuracy double, pixel_density double, e string")
    assert all(r[0] == r[1] for r in df.select(metadata_reason(Rules(max_gps_accuracy=10)), "e").collect())
    assert all(r[0] is None for r in df.select(metadata_reason(Rules(min_pixel_density=0))).collect())
    s = [(0.6, 0.5, None, True), (0.5, 0.5, None, True), (0.4, 0.5, None, False), (0.9, 1.0, None, False), (None, 0.5, None, False), (0.40, 0.33, 0.10, True), (0.40, 0.33, 0.30, False), (0.25, 0.33, 0.05, True), (0.10, 0.33, 0.05, False), (0.40, 0.33, None, True)]
    for area, limit, cpbd, expected in s:
        one = rows([{"blurred_area": area, "cpbd": cpbd}], "blurred_area double, cpbd double")
        assert one.select(not_sharp(Rules(max_blurred_area=limit))).first()[0] is expected


def test_commercial_text(spark):
    t = ["Happy hour deals! Buy now, 2 for 10 eur", "4 days 3 nights, half board, $100 $200 $300", "call +32 470 12 34 56", "a quiet street", None]
    got = [r["strength"] for r in texts.with_evidence(spark.createDataFrame([(x,) for x in t], "text string")).collect()]
    assert got[0] >= 0.45 and got[1] >= 0.45 and got[2] < 0.45 and got[3] == 0 and got[4] == 0


def test_advert_decisions(spark):
    nan = float("nan")
    cases = [(0.15, 0.09, True, 0, 0.0, 0.0, "accept"), (0.05, 0.20, False, 0, 0.0, 0.0, "accept"), (0.10, 0.13, True, 4, 10.0, 0.75, "reject"), (0.06, 0.12, True, 9, 12.0, 0.0, "reject"), (0.10, 0.20, True, 2, 1.0, 0.55, "accept"), (0.03, 0.08, True, 6, 10.0, 0.85, "reject"), (nan, 0.1, True, 9, 9.0, 1.0, "accept")]
    df = spark.createDataFrame(cases, "r double, a double, av boolean, w int, area double, c double, e string")
    e = texts.evidence_score(*[F.col(x) for x in ("r", "a", "av", "w", "area", "c")])
    got = df.select(e.alias("s"), "e").select(texts.advert_decision(F.col("s"))["decision"].alias("d"), "e", "s.score").collect()
    assert [r["d"] for r in got] == [r["e"] for r in got] and got[-1]["score"] is None and got[1]["score"] > 90
    with pytest.raises(ValueError):
        texts.advert_decision(F.col("s"), 75)


def test_ocr_table_keeps_words_after_a_quote(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    tsv = head + '\n5\t1\t1\t1\t1\t1\t0\t0\t50\t20\t90\tsale"\n5\t1\t1\t1\t1\t2\t0\t0\t50\t20\t96\tnow\n5\t1\t1\t1\t1\t3\t0\t0\t5\t2\t20\tnoise\nbroken'
    r = texts.with_ocr_evidence(spark.createDataFrame([(tsv, 100, 100), (None, 1, 1)], "t string, w int, h int"), "t", "w", "h").collect()
    assert (r[0]["words"], r[0]["text_area_percent"], r[0]["available"]) == (2, 20.0, True) and r[0]["offer"] == ["sale"]
    assert (r[1]["words"], r[1]["available"]) == (0, False)


def test_summary_order_and_tags(rows):
    schema = "id string, collection string, rank int, position int, camera string, quality_score double, excluded string, issues array<string>, instance_api string, model string"
    r = [{"id": f"a{i}", "collection": "dashcam", "position": i, "camera": "cam", "quality_score": 0.44, "issues": []} for i in range(12)]
    r += [{"id": f"b{i}", "collection": "phone", "position": 50 + i, "camera": "p", "quality_score": 0.75, "issues": []} for i in range(12)] + [{"id": "n", "quality_score": 0.1, "position": 99}]
    r[12] |= {"excluded": "wavy", "issues": ["wavy", "x"], "instance_api": "https://i/api", "model": "m"}
    df = rows(r, schema)
    assert [tuple(x) for x in summary.sequence_summary(df).collect()] == [("dashcam", 12, 0.44, 0, "cam"), ("phone", 12, 0.75, 1, "p")]
    tags = summary.tag_payload(df).orderBy("at").collect()
    assert [t["key"] for t in tags] == ["street_view_quality", "detection_model[street_view_quality=wavy]", "street_view_quality", "detection_model[street_view_quality=x]"]
    assert df.select(summary.script_json(F.lit("</script>"))).first()[0] == "<\\/script>"


def test_upsert_natural_order_and_stems(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "id string, x int, y int")
    new = spark.createDataFrame([("b", None, 9), ("c", 3, 8)], "id string, x int, z int")
    assert sorted(tuple(r) for r in ingest.upsert(old, new).collect()) == [("a", 1, 1, None), ("b", None, 2, 9), ("c", 3, None, 8)]
    names = spark.createDataFrame([("img10.jpg",), ("img9.jpg",), ("IMG1.jpg",)], "n string")
    assert [r[0] for r in names.orderBy(ingest.natural_key(F.col("n"))).collect()] == ["IMG1.jpg", "img9.jpg", "img10.jpg"]
    assert names.select(ingest.file_stem(F.lit("/a/b.c/d.tar.gz"))).first()[0] == "d.tar"
    with pytest.raises(ValueError):
        ingest.parse_bbox("1,2,3")


def test_samples(spark):
    df = spark.createDataFrame([(f"{c}{i}", c, "area") for c in "abc" for i in range(20)], "id string, seq string, area string")
    assert sampling.one_per_sequence(df, "seq").count() == 3
    assert sampling.one_per_sequence(df, "seq", df.filter("seq = 'a'"), 1).count() == 1
    got = sampling.capped(df, "area", "seq", 4, 10)
    assert got.count() == 10 and got.groupBy("seq").count().agg(F.max("count")).first()[0] <= 4


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, vector array<float>")
    assert [r[0] for r in df.orderBy("id").select(vectors.norm(F.col("vector"))).collect()] == [5.0, 0.0]
    assert df.filter("id = 1").select(vectors.cosine(F.col("vector"), F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == pytest.approx(1)
    views = spark.createDataFrame([([(270, 0.9), (90, 0.8), (0, 0.99)],), ([(90, 0.8), (0, 0.7)],)], "v array<struct<rotation:int,confidence:double>>")
    assert [(r[0]["rotation"], r[0]["confidence"]) for r in views.select(vectors.second_best_rotated(F.col("v"))).collect()] == [(90, 0.8), (0, 0.7)]
