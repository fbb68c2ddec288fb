import pytest
from pyspark.sql import functions as F

from curbline.operators.rules import Rules
from curbline.operators.verdict import judge, judge_again
from curbline.schema import PICTURE

SCHEMA = ", ".join(f"{c} {PICTURE[c]}" for c in ("id", "collection", "rank", "is_pano", "quality_score", "blurred_area", "cpbd", "pixel_density", "gps_accuracy", "privacy_blur", "orientation", "orientation_confidence", "orientation_views", "waviness_label", "ad_rejected", "issues", "context_fetched")) + ", excluded string, low_quality boolean"


def sequence(n, name="s", **base):
    return [{"id": f"{name}{i}", "collection": name, "rank": i, **base} for i in range(n)]


def verdicts(df):
    return {r["id"]: r["excluded"] for r in df.select("id", "excluded").collect()}


def test_all_cases_in_one_plan(rows):
    cases = []
    haze = sequence(21, "haze", quality_score=0.40, blurred_area=0.11)
    haze[10] |= {"quality_score": 0.42, "blurred_area": 0.14}
    blur = sequence(5, "blur", quality_score=0.6, blurred_area=0.28)
    blur[2]["blurred_area"] = 0.35
    drop5 = sequence(5, "drop", quality_score=0.63)
    drop5[2]["quality_score"] = 0.43
    drop3 = sequence(3, "few", quality_score=0.74)
    drop3[1]["quality_score"] = 0.60
    pano = sequence(5, "pano", quality_score=0.49, is_pano=True)
    pano[2]["quality_score"] = 0.42
    low = sequence(5, "low", quality_score=0.30)
    for c in (haze, blur, drop5, drop3, pano, low):
        cases += c
    cases += [{"id": "dull", "quality_score": 0.42}, {"id": "night", "quality_score": 0.33}, {"id": "a38", "quality_score": 0.38}, {"id": "p40", "quality_score": 0.40, "is_pano": True}, {"id": "two", "collection": "pair", "rank": 1, "quality_score": 0.38}]
    hard = {"density": {"pixel_density": 11.0}, "privacy": {"privacy_blur": 0.09}, "turned": {"orientation": 180, "orientation_confidence": 0.999}, "area": {"blurred_area": 0.65}, "both": {"blurred_area": 0.40, "cpbd": 0.08}, "soft": {"blurred_area": 0.25, "cpbd": 0.05}, "clean": {"blurred_area": 0.36, "cpbd": 0.25}, "ad": {"ad_rejected": True}, "edge": {"privacy_blur": 0.05}}
    cases += [{"id": k, "quality_score": 0.9, **v} for k, v in hard.items()]
    got = verdicts(judge(rows(cases, SCHEMA)))
    assert got["haze10"] is None and got["blur2"] == "not_sharp" and got["drop2"] == "sequence_outlier" and got["few1"] == "sequence_outlier"
    assert got["pano2"] is None and {got[f"low{i}"] for i in range(5)} == {"low_quality"}
    assert (got["dull"], got["night"], got["a38"], got["p40"], got["two"]) == (None, "low_quality", "low_quality", None, "low_quality")
    assert {k: got[k] for k in hard} == {"density": "low_resolution", "privacy": "privacy_blur", "turned": "wrong_orientation", "area": "not_sharp", "both": "not_sharp", "soft": "not_sharp", "clean": None, "ad": "advertisement", "edge": None}


def test_neighbours_by_rank_distance_and_slab_borders(rows):
    df = rows(sequence(30, quality_score=0.5), SCHEMA)
    for slab in (7, 4096):
        from curbline.operators.context import neighbourhood

        n = {r["id"]: r["n"] for r in neighbourhood(df, 10, ("quality_score",), slab).select("id", F.size("__near").alias("n")).collect()}
        assert n == {f"s{i}": sum(1 for j in range(30) if j != i and abs(i - j) <= 10) for i in range(30)}
    assert judge(df).filter("id = 's25'").first()["context"]["neighbours"] == 14


def test_equal_ranks_are_neighbours(rows):
    df = rows([{"id": "a", "collection": "c", "rank": 1}, {"id": "b", "collection": "c", "rank": 1}, {"id": "c", "collection": "c", "rank": 40}], SCHEMA)
    from curbline.operators.context import neighbourhood

    assert {r["id"]: r["n"] for r in neighbourhood(df, 10, ("cpbd",)).select("id", F.size("__near").alias("n")).collect()} == {"a": 1, "b": 1, "c": 0}


@pytest.mark.parametrize(("wavy", "share", "expected"), [(4, 0.30, None), (6, 0.30, "wavy"), (6, 1.5, None)])
def test_wavy_needs_neighbours(rows, wavy, share, expected):
    r = sequence(21, quality_score=0.6, waviness_label="no_strong_evidence")
    r[10]["waviness_label"] = "wavy"
    for i in range(wavy):
        r[i]["waviness_label"] = "wavy"
    assert verdicts(judge(rows(r, SCHEMA), Rules(min_wavy_neighbours=share)))["s10"] == expected


def test_idempotent_and_stale_issues(rows):
    r = sequence(5, quality_score=0.63)
    r[2] |= {"quality_score": 0.43, "issues": ["low_quality", "by_hand"]}
    once = judge(rows(r, SCHEMA))
    assert once.filter("id = 's2'").first()["issues"] == ["by_hand", "sequence_outlier"]
    key = lambda df: sorted((x["id"], x["excluded"], tuple(x["issues"]), x["low_quality"]) for x in df.collect())
    assert key(once) == key(judge(once))


def test_frozen_rows_keep_their_verdict(rows):
    r = sequence(5, quality_score=0.63)
    r[2] |= {"quality_score": 0.43, "context_fetched": True, "excluded": "kept_by_hand", "issues": ["kept_by_hand"]}
    assert verdicts(judge_again(rows(r, SCHEMA)))["s2"] == "kept_by_hand"


def test_views_rule(rows):
    views = lambda *v: [(r, c) for r, c in v]
    r = [{"id": "1", "orientation_views": views((270, 0.999), (90, 0.995), (0, 0.9), (180, 0.6))}, {"id": "2", "orientation_views": views((0, 0.999), (90, 0.997), (0, 0.99), (0, 0.98))}, {"id": "3", "orientation_views": views((270, 0.98), (270, 1.0), (180, 0.97), (90, 0.98))}, {"id": "4", "orientation_views": [], "orientation": 180, "orientation_confidence": 0.995}]
    assert verdicts(judge(rows(r, SCHEMA))) == {"1": "wrong_orientation", "2": None, "3": None, "4": "wrong_orientation"}


def test_empty_table_and_missing_columns(spark):
    empty = spark.createDataFrame([], "id string")
    assert judge(empty).count() == 0
    assert verdicts(judge(spark.createDataFrame([("x",)], "id string"))) == {"x": None}
