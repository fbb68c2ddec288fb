"""Near copies with equal hashes, resembling references, long chains and many blocks."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

from curbline.operators import dedupe
from curbline.plans import catalog
from test_operators import greedy


def copies(spark, folder):
    """60 vectors of 20 pictures, each noisy by a few cells, with copies, a null vector and one with a null in it."""
    r = random.Random(3)
    base = [[r.random() for _ in range(64)] for _ in range(20)]
    rows = []
    for i in range(60):
        v = list(r.choice(base))
        for _ in range(r.choice([0, 0, 6, 12])):
            v[r.randrange(64)] = r.random()
        rows.append((i, v, 0))
    rows += [(60, None, 0), (61, [None, *base[0][1:]], 0), (62, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"file://{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name", ["near_duplicates_pairs", "dedupe_greedy"])
def test_queries_with_equal_hashes(spark, tmp_path, name):
    duck = copies(spark, tmp_path)
    expected = duck.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, f"file://{tmp_path}").select(*expected.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected.fetchall(), key=repr)
    assert name != "near_duplicates_pairs" or any(x["distance"] == 0 for x in got)


def test_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "SMALL", 10)
    monkeypatch.setattr(dedupe, "BLOCK", 25)
    r = random.Random(5)
    rows = [(i, r.choice([-1, 5, r.getrandbits(63), r.getrandbits(10)])) for i in range(400)] + [(400, None), (None, 5), (7, 5)]
    got = [tuple(x) for x in dedupe.near_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", 6).collect()]
    good = [(i, h) for i, h in rows if i is not None and h is not None]
    expected = [(i, j, d) for i, h in good for j, g in good if i < j and (d := bin((h ^ g) & (2**64 - 1)).count("1")) <= 6]
    assert sorted(got) == sorted(expected) and len(got) > 1000


@pytest.mark.parametrize("block", [7, 40, 32768])
def test_references_that_resemble_each_other(spark, monkeypatch, block):
    """The first seen picture counts, also where a later reference has the very hash but other bytes."""
    if hasattr(dedupe, "BLOCK"):
        monkeypatch.setattr(dedupe, "BLOCK", block)
    r = random.Random(6)
    one = lambda: r.choice([0, 2**40 - 1, -1]) ^ (r.getrandbits(62) & r.getrandbits(62) & r.getrandbits(62) & r.getrandbits(62))
    data, ref = ([(i, f"{kind}{i}", one()) for i in range(n)] for kind, n in (("mine", 100), ("ref", 30)))
    data += [(100 + i, f"again{i}", h) for i, _, h in ref]
    schema = "position long, sha1 string, dhash long"
    got = dedupe.drop_duplicates(spark.createDataFrame(data, schema), spark.createDataFrame(ref, schema), max_distance=9)
    expected = greedy(data, 9, [(i - len(ref), s, h) for i, s, h in ref])
    assert {x["position"]: (x["duplicate_of"], x["kept"]) for x in got.collect()} == {p: (d, d is None) for p, d in expected.items()}


def test_rounds_do_not_grow_with_a_chain(spark, monkeypatch):
    """Each picture resembles only those next to it, so every verdict hangs on the one before."""
    writes = []
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (writes.append(path), parquet(self, path, *a, **b))[1])
    data = [(i, f"sha{i}", (1 << i) - 1) for i in range(40)]
    got = dedupe.drop_duplicates(spark.createDataFrame(data, "position long, sha1 string, dhash long"), max_distance=1)
    assert {x["position"]: x["duplicate_of"] for x in got.collect()} == {i: None if i % 2 == 0 else i - 1 for i in range(40)}
    assert len(writes) < 10
