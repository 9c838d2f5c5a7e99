"""Vectors that meet in blocks as matrix products, against plain sums."""

import math

import numpy as np
import pytest
from oracle import connect, differences

from loomspark.operators import retrieval
from loomspark.queries import QUERIES, SQL


def rows_of(seed, n, width, copies):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n // 2 : n // 2 + copies] = v[0]
    return [(i, [float(x) for x in np.float32(e)]) for i, e in enumerate(v)] + [(n, None), (n + 1, [None] * width), (n + 2, [1.0] * (width - 1)), (n + 3, [float("nan")] * width)]


def plain(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return round(s, 6)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAST_BLOCK", 40), ("TILE", 2048), ("AGAIN", 64)):
        monkeypatch.setattr(retrieval, name, value, raising=False)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_similar_pairs_in_tiles(spark, small, kind):
    rows = rows_of(5, 160, 12, 20)
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and (s := plain(a, b)) is not None and (math.isnan(s) or s >= 0.4):
                want[i, j] = s
    df = retrieval.similar_pairs(table, 0.4)
    got = [(r.a, r.b, r.sim) for r in df.collect()]
    assert len(got) == len(want) and {(a, b) for a, b, _ in got} == set(want)
    assert all(s == want[a, b] or math.isnan(s) for a, b, s in got)
    assert "zip_with" not in df._jdf.queryExecution().toString()  # no expression for each pair


def test_cosine_search_with_ties(spark, small, monkeypatch):
    rows = rows_of(6, 200, 12, 90)[:-1]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for size in (retrieval.QUERY_BYTES, 400):
        monkeypatch.setattr(retrieval, "QUERY_BYTES", size)
        df = retrieval.cosine_search(table, table.where("vec_id % 20 = 0"), 4, 0.1)
        want = []
        for i, a in rows:
            if i % 20 == 0:
                near = sorted((-s, j) for j, b in rows if j != i and (s := plain(a, b)) is not None and s > 0.1)
                want += [(i, j, -s) for s, j in near[:4]]
        assert sorted((r.query_id, r.vec_id, r.sim) for r in df.collect()) == sorted(want)
        assert "zip_with" not in df._jdf.queryExecution().toString()
    nothing = table.where("false")
    assert retrieval.cosine_search(table, nothing, 3).collect() == [] == retrieval.cosine_search(nothing, table, 3).collect()


def test_near_pairs_leaves_crowded_signatures(spark, monkeypatch):
    rows = [r for r in rows_of(7, 3000, 32, 1)[:3000]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert retrieval.bands(len(rows), 0.9, 1e-6) is not None
    monkeypatch.setattr(retrieval, "candidate_pairs", None)
    got = {(r.a, r.b) for r in retrieval.near_pairs(table, 0.9).collect()}
    v = np.array([e for _, e in rows])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.round(v @ v.T, 6) >= 0.9)) if a < b}


@pytest.mark.parametrize("copies", [1 << 12, 3])
def test_near_vectors_gives_every_pair_of_copies(spark, tmp_path, monkeypatch, copies):
    monkeypatch.setattr(retrieval, "COPIES", copies)  # 3: copies meet part by part
    rows = rows_of(8, 60, 16, 7)[:60]
    rows += [(100 + i, e) for i, e in rows[:10]] + [(200, [x * 0.99 for x in rows[0][1]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "some"))
    next((tmp_path / "some").glob("part-*")).rename(tmp_path / "embeddings.parquet")
    df = QUERIES["near_vectors"](spark, str(tmp_path))
    assert differences(df, connect(tmp_path), SQL["near_vectors"]) == ""
    assert df.where("a = 30 AND b IN (31, 36, 100, 200)").count() == 4


def test_near_pairs_leaves_no_pair_to_chance(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIR_COST", 0)  # signatures would always pay
    monkeypatch.setattr(retrieval, "signatures", lambda vectors, bits, tables: vectors.selectExpr("vec_id", "0L AS tab", "vec_id AS key"))  # and would miss all pairs
    monkeypatch.setattr(retrieval, "BUCKET", 1)
    rows = rows_of(9, 300, 16, 20)[:300]
    rows += [(1000 + i, [*e[:-1], e[-1] + 0.01]) for i, e in rows[:50]]
    v = np.array([e for _, e in rows])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert retrieval.bands(len(rows), 0.95, 1e-6) is not None and retrieval.near_pairs(table, 0.95, 1e-6).count() == 20
    want = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(np.round(v @ v.T, 6) >= 0.95)) if a < b]
    assert sorted((r.a, r.b) for r in retrieval.near_pairs(table, 0.95, copies=True).collect()) == sorted(want)
