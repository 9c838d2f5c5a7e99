"""Near pairs by signatures against all pairs; lookbacks and facts against plain versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomspark.functions.text import tokens
from loomspark.operators import graph, joins, retrieval


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)


def test_near_pairs_find_what_all_pairs_find(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 24))
    rows = np.vstack([base, base[:80] + rng.normal(size=(80, 24)) * 0.15, np.repeat(base[5:6], 30, axis=0) + rng.normal(size=(30, 24)) * 0.05])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    table = vectors(spark, enumerate(rows))
    sims = rows @ rows.T
    want = {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if round(float(sims[a, b]), 6) >= 0.9}
    for bucket in (retrieval.BUCKET, 1):  # 1: crowded buckets are dealt into blocks
        monkeypatch.setattr(retrieval, "BUCKET", bucket)
        got = retrieval.near_pairs(table, 0.9).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(retrieval, "BUCKET", 1)
    bits, n_tables = retrieval.bands(len(rows), 0.9, 1e-6)
    assert retrieval.candidate_pairs(table, bits, n_tables).count() < 0.25 * len(rows) ** 2 / 2
    assert retrieval.bands(10**9, 0.95, 1e-6)[0] >= 16 and retrieval.bands(10**9, 0.1, 1e-6) is None
    assert {(r.a, r.b) for r in retrieval.near_pairs(table, 0.3).collect()} == {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if round(float(sims[a, b]), 6) >= 0.3}


def test_near_pairs_of_copies_and_nothing(spark):
    table = vectors(spark, [(3, [1, 0]), (1, [1, 0]), (2, [1, 0]), (7, [0, 1]), (9, [0.6, 0.8])])
    table = table.union(spark.createDataFrame([(11, None), (12, [])], table.schema))
    assert sorted((r.a, r.b, r.sim) for r in retrieval.near_pairs(table, 0.7).collect()) == [(1, 2, 1.0), (1, 3, 1.0), (7, 9, 0.8)]
    assert retrieval.near_pairs(table.where("false"), 0.7).collect() == []


def test_shortlist_looks_back_a_day(spark):
    rng = random.Random(3)
    items = spark.createDataFrame([(1, "alpha beta gamma", 0.0)], "key long, text string, ts double")
    turns = [(i, "alpha beta again", float(rng.randint(0, 4 * 86400))) for i in range(120)]
    said = [(None, float(rng.randint(0, 4 * 86400))) for _ in range(25)] + [(99, turns[0][2]), (98, turns[1][2] - 86400.0)]
    got = joins.shortlist(items, spark.createDataFrame(turns, "turn_id long, text string, at double"), spark.createDataFrame(said, "key long, at double"), tokens(F.col("text"), 4)).collect()
    want = set()
    for i, _, at in turns:
        back = [s for _, s in said if at - 86400 < s <= at]
        if len(back) < 6 and (not back or at - max(back) >= 900):
            want.add(i)
    assert {r.turn_id for r in got} == want and 0 < len(want) < 120


def test_facts_are_capped_before_texts_meet_them(spark):
    rng = random.Random(4)
    nodes = [(f"n{i}", rng.randint(1, 9)) for i in range(8)]
    edges = [(f"n{rng.randint(0, 7)}", rng.choice(["likes", "near"]), f"n{rng.randint(0, 7)}", rng.randint(1, 5)) for _ in range(120)]
    texts = [(k, " ".join(rng.sample([n for n, _ in nodes], 4))) for k in range(10)]
    got = graph.context(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(nodes, "label string, mentions long"), spark.createDataFrame(edges, "src string, rel string, dst string, weight long")).collect()
    for k, t in texts:
        met = sorted((n for n in nodes if n[0] in t.split()), key=lambda n: (-n[1], n[0]))[:6]
        best = {}
        for s, r, d, w in edges:
            ranks = [i for i, n in enumerate(met) if n[0] in (s, d)]
            if ranks:
                fact = f"{s} {r} {d}"
                rn, weight = best.get(fact, (99, 0))
                best[fact] = (min(rn, *ranks), max(weight, w))
        want = [f for f, _ in sorted(best.items(), key=lambda x: (x[1][0], -x[1][1], x[0]))][:12]
        assert [r.fact for r in sorted((r for r in got if r.id == k), key=lambda r: r.place)] == want


def test_recent_topics(spark):
    rng = random.Random(5)
    words = ["alpha", "bravo", "gamma", "delta", "sigma", "omega"]
    rows = [(i, " ".join(rng.sample(words, rng.randint(1, 4))), float(rng.randint(0, 60 * 86400))) for i in range(80)] + [(100, None, 5.0), (101, "alpha bravo", 5.0), (102, "alpha bravo", 5.0)]
    df = spark.createDataFrame(rows, "id long, text string, at double")
    got = {r.id for r in joins.recent_topics(df, "id", "at", tokens(F.col("text"), 4)).collect()}
    want = set()
    for i, t, at in rows:
        for j, u, before in rows:
            a, b = set((t or "").split()), set((u or "").split())
            if (before, j) < (at, i) and at - before <= 14 * 86400 and len(a & b) >= 2 and len(a & b) >= 0.8 * min(len(a), len(b)) - 1e-9:
                want.add(i)
    assert got == want and 102 in got and 101 not in want - {101}
