"""Greedy choices over pairs against a loop in id order, in one block and in many."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomspark.operators import greedy


def neighbours(pairs):
    near = defaultdict(dict)
    for a, b, s in pairs:
        near[a][b] = near[b][a] = s
    return near


def plain_clusters(pairs, most, least, alone=()):
    near, used, out = neighbours(pairs), set(), set()
    for x in sorted(set(near) | set(alone)):
        if x in used:
            continue
        members = sorted(((-s, y) for y, s in near[x].items() if y not in used))[: most - 1]
        if len(members) + 1 >= least or x in alone:
            used |= {x, *(y for _, y in members)}
            out |= {(x, x, 1.0), *((x, y, -s) for s, y in members)}
    return out


def plain_losers(pairs, priority):
    gone = set()
    for a, b, _ in sorted(pairs):
        if a not in gone and b not in gone:
            gone.add(a if priority[b] > priority[a] else b)
    return gone


def graph(rng, n, edges):
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(edges)}
    return [(a, b, round(rng.uniform(0.4, 1), 1)) for a, b in sorted(pairs)]


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_greedy_on_random_graphs(spark, monkeypatch, block):
    monkeypatch.setattr(greedy, "EDGES", block)
    rng = random.Random(block)
    pairs = graph(rng, 120, 170) + [(200 + i, 201 + i, 0.9) for i in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long, sim double").repartition(4)
    nodes = [(i, rng.randint(0, 3), i % 7 == 0) for i in [*range(120), *range(200, 261), 300, 301]]
    table = spark.createDataFrame(nodes, "node long, priority int, alone boolean")
    alone = {i for i, _, x in nodes if x}
    for most, least, given in ((8, 2, None), (5, 2, table), (8, 3, None), (3, 3, None)):
        got = {(r.seed, r.member, r.sim) for r in greedy.greedy_clusters(df, most, least, given).collect()}
        assert got == plain_clusters(pairs, most, least, alone if given is not None else ())
    first = greedy.greedy_clusters(df, 8, 2, clusters=3).collect()
    assert {(r.seed, r.member, r.sim) for r in first} == {r for r in plain_clusters(pairs, 8, 2) if r[0] in sorted({x[0] for x in plain_clusters(pairs, 8, 2)})[:3]}
    gone = [r.vec_id for r in greedy.drop_near_duplicates(df, table.withColumnRenamed("node", "vec_id")).collect()]
    assert len(gone) == len(set(gone)) and set(gone) == plain_losers(pairs, {i: p for i, p, _ in nodes})


def test_greedy_on_one_component_of_a_hundred_thousand_nodes(spark, monkeypatch):
    monkeypatch.setattr(greedy, "EDGES", 1 << 15)
    rng = random.Random(1)
    order = list(range(100_000))
    rng.shuffle(order)
    pairs = [(*sorted((order[i], order[rng.randrange(max(0, i - 50), i)])), round(rng.uniform(0.4, 1), 3)) for i in range(1, len(order))]
    df = spark.createDataFrame(pairs, "a long, b long, sim double")
    assert {(r.seed, r.member, r.sim) for r in greedy.greedy_clusters(df, 6).collect()} == plain_clusters(pairs, 6, 2)


def test_greedy_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, sim double")
    assert greedy.greedy_clusters(none).collect() == []
    assert greedy.drop_near_duplicates(none, spark.createDataFrame([(1, 2)], "vec_id long, priority int").where(F.lit(False))).collect() == []
    same = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (2, 1, 0.7)], "a long, b long, sim double")
    assert {tuple(r) for r in greedy.greedy_clusters(same).collect()} == {(1, 1, 1.0), (1, 2, 0.7)}


def dense(monkeypatch, seed):
    """Pairs of a dense table in some 40 blocks that wait for each other, and the tables written so far."""
    written, plain = [], greedy._written
    monkeypatch.setattr(greedy, "EDGES", 1000)
    monkeypatch.setattr(greedy, "_written", lambda df: (written.append(df), plain(df))[1])
    return graph(random.Random(seed), 400, 25_000), written


def test_clusters_of_a_dense_table_take_few_rounds(spark, monkeypatch):
    pairs, written = dense(monkeypatch, 1)
    got = greedy.greedy_clusters(spark.createDataFrame(pairs, "a long, b long, sim double").repartition(4))
    assert {(r.seed, r.member, r.sim) for r in got.collect()} == plain_clusters(pairs, 8, 2) and len(written) < 30


def test_losers_of_a_dense_table_take_few_rounds(spark, monkeypatch):
    pairs, written = dense(monkeypatch, 2)
    nodes = spark.createDataFrame([(i, i * 7 % 10) for i in range(400)], "vec_id long, priority int")
    gone = [r.vec_id for r in greedy.drop_near_duplicates(spark.createDataFrame(pairs, "a long, b long, sim double").repartition(4), nodes).collect()]
    assert len(gone) == len(set(gone)) and set(gone) == plain_losers(pairs, {i: i * 7 % 10 for i in range(400)}) and len(written) < 40


def test_themes_of_a_dense_table_take_few_rounds(spark, monkeypatch):
    pairs, written = dense(monkeypatch, 3)
    got = greedy.greedy_clusters(spark.createDataFrame(pairs, "a long, b long, sim double").repartition(4), 6, 3)
    assert {(r.seed, r.member, r.sim) for r in got.collect()} == plain_clusters(pairs, 6, 3) and len(written) < 40
