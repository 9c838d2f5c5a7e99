"""Importance resampling, neighbour graphs and token alignment against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F
from test_llm import CLASHING, KIND, ROWS

from loomspark.llm import alignment, importance, neighbours, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def awkward(spark):
    more = [(None, "a text without an id " * 9, "a", "en"), (19, " leading space", "a", "en"), (20, "x" * 900, "a", "en"), (21, "ﬁ ① ｆｕｌｌ", "a", "en"), (22, "<s> <unk> <|endoftext|>▁", "a", "en"), (15, "a b c " * 40, "d", "en")]
    df = spark.createDataFrame([(i, t, s, g, len(t or "")) for i, t, s, g in ROWS + more], KIND)
    for c in (*CLASHING, "row", "pair", "n_words", "place", "id"):
        df = df.withColumn(c, F.lit("other"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def resampled_plainly(docs, target, percent=25):
    """Rows (doc_id, n_features, weight, score, rank) for [(doc_id, text)] and texts."""

    def buckets(text):
        w = brute.ALNUM.findall((text or "").translate(brute.LOWER))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    made = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for *_, bs in made for b in bs), Counter(b for x in target for b in buckets(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    rows = []
    for i, n, bs in made:
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = rank + 1
    return Counter(tuple(r[:5]) for r in rows)


def test_resampling(spark, awkward, empty, folder, monkeypatch):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    target = [r.text for r in bench.collect()]
    small = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    for docs in (awkward, small):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = importance.resample(docs, bench).drop("n_words").collect()
        assert Counter(map(tuple, got)) == resampled_plainly(texts, target)
    monkeypatch.setattr(importance, "PIECE", 7)
    monkeypatch.setattr(importance, "BLOCK", 100)
    assert Counter(map(tuple, importance.resample(docs, bench).drop("n_words").collect())) == resampled_plainly(texts, target)
    assert importance.resample(empty, bench).collect() == []
    assert Counter(map(tuple, importance.resample(awkward, empty.select("text")).drop("n_words").collect())) == resampled_plainly(odd, [])
    drawn = importance.resampled(small, bench)
    assert drawn.columns == small.columns
    assert {r.doc_id for r in drawn.collect()} == {r.doc_id for r in got if r.rank}


def test_resampling_agrees_with_sql(spark, folder):
    assert differences(queries.op11_resampling(spark, folder), connect(folder), queries.OP11_SQL) == ""


def test_summed_gains_in_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(importance, "PIECE", 16)
    for _ in range(50):
        n = rng.integers(0, 40, rng.integers(1, 20))
        stream, gains = rng.integers(0, 50, n.sum()).astype(np.uint16), rng.integers(-900, 900, 50).astype(np.int32)
        ends = np.cumsum(n)
        want = [int(gains[stream[e - k : e]].sum()) for e, k in zip(ends, n)]
        assert importance.summed_gains(stream, ends, gains).tolist() == want


def nearest_plainly(rows, asked, k=20):
    found = {}
    for q, v in asked:
        scores = [(-float(np.dot(np.array(v), np.array(w))), i) for i, w in rows if i != q]
        found[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return found


def by_query(df):
    found = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(found[r.query_id])
    return found


def test_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(6000, 32)).astype(np.float32)
    rows[1500:3000] = rows[7] + rng.normal(size=(1500, 32)) * 0.02  # near copies
    rows[3000:4000] = rows[9]  # equal ones
    rows[4000:4500] *= 3
    listed = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    vectors = spark.createDataFrame(listed, "vec_id long, embedding array<float>").repartition(3)
    asked = [x for x in listed if x[0] % 20 == 0]
    want = nearest_plainly(listed, asked)
    for shard in (8192, 1000):
        got = by_query(neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), shard=shard))
        assert got.keys() == want.keys()
        hits = 0
        for q, found in got.items():
            assert len({i for i, _ in found}) == 20 and q not in {i for i, _ in found}
            assert found == sorted(found, key=lambda x: (-x[1], x[0]))
            assert all(s == pytest.approx(float(np.dot(rows[q].astype(float), rows[i].astype(float))), rel=1e-12) for i, s in found)
            # a vector as near as the last of the true ones is as good
            hits += sum(s >= want[q][-1][1] - 1e-9 for _, s in found)
        assert hits >= 0.9 * 20 * len(want)
        for q in (3000, 3020, 3980):  # equal vectors come by id
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    kind = "vec_id long, embedding array<double>, label string, shard string, q string"
    fine = [(i, rng.normal(size=int(rng.integers(3, 6))).tolist()) for i in range(70)] + [(70, [1e200, 1e-200]), (71, [-0.0, 0.0, 2.0])]
    bad = [(80, None), (100, [0.0, -0.0]), (120, []), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0]), (180, [float("inf")]), (None, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in fine + bad], kind).repartition(2)
    padded = [(i, np.array(v + [0.0] * (5 - len(v)))) for i, v in fine]
    want = nearest_plainly(padded, [x for x in padded if x[0] % 20 == 0])
    for shard in (1000, 9):
        got = by_query(neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), shard=shard))
        assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.9, 0.0]), (2, [0.9, 0.0])], "vec_id long, embedding array<double>")
    assert by_query(neighbours.nearest_neighbours(few, few.where("vec_id = 0"))) == {0: [(2, 0.9), (2, 0.9), (1, 0.5)]}
    none = few.where("false")
    assert neighbours.nearest_neighbours(none, none).collect() == [] and neighbours.nearest_neighbours(few, none).collect() == []


def test_every_node_of_a_graph_is_reached():
    rng = np.random.default_rng(4)
    clumps = np.repeat(rng.normal(size=(6, 16)), 60, axis=0) + rng.normal(size=(360, 16)) * 1e-4
    graph = neighbours.Graph.build(clumps)
    links, met, todo = graph.levels[0][1], {0}, [0]
    while todo:
        for n in links[todo.pop()].tolist():
            if n >= 0 and n not in met:
                met.add(n), todo.append(n)
    assert len(met) == 360


def aligned_plainly(texts):
    """doc -> (n_a, n_b, groups, links [(a, b)]) for texts, by walking both token lists."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    own_a, own_b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    own_a.encode_special_tokens = True
    byte_of = alignment._byte_of()

    def bytes_b(i):
        piece = own_b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    for text in texts:
        groups, links = [], []
        data = f" {text}".encode()
        ids_a, ids_b = (own_a.encode(" " + text, add_special_tokens=False).ids, own_b.encode(text)) if text else ([], [])
        said_a = [bytes(byte_of[c] for c in own_a.id_to_token(i)) for i in ids_a]
        said_b = [bytes_b(i) for i in ids_b]
        if not text or b"".join(said_a) != data or b"".join(said_b) != data:
            yield 0, 0, [], []
            continue
        i = j = end_a = end_b = 0
        one = [[], []]
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b and i < len(ids_a):
                one[0].append(ids_a[i])
                end_a += len(said_a[i])
                i += 1
            else:
                one[1].append(ids_b[j])
                end_b += len(said_b[j])
                j += 1
            if end_a == end_b:
                groups.append(one)
                links.append((one[0][-1], one[1][-1]))
                one = [[], []]
        yield len(ids_a), len(ids_b), groups, links


def check_alignment(docs):
    rows = docs.select("doc_id", "text").collect()
    plain = list(aligned_plainly([r.text for r in rows]))
    counts = Counter(x for *_, links in plain for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = Counter()
    for r, (n_a, n_b, groups, links) in zip(rows, plain):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        want[(r.doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha)] += 1
    assert Counter(map(tuple, alignment.align_tokens(docs, A, B).collect())) == want
    assert {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(docs, A, B).collect()} == counts
    groups = Counter((r.doc_id, repr([(list(g.a), list(g.b)) for g in r.groups])) for r in alignment.aligned_groups(docs, A, B).collect())
    assert groups == Counter((r.doc_id, repr([(a, b) for a, b in p[2]])) for r, p in zip(rows, plain))


def test_alignment(spark, awkward, empty, folder, monkeypatch):
    check_alignment(awkward)
    monkeypatch.setattr(alignment, "FREQUENT", 200)
    monkeypatch.setattr(alignment, "GATHERED", 100)
    monkeypatch.setattr(alignment, "TOGETHER", 500)
    check_alignment(spark.read.parquet(f"{folder}/documents.parquet"))
    assert alignment.align_tokens(empty, A, B).collect() == []


def test_ranked_merges_are_the_tokenizer_s_own():
    tok = alignment.ByteLevel(A)
    assert tok.fast is not None
    rng = random.Random(6)
    usual = [chr(c) for c in range(0x180) if not alignment._UNUSUAL.search(chr(c))]
    for _ in range(3000):
        text = "".join(rng.choice(usual) if rng.random() < 0.4 else rng.choice(["the", "ing", " ", "'s", "'ll", "\n\n", "12", "é", "  ", "<|endoftext|>"]) for _ in range(rng.randint(1, 30)))
        assert tok.encode(text).tolist() == tok.own.encode(text, add_special_tokens=False).ids


def test_components_of_random_cuts():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.append(np.flatnonzero(rng.random(n - 1) < rng.random()) + 1, n) for _ in range(2)]
        common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        got = alignment.components_of(*ends)
        for side in (0, 1):
            assert got[side].tolist() == [sum(c < e for c in common) for e in ends[side].tolist()]
