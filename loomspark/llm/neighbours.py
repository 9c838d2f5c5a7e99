"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, stored as flat neighbour arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Vectors in a shard, about; what a task holds.
SHARD = 1 << 14
#: Links a node keeps on upper levels and on the ground, nearest ones that are weighed for them, width of the search.
LINKS, GROUND, WEIGHED, WIDTH, ENTRIES = 16, 32, 64, 96, 16
#: Queries in a block, and those searched side by side; nodes linked side by side.
BLOCK, SIDE, BESIDE = 1 << 10, 256, 512


class Graph:
    """A layered graph over a shard's distinct vectors.

    The inner product of unequally long vectors isn't a metric, so the graph is
    built in one dimension more, which makes all vectors equally long without
    changing products with queries. Equal vectors are one node, which keeps the
    smallest `members` ids of them. levels holds, per level, the nodes on it
    and a flat array of their neighbours, -1 where there are fewer.
    """

    def __init__(self, points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.points, self.levels = points, levels

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 42) -> Graph:
        points = lifted(vectors)
        n = len(points)
        rng = np.random.default_rng(seed)
        height = np.floor(-np.log(rng.random(n) + 1e-300) / math.log(LINKS)).astype(np.int64)
        if n:
            height[0] = height.max()  # one node is on every level
        levels = []
        for level in range(int(height.max(initial=0)) + 1):
            nodes = np.flatnonzero(height >= level).astype(np.int32)
            levels.append((nodes, linked(points[nodes], GROUND if level == 0 else LINKS, rng)))
        return cls(points, levels)

    def search(self, queries: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, nearness) of the best `width` that each query meets on its way down; -1 and -inf where there are fewer."""
        longest = np.maximum(np.abs(queries).max(axis=1, initial=0, keepdims=True), 1e-300)
        queries = np.hstack([queries / longest, np.zeros((len(queries), 1))]).astype(np.float32)
        n = len(self.points)
        if n <= width:  # the beam holds all
            return np.broadcast_to(np.arange(n), (len(queries), n)), queries @ self.points.T
        entry = np.zeros((len(queries), 1), np.int64)
        for nodes, links in reversed(self.levels[1:]):
            at = np.searchsorted(nodes, entry)
            found, _ = beam(self.points[nodes], links, queries, at, min(ENTRIES, len(nodes)), 2)
            entry = nodes[np.where(found < 0, found[:, :1], found)].astype(np.int64)
        return beam(self.points, self.levels[0][1], queries, entry, width, 4)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled by the longest one, with the coordinate that makes them equally long."""
    scaled = vectors / max(np.abs(vectors).max(initial=0), 1e-300)
    norms = (scaled * scaled).sum(axis=1)
    most = max(norms.max(initial=0), 1e-300)
    return (np.hstack([scaled, np.sqrt(np.maximum(most - norms, 0))[:, None]]) / math.sqrt(most)).astype(np.float32)


def linked(points: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Neighbours of every point: of its nearest ones first those nearer to it than to a neighbour already taken, links back, some at random, and a ring.

    Half of the places are for a point's own choice; links back fill the rest,
    the nearest first, up to the last eighth. The last place is a ring in random
    order through all points, so every point can be reached.
    """
    n = len(points)
    links = np.full((n, most), -1, np.int32)
    if n < 2:
        return links
    weighed = min(WEIGHED, n - 1)
    own = np.empty((n, min(most // 2, weighed)), np.int32)
    near = np.empty(own.shape, np.float32)
    for a in range(0, n, BESIDE):
        b = min(a + BESIDE, n)
        sims = points[a:b] @ points.T
        sims[np.arange(b - a), np.arange(a, b)] = -np.inf
        some = np.argpartition(-sims, weighed - 1, axis=1)[:, :weighed]
        of = np.take_along_axis(sims, some, axis=1)
        order = np.argsort(-of, axis=1, kind="stable")
        some, of = np.take_along_axis(some, order, axis=1), np.take_along_axis(of, order, axis=1)
        among = np.matmul(points[some], points[some].transpose(0, 2, 1))
        hidden = np.full(of.shape, -np.inf, np.float32)  # nearness to the nearest neighbour taken
        apart = np.zeros(of.shape, bool)
        for c in range(weighed):
            apart[:, c] = of[:, c] > hidden[:, c]
            fits = apart[:, c]
            hidden[fits] = np.maximum(hidden[fits], among[fits, c])
        first = np.argsort(~apart, axis=1, kind="stable")[:, : own.shape[1]]  # then those passed over
        own[a:b], near[a:b] = np.take_along_axis(some, first, axis=1), np.take_along_axis(of, first, axis=1)
    src, dst, sim = np.repeat(np.arange(n), own.shape[1]), own.reshape(-1), near.reshape(-1)
    tail, head = np.concatenate([src, dst]), np.concatenate([dst, src])
    back = np.repeat([0, 1], len(src))
    order = np.lexsort((-np.concatenate([sim, sim]), back, head, tail))
    tail, head, back, sim = tail[order], head[order], back[order], np.concatenate([sim, sim])[order]
    once = (np.diff(tail, prepend=-1) != 0) | (np.diff(head, prepend=-1) != 0)
    tail, head, back, sim = tail[once], head[once], back[once], sim[once]
    order = np.lexsort((-sim, back, tail))
    tail, head = tail[order], head[order]
    first = np.flatnonzero(np.diff(tail, prepend=-1))
    place = np.arange(len(tail)) - np.repeat(first, np.diff(first, append=len(tail)))
    kept = place < most - 1 - most // 8
    links[tail[kept], place[kept]] = head[kept]
    # places left over lead anywhere, which keeps clumps of near copies and far-off points within reach
    row, place = np.nonzero(links[:, : most - 1] < 0)
    links[row, place] = rng.integers(0, n, len(row))
    ring = rng.permutation(n)
    links[ring, most - 1] = np.roll(ring, -1)
    return links


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first searches side by side: each opens its `at_once` best unopened nodes until all of its best `width` are open."""
    q, rows = len(queries), np.arange(len(queries))[:, None]
    met = np.zeros((q, len(points) + 1), bool)
    met[:, -1] = True  # where a node has fewer neighbours
    met[rows, entry] = True
    nodes = np.full((q, width), -1, np.int64)
    sims = np.full((q, width), -np.inf, np.float32)
    opened = np.ones((q, width), bool)
    entry = np.sort(entry, axis=1)
    first = np.diff(entry, axis=1, prepend=-1) > 0
    nodes[:, : entry.shape[1]] = entry
    sims[:, : entry.shape[1]] = np.where(first, np.einsum("qd,qnd->qn", queries, points[entry]), -np.inf)
    opened[:, : entry.shape[1]] = ~first
    live = np.arange(q)
    while len(live):
        waiting = np.where(opened[live], -np.inf, sims[live])
        pick = np.argpartition(-waiting, min(at_once, width - 1), axis=1)[:, :at_once]
        worth = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
        going = worth.any(axis=1)
        live, pick, worth = live[going], pick[going], worth[going]
        if not len(live):
            break
        side = live[:, None]
        opened[side, pick] |= worth
        fresh = np.where(worth[:, :, None], links[nodes[side, pick]], -1).reshape(len(live), -1)
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        new = ~met[side, fresh]
        met[side, fresh] = True
        new_sims = np.where(new, np.einsum("qd,qnd->qn", queries[live], points[fresh]), -np.inf)
        all_nodes, all_sims = np.hstack([nodes[live], fresh]), np.hstack([sims[live], new_sims])
        all_opened = np.hstack([opened[live], ~new])
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        nodes[live], sims[live], opened[live] = (np.take_along_axis(x, best, axis=1) for x in (all_nodes, all_sims, all_opened))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(np.where(np.isfinite(sims), nodes, -1), order, axis=1), np.take_along_axis(sims, order, axis=1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of doubles as rows of one matrix; shorter ones end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(set(lengths.tolist())) <= 1:
        return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    made = np.zeros((len(column), lengths.max()))
    row = np.repeat(np.arange(len(column)), lengths)
    made[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return made


def _fitted(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows cut or filled with zeros to a width."""
    made = np.zeros((len(rows), width))
    made[:, : min(width, rows.shape[1])] = rows[:, :width]
    return made


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & fine & some)


_INDEX = "shard int, dims int, ids binary, vectors binary, node_of binary, levels array<struct<nodes:binary,links:binary>>"


def build_index(vectors: DataFrame, shards: int, k: int) -> DataFrame:
    """One row per shard: ids and vectors, the node of every kept row, and per level its nodes and flat neighbour array."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts = None, [], []

        def row() -> pa.RecordBatch:
            own, width = np.concatenate(ids), max(p.shape[1] for p in parts)
            data = np.vstack([_fitted(p, width) for p in parts])
            order = np.argsort(own, kind="stable")
            own, data = own[order], data[order]
            _, first, node = np.unique(data + 0.0, axis=0, return_index=True, return_inverse=True)
            node = node.reshape(-1)
            # of equal vectors the smallest ids are enough: k, and one for the query itself
            line = np.lexsort((np.arange(len(own)), node))
            start = np.flatnonzero(np.diff(node[line], prepend=-1))
            place = np.arange(len(line)) - np.repeat(start, np.diff(start, append=len(line)))
            line = line[place <= k]
            graph = Graph.build(data[first])
            levels = [{"nodes": n.astype("<i4").tobytes(), "links": x.astype("<i4").tobytes()} for n, x in graph.levels]
            kept, node = own[line], node[line]
            made = (int(now), width, kept.astype("<i8").tobytes(), data[first].astype("<f8").tobytes(), node.astype("<i4").tobytes(), levels)
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())]))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, kinds)], names=["shard", "dims", "ids", "vectors", "node_of", "levels"])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else [0]
            for a, b in zip(edge[:-1], edge[1:]):
                if now is not None and shard[a] != now:
                    yield row()
                    ids, parts = [], []
                now = shard[a]
                ids.append(batch.column("vec_id").slice(a, b - a).to_numpy())
                parts.append(_matrix(batch.column("embedding").slice(a, b - a)))
        if now is not None:
            yield row()

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(build, _INDEX)


class _Shard:
    """A shard's graph and rows, read back from its row of the index."""

    def __init__(self, dims: int, ids: bytes, vectors: bytes, node_of: bytes, levels: list[dict]) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        self.vectors = np.frombuffer(vectors, "<f8").reshape(-1, dims)
        node = np.frombuffer(node_of, "<i4")  # rising, as rows stand by node
        self.first = np.searchsorted(node, np.arange(len(self.vectors)))
        self.members = np.diff(self.first, append=len(node))
        nodes = [np.frombuffer(x["nodes"], "<i4") for x in levels]
        links = [np.frombuffer(x["links"], "<i4").reshape(len(n), -1) for n, x in zip(nodes, levels)]
        self.graph = Graph(lifted(self.vectors), list(zip(nodes, links)))

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, inner product in doubles) of the members of the nodes found, the query's own id left out."""
        queries = _fitted(queries, self.vectors.shape[1])
        nodes, _ = self.graph.search(queries)
        exact = np.einsum("qd,qnd->qn", queries, self.vectors[nodes])
        place, at = np.nonzero(nodes >= 0)
        node, score = nodes[place, at], exact[place, at]
        times = self.members[node]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ids = self.ids[np.repeat(self.first[node], times) + inside]
        place, score = np.repeat(place, times), np.repeat(score, times)
        other = ids != own[place]
        return best_of(place[other], ids[other], score[other], k)


def best_of(place: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best, ties to smaller ids."""
    order = np.lexsort((ids, -score, place))
    place, ids, score = place[order], ids[order], score[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    rank = np.arange(len(place)) - np.repeat(first, np.diff(first, append=len(place)))
    kept = rank < k
    return place[kept], ids[kept], score[kept]


def query_blocks(queries: DataFrame) -> DataFrame:
    """Queries packed by the block: a number of its own for the first of them, ids and vectors."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                data = _matrix(part.column("embedding"))
                made = (part.column("q")[0].as_py(), data.shape[1], part.column("vec_id").to_numpy().astype("<i8").tobytes(), data.astype("<f8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["q", "dims", "ids", "vectors"])

    return queries.withColumn("q", F.monotonically_increasing_id()).mapInArrow(pack, "q long, dims int, ids binary, vectors binary")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of vectors found for every row of queries, by inner product.

    Both tables have vec_id and embedding. Vectors are dealt by vec_id to shards
    of about `shard` rows; each shard's graph is built in a task and written, as
    flat arrays, to a row of the index. A query searches every shard: blocks of
    queries go to each group of shards, which merges what its shards find, and
    the groups' results meet by query. So a task holds a group of shards, sixteen
    at most on large inputs, and one block. Scores are exact, on the original vectors; which rows
    are found is approximate, except in shards of up to WIDTH different vectors.

    Vectors that are null, zero, or hold null or infinite components take no
    part, nor do rows with a null vec_id; a query doesn't find rows with its own
    vec_id. Rows repeated in vec_id and vector are found as often as they stand.
    Vectors of unequal length are compared as if the shorter ended in zeros. A
    query gets fewer than k rows only if there are fewer. Empty tables give an
    empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    shards = -(-rows.count() // shard)
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = checkpointed(build_index(rows, shards, k))
    blocks = checkpointed(query_blocks(usable(queries)))
    groups = min(shards, max(spark.sparkContext.defaultParallelism, -(-shards // 16)))
    index = index.select((F.col("shard") % groups).alias("group"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("q"), "dims", "ids", "vectors", "node_of", "levels")
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "q", "dims", "ids", "vectors")
    meet = index.unionByName(asked, allowMissingColumns=True).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "kind", "q")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if row["group"] != group:
                    group, held = row["group"], []
                if row["kind"] == 0:
                    held.append(_Shard(row["dims"], row["ids"], row["vectors"], row["node_of"], row["levels"]))
                    continue
                own = np.frombuffer(row["ids"], "<i8")
                data = np.frombuffer(row["vectors"], "<f8").reshape(len(own), -1)
                for a in range(0, len(own), SIDE):
                    found = [s.nearest(data[a : a + SIDE], own[a : a + SIDE], k) for s in held]
                    place, ids, score = best_of(*(np.concatenate(c) for c in zip(*found)), k)
                    place = place + a
                    columns = (row["q"] + place, own[place], ids, score)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q", "query_id", "vec_id", "score"])

    found = meet.mapInArrow(search, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
