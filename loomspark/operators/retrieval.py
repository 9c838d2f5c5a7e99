"""Retrieval: cosine search, hybrid recall, neighbours, similarity pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import half_life
from ..functions.vectors import dot
from .components import _written
from .windows import top_per_group


#: Bytes of query vectors that a task holds; more go in blocks.
QUERY_BYTES = 1 << 24
#: Vectors in a block at least, if there are several, and at most.
LEAST_BLOCK, BLOCK = 2048, 1 << 17
#: Products that are looked at together, and pairs that are computed again together.
TILE, AGAIN = 1 << 20, 1 << 16


def _blocks(n: int, most: int) -> int:
    """Blocks for n vectors: up to `most`, and more only where blocks would be over BLOCK."""
    return max(1, min(most, -(-n // LEAST_BLOCK)), -(-n // BLOCK))


def _packed(vectors: DataFrame, blocks: int) -> DataFrame:
    """(block, width, single, ids, data): vectors dealt into blocks by their ids, those of a batch and block in one row.

    Vectors that are null or hold nulls have no product and are left out.
    """
    single = "array<float>" in vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, e, block = batch["vec_id"].to_numpy(), batch["embedding"], batch["block"].to_numpy()
            starts, flat = e.offsets.to_numpy(), e.values.to_numpy(zero_copy_only=False)
            wide, out = np.diff(starts), []
            for w in np.unique(wide):
                at = np.flatnonzero(wide == w)
                at = at[np.argsort(block[at], kind="stable")]
                for some in np.split(at, np.flatnonzero(np.diff(block[at])) + 1):
                    out.append((int(block[some[0]]), int(w), ids[some].tobytes(), flat[starts[some][:, None] + np.arange(w)].tobytes()))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "width", "ids", "data"])

    return rows.mapInArrow(run, "block int, width int, ids binary, data binary").withColumn("single", F.lit(single))


def _norms(v: np.ndarray) -> np.ndarray:
    """Lengths of rows; 0 for those that aren't finite."""
    n = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    return np.where(np.isfinite(n), n, 0.0)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of rows one by one, in double precision and in the order of their parts, as dot() adds them."""
    s = np.zeros(len(left))
    for c in range(left.shape[1]):
        s += left[:, c].astype(np.float64) * right[:, c].astype(np.float64)
    return s


#: (ids, vectors) of a left block and of some vectors of a right one, whether both are the same block, and what the cell keeps -> batches of (left index, right index)
Choose = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool, dict], Iterator[tuple[np.ndarray, np.ndarray]]]


def _met(left: DataFrame, right: DataFrame, across: int, cells: int, choose: Choose) -> DataFrame:
    """(l, r, sim): vectors of packed rows with x and y meet cell by cell (x, y); choose() says which pairs are given.

    A task holds one left block and streams the right one past it, so its memory
    has the size of a block. sim isn't rounded; it is added up in order.
    """
    rows = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    kind = "l long, r long, sim double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, kept, waiting, n = None, {}, {}, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*waiting)], ["l", "r", "sim"])

        for batch in batches:
            for i in range(batch.num_rows):
                x, y, side, width, single = (batch[c][i].as_py() for c in ("x", "y", "side", "width", "single"))
                ids = np.frombuffer(batch["ids"][i].as_buffer(), dtype=np.int64)
                data = np.frombuffer(batch["data"][i].as_buffer(), dtype=np.float32 if single else np.float64).reshape(len(ids), width)
                if (x, y) != cell:
                    cell, held, kept = (x, y), {}, {}
                if side == 0:
                    held.setdefault(width, []).append((ids.copy(), data.copy()))
                    continue
                if width not in held:
                    continue
                if isinstance(held[width], list):
                    held[width] = tuple(np.concatenate(c) for c in zip(*held[width]))
                of, with_ = held[width]
                for a, b in choose(of, with_, ids, data, x == y, kept.setdefault(width, {})):
                    waiting.append((of[a], ids[b], _product(with_[a], data[b])))
                    n += len(a)
                    if n >= AGAIN:
                        yield out()
                        waiting, n = [], 0
        if n:
            yield out()

    dealt = rows.repartitionById(cells, (F.col("x") * across + F.col("y")).cast("int")).sortWithinPartitions("x", "y", "side")
    return dealt.mapInArrow(run, kind)


def _best(k: int, floor: float) -> Choose:
    """Pairs that may be among each left vector's k best with another id: by rounded product, then the smaller id."""

    def choose(of: np.ndarray, asked: np.ndarray, ids: np.ndarray, data: np.ndarray, same: bool, kept: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not kept:
            kept["best"] = np.full((k, len(of)), -np.inf)
            kept["asked"] = asked.astype(np.float64)
            kept["norm"] = _norms(asked)
        step = max(1, TILE // len(of))
        for at in range(0, len(ids), step):
            v, own = data[at : at + step].astype(np.float64), ids[at : at + step]
            s = v @ kept["asked"].T
            s[np.isnan(s)] = np.inf  # NaN comes first, as in SQL
            for i in np.flatnonzero(np.isin(own, of)):
                s[i, of == own[i]] = -np.inf
            kept["best"] = np.partition(np.concatenate([kept["best"], s]), len(s), axis=0)[len(s) :]
            # a product below the k-th best by more than the rounding of both can't be one of k
            slack = 2e-6 + 1e-15 * v.shape[1] * kept["norm"] * _norms(v).max(initial=0)
            b, a = np.nonzero((s >= np.maximum(kept["best"].min(axis=0), floor) - slack) & (s > -np.inf))
            for some in range(0, len(a), AGAIN):
                i, j = a[some : some + AGAIN], b[some : some + AGAIN]
                exact = np.nan_to_num(_product(asked[i], v[j]), nan=np.inf)
                # of equal products k are enough, those with the smallest ids
                order = np.lexsort((own[j], -exact, i))
                first = np.r_[True, (np.diff(i[order]) != 0) | (exact[order][1:] != exact[order][:-1])] if len(order) else np.zeros(0, bool)
                begun = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                order = order[np.arange(len(order)) - begun < k]
                yield i[order], j[order] + at

    return choose


def _above(least: float) -> Choose:
    """Pairs whose product may be `least` or more when it is rounded, each once."""

    def choose(of: np.ndarray, left: np.ndarray, ids: np.ndarray, data: np.ndarray, same: bool, kept: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not kept:
            kept["norm"], kept["single"] = _norms(left).max(initial=0), left.astype(np.float32)
        size = kept["norm"] * _norms(data).max(initial=0)
        # single precision tells most pairs apart; what it may have wrong is inside the slack
        fine = size < 1e3
        l, r = (kept["single"], data.astype(np.float32)) if fine else (left.astype(np.float64), data.astype(np.float64))
        low = least - 2e-6 - (3e-7 if fine else 1e-15) * left.shape[1] * size
        for at in range(0, len(r), 256):
            some = r[at : at + 256]
            for start in range(0, len(l), TILE // 256):
                s = some @ l[start : start + TILE // 256].T
                hit = np.flatnonzero(~(s < low))  # NaN stays
                if not len(hit):
                    continue
                b, a = np.divmod(hit, s.shape[1])
                a, b = a + start, b + at
                if same:
                    once = of[a] < ids[b]
                    a, b = a[once], b[once]
                for part in range(0, len(a), AGAIN):
                    yield a[part : part + AGAIN], b[part : part + AGAIN]

    return choose


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """(query_id, vec_id, sim): the k most similar unit vectors of each query.

    A stated set of queries against all rows. Queries are counted first and dealt
    into blocks of bounded size, vectors too; a block of vectors streams past a
    block of queries as matrix products, and each task gives what may be among a
    query's k best, which a group limit then chooses by products that are added
    up in order.
    """
    n, width = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    across = max(1, -(-n * (8 * (width or 1) + 32) // QUERY_BYTES))
    blocks = _blocks(vectors.count(), 48)
    asked = _packed(queries, across).withColumnRenamed("block", "x").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = _packed(vectors, blocks).withColumnRenamed("block", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    met = _met(asked, held, blocks, across * blocks, _best(k, floor))
    sim = met.select(F.col("l").alias("query_id"), F.col("r").alias("vec_id"), F.round("sim", 6).alias("sim"))
    return top_per_group(sim.where((F.col("sim") > floor) & (F.col("query_id") != F.col("vec_id"))), ["query_id"], [F.desc("sim"), F.asc("vec_id")], k)


def similarity_to(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(vec_id, sim) of all vectors to the one row of `query`: a projection beside one broadcast row, without rank or shuffle."""
    one = query.select(F.col("embedding").alias("_q")).limit(1)
    return vectors.join(F.broadcast(one)).select("vec_id", F.round(dot(F.col("embedding"), F.col("_q")), 6).alias("sim"))


def similar_pairs(vectors: DataFrame, least: float, blocks: int | None = None) -> DataFrame:
    """(a, b, sim) of all pairs of unit vectors with cosine of `least` or more, exactly.

    Vectors are dealt into blocks, as many as the table needs, and every two
    blocks meet in a cell of their own as matrix products, so no task holds more
    than a block. All pairs are compared once: the work is quadratic by nature,
    for a stated table; near_pairs() compares equal vectors once.
    """
    blocks = blocks or _blocks(vectors.count(), 16)
    packed = _packed(vectors, blocks)
    left = packed.withColumnRenamed("block", "x").withColumn("y", F.explode(F.expr(f"sequence(x, {blocks - 1})")))
    right = packed.withColumnRenamed("block", "y").withColumn("x", F.explode(F.expr("sequence(0, y)")))
    met = _met(left, right, blocks, blocks * blocks, _above(least))
    sim = met.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), F.round("sim", 6).alias("sim"))
    return sim.where(F.col("sim") >= least)


#: Signatures of a vector at most, and vectors that a bucket should hold.
TABLES, BUCKET = 256, 64
#: Pairs that a matrix product compares in the time that a pair in a bucket takes.
PAIR_COST = 300


def bands(n: int, least: float, miss: float) -> tuple[int, int] | None:
    """(bits, tables) of signatures for n vectors: a pair at `least` shares none with a chance of `miss`; None if TABLES aren't enough.

    Each bit is the side of a random plane, on which two vectors at an angle agree
    with 1 - angle / pi. Bits are as many as leave BUCKET vectors to a bucket of
    random ones, or fewer, as long as that looks at less than all pairs.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    for bits in range(min(60, max(1, math.ceil(math.log2(max(2, n) / BUCKET)))), 0, -1):
        tables = max(1, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))) if agree < 1 else 1
        if tables <= TABLES:
            return (bits, tables) if 2 * tables < 2**bits else None
    return None


def signatures(vectors: DataFrame, bits: int, tables: int, seed: int = 17) -> DataFrame:
    """(vec_id, tab, key): for every table the sides of `bits` random planes on which a vector lies, computed in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            data = np.array(batch.embedding.tolist(), dtype=np.float64)
            if planes is None and len(data):
                planes = np.random.default_rng(seed).normal(size=(data.shape[1], bits * tables))
            for at in range(0, len(data), 1024):
                sides = (data[at : at + 1024] @ planes > 0).reshape(-1, tables, bits)
                keys = (sides * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                n = len(keys)
                yield pd.DataFrame({"vec_id": np.repeat(batch.vec_id.to_numpy()[at : at + 1024], tables), "tab": np.tile(np.arange(tables), n), "key": keys.ravel()})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, tab long, key long")


def candidate_pairs(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(a, b) of vectors that share a signature, each pair once.

    A bucket of over 16 * BUCKET vectors is dealt into blocks, and every two
    blocks of it meet in a task of their own.
    """
    keyed = signatures(vectors, bits, tables)
    held = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1").select("tab", "key", F.ceil(F.col("n") / (16 * BUCKET)).cast("int").alias("blocks"))
    dealt = keyed.join(held, ["tab", "key"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    listed = cells.groupBy("tab", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("vec_id", "own")).alias("all"))
    pairs = listed.select("i", "j", "all", F.posexplode("all").alias("at", "x")).select("i", "j", "x", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("y"))
    pairs = pairs.where((F.col("i") == F.col("j")) | (F.col("x.own") != F.col("y.own")))
    return pairs.select(F.least("x.vec_id", "y.vec_id").alias("a"), F.greatest("x.vec_id", "y.vec_id").alias("b")).where("a < b").distinct()


#: Copies of a vector in a part; a vector with more meets others part by part.
COPIES = 1 << 12


def near_pairs(vectors: DataFrame, least: float, miss: float = 0.0, copies: bool = False) -> DataFrame:
    """(a, b, sim) of pairs of unit vectors with cosine of `least` or more: all of them, but for a chance of `miss` each where that is set.

    Equal vectors are compared once. With `copies` all their pairs are given, with
    each other and with all others; without, pairs are between the smallest ids of
    each kind, and from it to its copies. All pairs of kinds are compared in
    blocks. With a `miss` above 0 kinds meet in buckets of signatures from random
    planes instead, and pairs that meet are verified on the vectors, where `least`
    is high enough for signatures to tell pairs apart (`bands`) and buckets hold
    so few pairs that this costs less (PAIR_COST).
    Null and empty vectors are left out; an empty table gives none.
    """
    fine = vectors.where(F.size("embedding") > 0).select("vec_id", "embedding")
    kinds = _written(fine.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")))
    several = kinds.where("n > 1").select("embedding", "first", F.ceil(F.col("n") / COPIES).cast("int").alias("parts"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("sim"))
    held = _written(fine.join(several, "embedding").select("first", "vec_id", "parts", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "sim"))
    ones = kinds.select(F.col("first").alias("vec_id"), "embedding")
    plan = bands(kinds.count(), least, miss) if miss > 0 else None
    if plan is None or PAIR_COST * plan[1] > 2 ** plan[0]:
        pairs = similar_pairs(ones, least)
    else:
        met = _written(candidate_pairs(ones, *plan))
        ends = [ones.select(F.col("vec_id").alias(c), F.col("embedding").alias(f"e{c}")) for c in ("a", "b")]
        sim = met.join(ends[0], "a").join(ends[1], "b").select("a", "b", F.round(dot(F.col("ea"), F.col("eb")), 6).alias("sim"))
        pairs = sim.where(F.col("sim") >= least)
    alike = held.where(F.col("sim") >= least)
    if not copies:
        return pairs.unionByName(alike.where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"), "sim"))
    if held.isEmpty():
        return pairs
    parts = held.select("first", "parts").distinct()
    for end in ("a", "b"):
        dealt = pairs.join(parts, F.col(end) == F.col("first"), "left").select("a", "b", "sim", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")).alias("at"))
        met = dealt.join(held.select("first", "part", "vec_id"), (F.col(end) == F.col("first")) & (F.col("at") == F.col("part")), "left")
        pairs = met.withColumn(end, F.coalesce("vec_id", end)).select("a", "b", "sim")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
    other = F.explode(F.expr("sequence(0, parts - 1)"))
    left = alike.select("first", "sim", F.col("vec_id").alias("a"), F.col("part").alias("i"), other.alias("j"))
    right = alike.select("first", F.col("vec_id").alias("b"), F.col("part").alias("j"), other.alias("i"))
    return pairs.unionByName(left.join(right, ["first", "i", "j"]).where("a < b").select("a", "b", "sim"))


# Weights of the hybrid score, its half-life in seconds, the least score and the number of results.
WEIGHTS = {"priority": 0.5, "trigger": 2.0, "semantic": 1.5, "recency": 0.3, "tag": 0.5, "activation": 0.6}
HALF_LIFE, LEAST_SCORE, TOP = 14 * 86400.0, 0.5, 5


def recall(memories: DataFrame, now: Column, weights: dict[str, float] = WEIGHTS, k: int = TOP, least: float = LEAST_SCORE, floor: float = 0.0, rescale: bool = False) -> DataFrame:
    """Top k of rows with id, priority, triggered, sim, recency, age_from, tag_overlap, activation, expiry and cooldown.

    Only rows that a trigger hits or whose similarity is above the floor are
    candidates; the other parts of the score rank them. Expired rows are
    dropped, cooling ones too unless their priority is 8 or more. The score
    weighs priority, trigger hits, similarity (with `rescale` from the floor to
    1), recency with a half-life, shared tags and activation; ties go to the
    smallest id.
    """
    hit, near = F.coalesce(F.col("triggered"), F.lit(0)) > 0, F.coalesce(F.col("sim") > floor, F.lit(False))
    live = (F.col("expiry").isNull() | (F.col("expiry") >= now)) & (F.col("cooldown").isNull() | (F.col("cooldown") <= now) | (F.col("priority") >= 8))
    decay = F.coalesce("recency", F.lit(0.0)) * half_life(now - F.col("age_from"), HALF_LIFE)
    sim = F.when(near, F.col("sim")).otherwise(0.0)
    if rescale:
        sim = F.when(near, (F.col("sim") - floor) / max(1e-6, 1 - floor)).otherwise(0.0)
    parts = {
        "priority": F.col("priority").cast("double"), "trigger": F.when(hit, 1.0).otherwise(0.0), "semantic": sim,
        "recency": decay, "tag": F.col("tag_overlap").cast("double"), "activation": F.col("activation").cast("double"),
    }
    score = sum((weights[name] * part for name, part in parts.items()), F.lit(0.0))
    scored = memories.where((hit | near) & live).withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), F.asc("id")).limit(k)


def two_hop(vectors: DataFrame, chosen: DataFrame, k: int, least: float) -> DataFrame:
    """The k nearest others of each chosen vector, none of them chosen, merged by their best similarity, 2k at most.

    `vectors` are those that may be returned: give it live rows only.
    """
    others = vectors.join(chosen.select("vec_id"), "vec_id", "left_anti")
    best = cosine_search(others, chosen, k, least - 5e-7).groupBy("vec_id").agg(F.max("sim").alias("sim"))
    return best.orderBy(F.desc("sim"), F.asc("vec_id")).limit(2 * k)


# Weights of an item's salience, half-life of fresh items and grace after a window in seconds, penalty by sensitivity.
SALIENCE = {"timeliness": 1.0, "relational": 0.8, "novelty": 0.5, "sensitivity": 1.5, "fatigue": 0.9}
FRESH_HALF_LIFE, GRACE = 432_000.0, 604_800.0
SENSITIVITY = {"none": 0.0, "personal": 0.35, "grief_adjacent": 10.0}


def salience(now: Column, last_channel: Column | None = None, shared: Column | None = None, weights: dict[str, float] = SALIENCE, channel_weight: Column | float = 1.0) -> Column:
    """How much an item (channel, fit, sensitivity, created, window_start, window_end, raised_count, deflections) has for it now.

    Its moment (inside its window, before it, fading after it, or fresh without
    one) and fit count for it; being of the channel that spoke last, sharing
    topics with recent talk (`shared`, 0 to 1), sensitivity and having been
    raised or deflected count against it. channel_weight scales what counts for
    it.
    """
    start, end = F.col("window_start"), F.col("window_end")
    fading = F.greatest(F.lit(0.0), 0.6 * (1 - (now - end) / GRACE))
    fresh = half_life(F.greatest(F.lit(0.0), now - F.col("created")), FRESH_HALF_LIFE)
    timely = F.when(start.isNotNull() & (now < start), 0.15).when(end.isNotNull() & (now > end), fading).when(start.isNotNull() | end.isNotNull(), 1.0).otherwise(fresh)
    again = (F.when(F.col("channel") == last_channel, 0.5).otherwise(0.0) if last_channel is not None else F.lit(0.0)) + (shared if shared is not None else F.lit(0.0))
    sensitive = F.element_at(F.create_map(*[F.lit(x) for pair in SENSITIVITY.items() for x in pair]), F.coalesce("sensitivity", F.lit("none")))
    tired = 0.6 * F.col("raised_count") + 0.8 * F.col("deflections")
    gains = weights["timeliness"] * timely + weights["relational"] * F.col("fit")
    return F.round(channel_weight * gains - weights["novelty"] * again - weights["sensitivity"] * sensitive - weights["fatigue"] * tired, 6)


def pick(items: DataFrame, now: Column, unproven: str = "news") -> DataFrame:
    """The one item with the most salience above 0 that may be raised; of equals the oldest.

    Left out are what one only responds to, items before their window, and
    uncorroborated ones of the `unproven` channel.
    """
    may = (F.col("sensitivity") != "grief_adjacent") & ((F.col("channel") != unproven) | F.col("corroborated")) & (F.col("window_start").isNull() | (now >= F.col("window_start")))
    return items.where(may & (F.col("salience") > 0)).orderBy(F.desc("salience"), F.asc("created"), F.asc("id")).limit(1)
