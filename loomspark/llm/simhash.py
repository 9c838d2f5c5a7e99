"""SimHash near-duplicates with Golay-code fuzzy hashing, and exact ones by shared shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, if_small, lower_az, per_text, slices
from .slots import COUNTS, SlotCounter, held, shared_slots, slot_of

#: Keys and shingles shared by more are linked in linear size instead of pair by pair; every way finds the same groups.
CROWDED = 16
#: Slots in which shingles are counted, in blocks of so many; their counts only order shingles.
RANKS, RANK_BLOCK = 1 << 24, 1 << 18
#: Shingles of a family of texts that one task compares with another such block.
FAMILY_BLOCK = 1 << 21
#: Shingles with a larger share of all places in prefixes than one of so many are known to every executor.
OFTEN = 1 << 18
# The generator polynomial of the perfect binary Golay code of length 23, and the segments of a fingerprint.
_GENERATOR = 0b110001110101
_SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits of a word, and by remainder the error patterns to its nearest codewords.

    Every word has one codeword within distance 3; a word at distance 3 has five
    more at distance 4. Any two words that differ in one or two bits share one.
    """
    single = [_remainder(1 << b) for b in range(23)]

    def mixed(bits: range) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for b in bits:
            out = np.concatenate([out, out ^ single[b]])
        return out

    errors = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            r = 0
            for b in bits:
                r ^= single[b]
            errors[r, used[r]] = sum(1 << b for b in bits)
            used[r] += 1
    return mixed(range(12)), mixed(range(12, 23)), errors


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): up to 18 keys for each 64-bit fingerprint.

    Of three segments two errors leave one untouched; a key joins an untouched
    segment with a codeword index near the next one, which tolerates both
    errors. So fingerprints at distance 2 or less share a key.
    """
    low, high, errors = _golay()
    f = fingerprints.astype(np.uint64)
    parts = [((f >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in _SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        fuzzy = parts[(i + 1) % 3]
        near = errors[low[fuzzy & 4095] ^ high[fuzzy >> 12]]
        row, slot = np.nonzero(near >= 0)
        code = (fuzzy[row] ^ near[row, slot]) >> 11
        rows.append(row)
        keys.append(np.int64(i) << 60 | exact[row] << 12 | code)
    return np.concatenate(rows), np.concatenate(keys)


def _bits(hashes: np.ndarray) -> int:
    """Majority of each bit over all hashes; a tie gives 0."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        some = np.ascontiguousarray(hashes[start : start + (1 << 15)], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(k)))]


def fingerprint(text: bytes, k: int = 3) -> int:
    """Signed 64-bit SimHash of k-word shingles, repeats included, lower-cased in A-Z; 0 without words."""
    hashed = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text.lower().split(), k)]
    return _bits(np.array(hashed, dtype=np.uint64)) if hashed else 0


def _keys(fingerprints: DataFrame) -> DataFrame:
    """(key, tab, fp): the Golay keys of distinct (tab, fp) rows, the table's number inside the key."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = golay_keys(batch.column("fp").to_numpy().view(np.uint64))
            taken = batch.take(pa.array(row))
            key = key | taken.column("tab").to_numpy().astype(np.int64) << 40
            yield pa.RecordBatch.from_arrays([pa.array(key), taken.column("tab"), taken.column("fp")], names=["key", "tab", "fp"])

    return fingerprints.select("tab", "fp").distinct().mapInArrow(spread, "key long, tab int, fp long")


def _met(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tab, a, b) of keys with two fingerprints, and (key, n, tab, fp) of those with more.

    Most keys hold one fingerprint and end in a count that is combined before
    the shuffle; only those with three or more are looked up again.
    """
    keys = _keys(fingerprints)
    ends = [F.count("*").alias("n"), F.min("tab").alias("tab"), F.min("fp").alias("a"), F.max("fp").alias("b")]
    shared = checkpointed(keys.groupBy("key").agg(*ends).where("n > 1"))
    many = shared.where("n > 2").select("key", "n")
    return shared.where("n = 2").select("tab", "a", "b"), checkpointed(keys.join(if_small(many, 1_000_000), "key"))


def _pairs(two: DataFrame, met: DataFrame) -> DataFrame:
    """(tab, a, b) at 2 differing bits or less, from the keys with up to CROWDED fingerprints."""
    listed = met.where(F.col("n") <= CROWDED).groupBy("tab", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = listed.select("tab", "fps", F.posexplode("fps").alias("i", "a")).select("tab", "a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
    pairs = two.union(pairs).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return pairs.select("tab", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def fingerprint_links(fingerprints: DataFrame) -> DataFrame:
    """(tab, a, b) pairs that connect what fingerprints at distance 2 or less connect, from (tab, fp) rows.

    All rows of a key with up to CROWDED fingerprints are compared pair by
    pair. In a more crowded key every fingerprint stands by itself and its 64
    one-bit neighbours: two that meet at one differ in 2 bits or less, and two
    that differ in 2 bits or less meet at one, so a link from the smallest to
    each of the others connects the same fingerprints in linear size.
    """
    two, met = _met(fingerprints)
    crowd = met.where(F.col("n") > CROWDED).select("tab", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in (1 << b for b in range(64))])
    near = crowd.select("tab", "fp", F.explode(flips).alias("flip")).select("tab", "fp", F.expr("fp ^ flip").alias("centre"))
    first = near.groupBy("tab", "centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = near.join(first, ["tab", "centre"]).where("fp <> a").select("tab", "a", F.col("fp").alias("b"))
    return _pairs(two, met).union(stars).distinct()


def link_fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, fp (signed) and component_id, the smallest doc_id reachable over links of 2 bits or less.

    A text without words has fingerprint 0, linked like any other; null text is
    such a text. Equal fingerprints are one class, so copies meet once. A null
    doc_id is never the smallest; repeated rows each come back; the shingles of a
    very long text are hashed within one task; an empty table gives an empty
    result; other columns are not read.
    """
    slim = checkpointed(per_text(docs, ["doc_id"], {"fp": "long"}, lambda text: (fingerprint(text, k),)))
    classes = checkpointed(slim.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(fingerprint_links(classes.select(F.lit(0).alias("tab"), "fp")))
    whole = classes.join(groups, classes.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    whole = checkpointed(whole)
    smallest = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    names = whole.join(smallest, "component").select("fp", "component_id")
    return slim.join(names, "fp").select("doc_id", "fp", "component_id")


class Shingler:
    """Hashes of the distinct k-word shingles of a text, made of its words' hashes, which are remembered."""

    def __init__(self, k: int) -> None:
        self.k, self.known = k, {}

    def set_of(self, words: list[bytes]) -> np.ndarray:
        """In rising order; fewer words than k: the whole sequence is the one shingle."""
        if len(self.known) > 1 << 18:
            self.known.clear()
        known, hashes = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w, 42)
            hashes.append(h)
        width = min(self.k, len(words))
        h, n = np.array(hashes, dtype=np.uint64), len(words) - width + 1 if words else 0
        mixed = np.full(n, width, np.uint64)
        for i in range(width):
            mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed.view(np.int64))


def shingle_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """For every slot of shingles a rank that grows with how often all texts hold one of it.

    A table of fixed size, whatever the corpus: tasks count the shingles of
    their texts in RANKS slots (to 255 each), and the blocks of counts are summed
    block by block. Ranks only choose the order in which prefixes take shingles;
    every order gives the same pairs, and this one puts shared shingles last.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, waiting = Shingler(k), np.zeros(RANKS, np.uint8), []

        def settle() -> None:
            at, n = np.unique(np.concatenate(waiting), return_counts=True)
            held[at] = np.minimum(held[at] + n, 255)
            waiting.clear()

        for batch in slices(batches):
            waiting += [slot_of(shingler.set_of(t.lower().split()), RANKS).astype(np.uint32) for t in batch.column("text").to_pylist() if t]
            if sum(map(len, waiting)) > 1 << 20:
                settle()
        if waiting:
            settle()
        blocks = [(i, pa.compress(held[i * RANK_BLOCK : (i + 1) * RANK_BLOCK].tobytes(), "zstd", asbytes=True)) for i in range(RANKS // RANK_BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block."""
        now, whole = None, np.zeros(RANK_BLOCK, np.int64)

        def summed() -> pa.RecordBatch:
            ranks = np.minimum(np.round(6 * np.log2(whole + 1)), 255).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([ranks], pa.binary())], names=["block", "ranks"])

        for batch in batches:
            for i, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                if i != now:
                    if now is not None:
                        yield summed()
                    now = i
                    whole[:] = 0
                whole += np.frombuffer(pa.decompress(data, RANK_BLOCK, "zstd", asbytes=True), np.uint8)
        if now is not None:
            yield summed()

    counted = docs.where("text IS NOT NULL").select(F.encode("text", "utf-8").alias("text")).mapInArrow(count, "block int, counts binary")
    ranks = np.zeros(RANKS, np.uint8)
    for r in counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, ranks binary").collect():
        ranks[r.block * RANK_BLOCK : (r.block + 1) * RANK_BLOCK] = np.frombuffer(r.ranks, np.uint8)
    return ranks


def _sketch(ranks, tables: int, similarity: float, k: int) -> Callable[[bytes], tuple]:
    """Of a text: the digest of its words, a SimHash fingerprint of its shingle set for every table, the set's size and its prefix.

    The prefix are the shingles of which one is shared by every text that
    reaches the similarity: such texts share at least similarity * size of the
    set, so in any order that all texts use, the first size - that + 1 shingles
    of both meet.
    """
    shingler = Shingler(k)
    odd = np.random.default_rng(7).integers(1, 1 << 63, tables, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def sketch(text: bytes) -> tuple:
        words = text.lower().split()
        own = shingler.set_of(words)
        fps = []
        for factor in odd:
            h = own.view(np.uint64) * factor
            h ^= h >> np.uint64(32)
            fps.append(_bits(h) if len(h) else 0)
        rare = own[np.argsort(ranks.value[slot_of(own, RANKS)], kind="stable")]
        prefix = rare[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1].tolist() if len(own) else []
        return hashlib.sha256(b" ".join(words)).hexdigest(), fps, len(own), prefix

    return sketch


def shared_entries(firsts: DataFrame) -> DataFrame:
    """(node, size, at, token, n): the places of prefixes in which n > 1 of them hold the shingle, from (node, size, prefix).

    Most shingles of prefixes stand in one text. Their slots are counted first,
    in two tables of fixed size, so few of them travel.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SlotCounter(2)
        for batch in slices(batches):
            for prefix in batch.column("prefix"):
                counter.add(prefix.values.to_numpy())
            if counter.full():
                yield counter.settle()
        yield counter.settle()

    bits = firsts.sparkSession.sparkContext.broadcast(shared_slots(firsts.select("prefix").mapInArrow(count, COUNTS), tables=2)[0])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            tokens = lists.flatten().to_numpy()
            kept = np.flatnonzero(held(bits.value, tokens, 2))
            row = np.repeat(np.arange(batch.num_rows), lengths)[kept]
            at = kept - (np.cumsum(lengths) - lengths)[row]
            taken = batch.select(["node", "size"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32()), pa.array(tokens[kept], pa.int64())], names=["node", "size", "at", "token"])

    some = firsts.select("node", "size", "prefix").mapInArrow(spread, "node long, size int, at int, token long")
    some = checkpointed(some)
    bits.destroy()  # the table is written
    counts = checkpointed(some.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    # a token of a large share of all places would fill a task of the join; fewer than OFTEN can be, so they are broadcast
    many = F.col("n") * OFTEN > (counts.agg(F.sum("n")).first()[0] or 0)
    often = counts.where(many).withColumnRenamed("token", "its")
    common = some.join(F.broadcast(often), F.col("token") == F.col("its"), "left").drop("its")
    rare = common.where("n IS NULL").drop("n").join(counts.where(~many), "token")
    return checkpointed(common.where("n IS NOT NULL").unionByName(rare))


def _meetings(firsts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) nodes that may reach the similarity, and (token, band, node, leader) of crowded shingles, from (node, size, prefix).

    At the first shingle that two texts share, no more can be shared than is
    left of either; pairs for which that is too little go. A shingle shared by
    more than CROWDED prefixes is split by bands of size, each text in its own
    and the next, so that all sizes that can reach the similarity meet. In a
    band that is still crowded, all texts are paired with its first one only;
    unlike_leaders() tells what that leaves open.
    """
    entry = F.struct("node", "size", "at")
    met = shared_entries(firsts)
    band = F.floor(F.log("size") / max(1e-4, -math.log(similarity) * (1 + 1e-6))).cast("int")  # a little wider, as logarithms are rounded
    banded = checkpointed(met.where(F.col("n") > CROWDED).withColumn("band", F.explode(F.array(band, band + 1))).drop("n"))
    filled = banded.groupBy("token", "band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
    crowd = checkpointed(banded.join(filled, ["token", "band"]))
    few = met.withColumn("band", F.lit(-1)).select("token", "band", "n", "node", "size", "at").where(F.col("n") <= CROWDED)
    few = few.union(crowd.select(*few.columns).where(F.col("n") <= CROWDED))
    listed = few.groupBy("token", "band").agg(F.collect_list(entry).alias("all"))
    pairs = listed.select("all", F.posexplode("all").alias("i", "x")).select("x", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("y"))
    left = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    pairs = pairs.where(left * (1 + similarity) + 1e-6 >= similarity * (F.col("x.size") + F.col("y.size")))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    lists = crowd.where(F.col("n") > CROWDED).select("token", "band", "node", "leader")
    return pairs.union(lists.select(F.col("leader").alias("a"), F.col("node").alias("b"))).where("a < b").distinct(), lists


def unlike_leaders(lists: DataFrame, scored: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(node, family) of the texts of crowded lists that may have links which their leaders don't show.

    Texts in one group need none. Distances 1 - similarity obey the triangle
    inequality, so a text of the leader's group can only be near one outside if
    its distance from the leader comes that near to the smallest one outside.
    Lists that share a text are searched together, as a family.
    """
    group = groups.select(F.col("node").alias("x"), F.col("component").alias("g"))
    rows = lists.where("node <> leader").join(scored.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("sim")).alias("d")), ["leader", "node"])
    rows = rows.join(group, F.col("node") == F.col("x"), "left").withColumn("own", F.coalesce("g", "node")).drop("x", "g")
    rows = rows.join(group, F.col("leader") == F.col("x"), "left").withColumn("out", F.col("own") != F.coalesce("g", "leader")).drop("x", "g")
    rows = checkpointed(rows)
    nearest = rows.where("out").groupBy("token", "band").agg(F.min("d").alias("nearest"))
    open_rows = rows.join(nearest, ["token", "band"]).where(F.col("out") | (F.col("d") >= F.col("nearest") - (1 - similarity) - 1e-9))
    several = open_rows.groupBy("token", "band").agg(F.min("node").alias("least"), F.count_distinct("own").alias("groups")).where("groups > 1").drop("groups")
    stars = open_rows.join(several, ["token", "band"]).select(F.col("least").alias("a"), F.col("node").alias("b"))
    return components(stars).withColumnRenamed("component", "family")


def links_inside(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what all pairs of sets at the similarity connect: a search that compares each set with those not yet reached."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    holders = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    at = np.concatenate([[0], np.cumsum(np.bincount(ids))]) if len(ids) else np.zeros(1, np.int64)
    far, found = np.ones(n, bool), []
    for root in range(n):
        if not far[root]:
            continue
        far[root] = False
        queue = [root]
        while queue and far.any():
            x = queue.pop()
            own = ids[starts[x] : starts[x + 1]]
            counts = at[own + 1] - at[own]
            places = np.repeat(at[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            both = np.bincount(holders[places], minlength=n)
            near = np.flatnonzero(far & (both > 0) & (both >= similarity * (sizes[x] + sizes - both)))
            far[near] = False
            found += [(x, int(y)) for y in near]
            queue += near.tolist()
    return found


def _family_links(families: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links that connect what the pairs of each family connect.

    A family is dealt into blocks of about FAMILY_BLOCK shingles, and every two
    blocks are searched in one task.
    """
    sized = checkpointed(families.join(sets, "node").select("family", "node", F.size("set").alias("size")))
    blocks = sized.groupBy("family").agg(F.ceil(F.sum("size") / FAMILY_BLOCK).cast("int").alias("blocks"))
    dealt = sized.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.expr("sequence(0, greatest(blocks, 1) - 1)")))
    cells = cells.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node").join(sets, "node")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy()
        links = links_inside([np.asarray(s, dtype=np.int64) for s in group["set"]], similarity)
        return pd.DataFrame([(nodes[x], nodes[y]) for x, y in links], columns=["a", "b"]).astype("int64")

    return cells.groupBy("family", "i", "j").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, k: int = 5, tables: int = 2) -> DataFrame:
    """(doc_id, digest, keeper) of every document that another one, its keeper, stands for.

    Texts with the same words are one class, named by their digest, as rows may
    share a doc_id or have none. Fingerprints of the sets of k-word shingles
    (fewer words than k: the whole sequence is the one shingle) that differ in 2
    bits or less meet through their Golay keys, in `tables` tables. What such a
    distance can't tell, as texts at the similarity differ in some ten bits,
    meets through the sets' prefixes, in which all texts that reach the
    similarity share a shingle. Every candidate is verified on the sets
    themselves, so a group is what pairs at the similarity connect, none of them
    missed. Its smallest doc_id is the keeper, or null if it has none (of equal
    ones, the one with the smallest digest). Null texts are empty texts.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, k))
    adds = {"digest": "string", "fps": "array<long>", "size": "int", "prefix": "array<long>"}
    slim = checkpointed(per_text(docs, ["doc_id"], adds, _sketch(ranks, tables, similarity, k)).withColumn("node", F.monotonically_increasing_id()))
    ranks.destroy()  # the table is written
    classes = checkpointed(slim.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.min("node").alias("node")))
    firsts = slim.join(if_small(classes.select("node"), 2_000_000), "node", "left_semi")
    rows = firsts.select("node", F.posexplode("fps").alias("tab", "fp"))
    leaders = checkpointed(rows.groupBy("tab", "fp").agg(F.min("node").alias("leader"), F.count("*").alias("n")))
    same = rows.join(leaders.where("n > 1"), ["tab", "fp"]).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(leaders)
    ends = leaders.select("tab", "fp", "leader")
    links = links.join(ends.withColumnsRenamed({"fp": "a", "leader": "la"}), ["tab", "a"]).join(ends.withColumnsRenamed({"fp": "b", "leader": "lb"}), ["tab", "b"])
    meeting, lists = _meetings(firsts, similarity)
    lists = checkpointed(lists)
    pairs = same.union(links.select(F.least("la", "lb"), F.greatest("la", "lb"))).union(meeting).where("a < b").distinct()
    pairs = checkpointed(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = checkpointed(wanted.join(classes, "node").select("node", "digest", F.col("keeper").alias("doc_id")))
    shingler = Shingler(k)

    def shingle_set(text: bytes) -> tuple[str, list[int]]:
        words = text.lower().split()
        return hashlib.sha256(b" ".join(words)).hexdigest(), shingler.set_of(words).tolist()

    ids = wanted.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.select("doc_id", "text").join(if_small(ids, 1_000_000), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = per_text(texts, ["doc_id"], {"digest": "string", "set": "array<long>"}, shingle_set).drop("doc_id")
    sets = checkpointed(sets.join(if_small(wanted.select("digest", "node"), 200_000), "digest").select("node", "set").dropDuplicates(["node"]))
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    scored = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common.alias("common"))
    alike = F.col("common") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("common"))
    scored = checkpointed(scored.select("a", "b", (F.col("common") / F.greatest(F.lit(1), F.col("na") + F.col("nb") - F.col("common"))).alias("sim"), alike.alias("alike")))
    true = scored.where("alike").select("a", "b")
    groups = checkpointed(components(true))
    if not lists.isEmpty():
        families = checkpointed(unlike_leaders(lists, scored, groups, similarity))
        if not families.isEmpty():
            groups = components(true.union(_family_links(families, sets, similarity)))
    whole = checkpointed(classes.join(groups, "node", "left").select("digest", "keeper", F.coalesce("component", "node").alias("component")))
    first = F.min(F.struct(F.col("keeper").isNull(), F.col("keeper").alias("id"), "digest")).alias("first")
    least = whole.groupBy("component").agg(first).select("component", F.col("first.id").alias("keeper"), F.col("first.digest").alias("its"))
    kept = whole.select("digest", "component").join(least, "component").select("digest", "keeper", "its")
    gone = slim.select("doc_id", "digest").join(kept, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")) | (F.col("digest") != F.col("its")))
    return gone.select("doc_id", "digest", "keeper")


def _digest(text: Column) -> Column:
    """The digest of a text's words, as near_duplicates gives it."""
    words = F.regexp_replace(lower_az(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(F.encode(F.trim(words), "utf-8"), 256)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near-duplicates, all columns unchanged.

    Rows that share a doc_id, or have none, are told apart by their words; of
    those with equal words one stays.
    """
    gone = checkpointed(near_duplicates(docs, **options).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_gone")).distinct())
    twice = docs.groupBy(F.col("doc_id").alias("_twice")).count().where("count > 1 OR _twice IS NULL").select("_twice")
    twice = checkpointed(twice)
    left = docs.join(if_small(gone, 2_000_000), F.col("doc_id") == F.col("_id"), "left_anti")
    if twice.isEmpty():
        return left
    shared = F.col("doc_id").eqNullSafe(F.col("_twice"))
    repeats = docs.join(twice, shared, "left_semi").withColumn("_digest", _digest(F.col("text")))
    repeats = repeats.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_gone")), "left_anti")
    return left.join(twice, shared, "left_anti").union(repeats.dropDuplicates(["doc_id", "_digest"]).drop("_digest"))
