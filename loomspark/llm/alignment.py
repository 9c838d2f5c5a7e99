"""Alignment of two tokenizers' tokens: components of the graph of overlapping tokens, and counts of linked pairs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices

#: Pairs with a larger share of all links than one of so many are known to every executor, so there are fewer than that;
#: those linked less often than OFTEN aren't, which bounds them in small tables too.
FREQUENT, OFTEN = 1 << 19, 16
#: Bytes of texts that are aligned together, and pairs that a task gathers before it adds them up.
TOGETHER, GATHERED = 1 << 20, 1 << 20
#: The cut that byte-level tokenizers make by themselves (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that two Unicode versions may class differently.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0ƀ-\U0010ffff]")


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level entries: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer from a .json file: ids of texts, bytes of ids.

    Usual texts go through the same merges in their ranked form, where the file
    has them in the order of its ids; it is several times faster. Others go
    through the file's own tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        byte_of = _byte_of()
        added = self.own.get_added_tokens_decoder()
        vocabulary = self.own.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, i in vocabulary.items():
            plain = i in added or any(c not in byte_of for c in entry)
            self.bytes[i] = entry.encode() if plain else bytes(byte_of[c] for c in entry)
        self.fast = self._ranked(json.loads(self.own.to_str()), {b: i for i, b in enumerate(self.bytes) if b and i not in added})

    @staticmethod
    def _ranked(made: dict, ranks: dict[bytes, int]):
        import tiktoken

        cut, model = made["pre_tokenizer"] or {}, made["model"]
        if made["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or model["type"] != "BPE" or model.get("ignore_merges"):
            return None
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if None in merged or merged != sorted(merged) or len(set(merged)) != len(merged) or len(ranks) != len(merged) + 256:
            return None
        return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not _UNUSUAL.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """A sentence-piece tokenizer from a .model file, which puts a space before a text: ids of texts, bytes of ids."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        piece = self.own.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:5], 16)]) if self.own.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.own.get_piece_size())]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text), np.int64)


def components_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the component of every A token and every B token, in page order.

    Both token lists cover the same bytes. The bytes between two neighbouring
    ends of either list lie in one token of each, which makes them an edge;
    union-find joins the tokens by rounds over all edges at once, each hooking
    larger roots to smaller ones and halving the paths.
    """
    n = len(ends_a)
    cuts = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    cuts = cuts[np.diff(cuts, prepend=-1) > 0]
    u, v = np.searchsorted(ends_a, cuts), n + np.searchsorted(ends_b, cuts)
    parent = np.arange(n + len(ends_b))
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    number = np.cumsum(parent[:n] == np.arange(n)) - 1  # a component's least node is an A token
    return number[parent[:n]], number[parent[n:]]


class Bytes:
    """The bytes of all ids end to end, to put together those of many tokens at once."""

    def __init__(self, listed: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(listed), np.uint8)
        self.size = np.array([len(x) for x in listed], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Aligner:
    """Aligns texts under two tokenizers."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.bytes_a, self.bytes_b = Bytes(self.a.bytes), Bytes(self.b.bytes)
        said = [f"{i}{c}".encode() for i in range(len(self.a.bytes)) for c in ",|"]
        self.said = said + [f"{i}{c}".encode() for i in range(len(self.b.bytes)) for c in ",;"]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Both id lists, empty where a list's bytes aren't those of the text with a space before it."""
        if text:
            spaced = " " + text
            data, a, b = np.frombuffer(spaced.encode("utf-8", "surrogatepass"), np.uint8), self.a.encode(spaced), self.b.encode(text)
            if np.array_equal(self.bytes_a.of(a), data) and np.array_equal(self.bytes_b.of(b), data):
                return a, b
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """For every text: its ids (two arrays), the component of every token of each list, the pairs that end together (two arrays of ids).

        Texts are aligned end to end, as the bytes of both lists agree in each.
        """
        at = 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and (not lists or size < TOGETHER):
                lists.append(self.ids(texts[at]))
                size += len(texts[at] or "")
                at += 1
            a, b = (np.concatenate(side) for side in zip(*lists))
            ends_a, ends_b = np.cumsum(self.bytes_a.size[a]), np.cumsum(self.bytes_b.size[b])
            group_a, group_b = components_of(ends_a, ends_b)
            # the members of a component that end together are a link
            there = np.searchsorted(ends_b, ends_a)
            linked = ends_b[there] == ends_a if len(b) else np.zeros(0, bool)
            i = j = 0
            for two in lists:
                k, m = i + len(two[0]), j + len(two[1])
                own = linked[i:k]
                first = group_a[i] if k > i else 0
                yield a[i:k], b[j:m], group_a[i:k] - first, group_b[j:m] - first, a[i:k][own], b[there[i:k][own]]
                i, j = k, m

    def digest(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
        """sha256 of the groups written out as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        if not len(a):
            return ""
        n = int(group_a[-1]) + 1
        of_a, of_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]] = a * 2 + (np.diff(group_a, append=n) > 0)
        line[np.arange(len(b)) + np.cumsum(of_a)[group_b]] = (b + len(self.a.bytes)) * 2 + (np.diff(group_b, append=n) > 0)
        return hashlib.sha256(b"".join(map(self.said.__getitem__, line.tolist()))[:-1]).hexdigest()


@cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Rising keys as differences, then their counts, compressed."""
    return pa.compress(np.concatenate([np.diff(keys, prepend=0), n]).astype("<i8").tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.decompress(data, 16 * n, "zstd", asbytes=True), "<i8") if n else np.zeros(0, np.int64)
    return np.cumsum(both[:n]), both[n:]


def aligned_groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and groups of every row: the minimal runs of A ids and of B ids that cover the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            groups = []
            for a, b, group_a, group_b, *_ in _aligner(a_path, b_path).align(batch.column("text").to_pylist()):
                n = int(group_a[-1]) + 1 if len(a) else 0
                cut_a, cut_b = (np.split(x, np.flatnonzero(np.diff(g)) + 1) for x, g in ((a, group_a), (b, group_b)))
                groups.append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(cut_a[:n], cut_b[:n])])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(groups, kind)], names=["doc_id", "groups"])

    return _rows(docs).mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, n_pairs int"


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Counts, digest and packed (pair, times) of every row; a pair is its A id in the high half and its B id in the low one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        names = [x.split(" ")[0] for x in _ALIGNED.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.int32()]
        for batch in slices(batches):
            made = []
            for doc, (a, b, group_a, group_b, link_a, link_b) in zip(batch.column("doc_id").to_pylist(), aligner.align(batch.column("text").to_pylist())):
                keys, n = np.unique(link_a << 32 | link_b, return_counts=True)
                groups = int(group_a[-1]) + 1 if len(a) else 0
                made.append((doc, len(a), len(b), groups, len(link_a), aligner.digest(a, b, group_a, group_b), _packed(keys, n), len(keys)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)], names=names)

    return _rows(docs).mapInArrow(run, _ALIGNED)


def _pair_totals(aligned: DataFrame) -> DataFrame:
    """(pair, total) over all rows; each task adds up what it gathers before it sends it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def settle() -> tuple[np.ndarray, np.ndarray]:
            return _counted(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in held)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in held)]))

        def out() -> pa.RecordBatch:
            keys, n = settle()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        for batch in batches:
            for data, n in zip(batch.column("pairs").to_pylist(), batch.column("n_pairs").to_pylist()):
                held.append(_unpacked(data, n))
                waiting += n
                if waiting >= 4 * GATHERED:
                    held = [settle()]
                    waiting = len(held[0][0])
                    if waiting >= GATHERED:
                        yield out()
                        held, waiting = [], 0
        yield out()

    return aligned.select("pairs", "n_pairs").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("total"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a_id, b_id, n): how many links of all texts hold each pair."""
    pair = F.col("pair")
    return _pair_totals(_aligned(docs, a_path, b_path)).select(
        F.shiftright(pair, 32).cast("int").alias("a_id"), pair.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b_id"), F.col("total").alias("n")
    )


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    A text with a space before it is cut by the byte-level tokenizer in a_path,
    the text itself by the sentence-piece one in b_path. Groups are the
    components of the graph of overlapping tokens; within them A and B tokens
    that end at the same byte are links. Links are counted by pair over all
    texts: in the tasks, then by pair. Common pairs are known to every executor,
    others' times in a text meet their counts in a join on the pair, where none
    has more than one in FREQUENT of all links.

    Null and empty texts, and those whose tokens don't give their bytes back,
    have no tokens: zeros and an empty digest. A null doc_id is a value like any
    other; rows repeated in doc_id or text each come back and each count; an
    empty table gives an empty result; other columns are not read. A text's
    tokens are held by one task, some hundred bytes a token.
    """
    aligned = checkpointed(_aligned(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    totals = checkpointed(_pair_totals(aligned))
    everything = totals.agg(F.sum("total")).first()[0] or 0
    # the best count of each B id: the vocabulary bounds this table
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    best = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("most"))
    judged = totals.join(F.broadcast(best), b_id == F.col("b_id")).select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    often = (F.col("total") * FREQUENT > everything) & (F.col("total") > OFTEN)
    common = judged.where(often).toPandas().sort_values("pair")
    frequent = docs.sparkSession.sparkContext.broadcast(tuple(common[c].to_numpy(np.int64) for c in ("pair", "total", "best")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per row one line, without a pair, of what is known, and one for each other pair."""
        pairs, total, best = frequent.value
        for batch in slices(batches, 64):
            parts: list[tuple] = []
            for row, data, n in zip(*(batch.column(c).to_pylist() for c in ("row", "pairs", "n_pairs"))):
                keys, times = _unpacked(data, n)
                at = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
                known = pairs[at] == keys if len(pairs) else np.zeros(n, bool)
                at, often = at[known], times[known]
                rare = int(n - known.sum())
                parts.append((
                    np.full(rare + 1, row), np.append(keys[~known], -1), np.append(times[~known], 0),
                    np.append(np.zeros(rare, np.int64), (best[at] * often).sum()), np.append(np.zeros(rare, np.int64), (total[at] * often).sum()),
                ))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)], names=["row", "pair", "times", "n_best", "count_sum"])

    lines = checkpointed(aligned.select("row", "pairs", "n_pairs").mapInArrow(split, "row long, pair long, times long, n_best long, count_sum long"))
    rare = lines.where("pair >= 0").join(judged.where(~often), "pair").select("row", (F.col("times") * F.col("best")).alias("n_best"), (F.col("times") * F.col("total")).alias("count_sum"))
    sums = lines.where("pair < 0").select("row", "n_best", "count_sum").unionAll(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "n_pairs").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
