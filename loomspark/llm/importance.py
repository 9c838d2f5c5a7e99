"""Importance resampling towards a target distribution, by an external sort-count of packed bucket streams."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ranked, slices

#: A word of letters and digits in lower-cased UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Features that a block holds before it is written, and that are worked on at a time.
BLOCK, PIECE = 1 << 19, 1 << 20
_BLOCKS = "doc_ids array<long>, n_words array<long>, ends array<long>, stream binary"


def feature_buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to `longest` words, as uint16; a run's crc32 goes on from that of the run without its last word."""
    crc = list(map(zlib.crc32, words))
    spaced = [b" " + w for w in words]
    found = [np.array(crc, np.uint32)]
    for n in range(1, min(longest, len(words))):
        crc = list(map(zlib.crc32, spaced[n:], crc))
        found.append(np.array(crc, np.uint32))
    return (np.concatenate(found) % buckets).astype(np.uint16)


def bucket_streams(texts: DataFrame, longest: int, buckets: int, id_column: str | None = "doc_id") -> DataFrame:
    """Blocks of documents: their ids, numbers of words, the ends of their features in the stream, and the packed stream of buckets."""
    if buckets > 1 << 16:
        raise ValueError("a bucket has 16 bits")
    key = F.col(id_column).cast("long") if id_column else F.lit(None).cast("long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        n_words: list[int] = []
        ends: list[int] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            stream = np.concatenate([np.zeros(0, np.uint16), *parts]).astype("<u2").tobytes()
            kinds = [pa.list_(pa.int64())] * 3 + [pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((ids, n_words, ends, stream), kinds)], names=["doc_ids", "n_words", "ends", "stream"])
            for held in (ids, n_words, ends, parts):
                held.clear()
            return made

        for batch in slices(batches):
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = _WORD.findall((text or b"").lower())
                features = feature_buckets(words, longest, buckets)
                ids.append(doc), n_words.append(len(words)), parts.append(features)
                ends.append((ends[-1] if ends else 0) + len(features))
                if ends[-1] >= BLOCK:
                    yield block()
        if ids:
            yield block()

    return texts.select(key.alias("id"), F.encode("text", "utf-8").alias("text")).mapInArrow(pack, _BLOCKS)


def bucket_counts(blocks: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: pieces of the streams are sorted and run-length encoded; each task adds up its runs, and their sums meet by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column("stream"):
                stream = np.frombuffer(data.as_buffer(), "<u2")
                for at in range(0, len(stream), PIECE):
                    piece = np.sort(stream[at : at + PIECE])
                    first = np.flatnonzero(np.diff(piece, prepend=np.uint16(piece[0] ^ 1)))
                    whole[piece[first]] += np.diff(first, append=len(piece))
        held = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(whole[held], pa.int64())], names=["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    # one row a bucket at most
    for r in blocks.select("stream").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of how much likelier each bucket is in the target, add-one smoothed, floored."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n)))) for a, b in zip(corpus.tolist(), target.tolist())],
        dtype=np.int32,
    )


def summed_gains(stream: np.ndarray, ends: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """Sum of the gains of each document's part of the stream, piece by piece, so that one very long text takes no more memory."""
    sums = np.zeros(len(ends), np.int64)
    starts = ends - np.diff(ends, prepend=0)
    docs = np.flatnonzero(ends > starts)  # reduceat has no empty segments
    starts = starts[docs]
    for a in range(0, len(stream), PIECE):
        b = min(a + PIECE, len(stream))
        first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")
        cuts = np.maximum(starts[first:last], a) - a
        sums[docs[first:last]] += np.add.reduceat(gains[stream[a:b]], cuts, dtype=np.int64)
    return sums


def _noise(seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from a document's id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of docs; rank says which are drawn, in which order.

    A document's features are its runs of 1 to `longest` words, hashed to
    buckets. Buckets are written once as packed streams; sorting and run-length
    encoding those of docs and of target (both have a column `text`) counts them;
    a second pass gathers the gains of each document's buckets and floors their
    mean, its weight. Score adds Gumbel noise, so the highest scores are a sample
    without replacement; of the documents with `min_words` words `percent` of a
    hundred are drawn, ties to smaller doc_id.

    Null and wordless texts have no features and weight 0. A null doc_id draws
    its noise as the text `null` and comes after others at equal scores. Rows
    repeated in doc_id are documents of their own and get ranks of their own.
    Very long texts make long streams, worked off in pieces. An empty docs gives
    an empty result, an empty target gains by the smoothing alone. Columns other
    than doc_id and text are not read.
    """
    blocks = checkpointed(bucket_streams(docs.select("doc_id", "text"), longest, buckets))
    corpus = bucket_counts(blocks, buckets)
    wanted = bucket_counts(bucket_streams(target.select("text"), longest, buckets, None), buckets)
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(corpus, wanted))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n_words, ends, data = (batch.column(c)[r] for c in ("doc_ids", "n_words", "ends", "stream"))
                ends = ends.values.to_numpy().astype(np.int64)
                n = np.diff(ends, prepend=0)
                sums = summed_gains(np.frombuffer(data.as_buffer(), "<u2"), ends, gains.value)
                weight = sums // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids.values, n_words.values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = blocks.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + _noise(seed))
    weighed = checkpointed(weighed.withColumn("row", F.monotonically_increasing_id()))
    fits = F.col("n_words") >= min_words
    drawn = weighed.where(fits).count() * percent // 100
    line = ranked(weighed, F.desc(fits), F.desc("score"), F.col("doc_id").asc_nulls_last(), "row", name="place")
    rank = F.when(fits & (F.col("place") < drawn), F.col("place") + 1)
    return line.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The sample itself: the rows of docs, unchanged, whose doc_id is drawn."""
    drawn = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(F.col("drawn")), "left_semi")
