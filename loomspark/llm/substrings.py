"""Substring dedup with super-k-mers: windows that share a minimiser travel as one packed string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices

#: Words in a window, and in the part of it that names its bucket.
WINDOW, PART = 13, 3
#: Share of the documents sampled to find crowded buckets; which ones are found changes the route of windows, never the result.
SAMPLED = 1 / 16
#: A bucket is crowded with this many sampled super-k-mers and this share of all of them, which bounds their number.
CROWDED, CROWDED_SHARE = 8, 1 / (1 << 18)
#: Windows that a task holds: of crowded buckets before it sends them on, and of a bucket it has received.
GATHERED = 200_000
#: Bytes of super-k-mers that a task gathers for each shuffle partition before it bundles them: at least and at most for all together.
BUNDLE, LEAST_BUNDLED, BUNDLED = 1 << 18, 1 << 24, 1 << 25
#: Bytes of spans up to which they are broadcast.
SMALL = 1 << 26


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 42) >> 1
        return h


class Cutter:
    """Cuts texts into super-k-mers; remembers the hashes of words."""

    def __init__(self) -> None:
        self.known = _Hashes()

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(minimiser, first window, number of windows) of the runs of windows with the same minimiser.

        A window's minimiser is its run of PART words with the smallest hash, by
        the high 40 bits, then the first, so equal windows have equal minimisers
        wherever they stand. The low bits have the place, within 2^24 words.
        """
        if len(words) < WINDOW:
            return (np.zeros(0, np.int64),) * 3
        if len(words) > 1 << 24:
            half = len(words) // 2
            left, right = self.cut(words[: half + WINDOW - 1]), self.cut(words[half:])
            return tuple(np.concatenate([x, y]) for x, y in zip(left, (right[0], right[1] + half, right[2])))
        if len(self.known) > 1 << 18:
            self.known.clear()
        h = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)).view(np.uint64)
        n = len(h) - PART + 1
        mixed = np.zeros(n, np.uint64)
        for i in range(PART):
            mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        low = np.uint64((1 << 24) - 1)
        least = (mixed & ~low) | np.arange(n, dtype=np.uint64)
        have, width = 1, WINDOW - PART + 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (least & low).astype(np.int64)
        start = np.flatnonzero(np.diff(place, prepend=-1))
        return mixed[place[start]].view(np.int64), start, np.diff(start, append=len(place))


def crowded_buckets(rows: DataFrame) -> np.ndarray:
    """Minimisers that hold a large share of a sample's super-k-mers, in rising order; fewer than 1 / CROWDED_SHARE of them."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        for batch in slices(batches):
            found = [cutter.cut(t.split())[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["bucket"])

    counts = checkpointed(rows.select("text").sample(SAMPLED, seed=7).mapInArrow(buckets, "bucket long").groupBy("bucket").count())
    least = max(CROWDED, int((counts.agg(F.sum("count")).first()[0] or 0) * CROWDED_SHARE))
    return np.array(sorted(r.bucket for r in counts.where(F.col("count") >= least).select("bucket").collect()), dtype=np.int64)


_WINDOWS = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("packed", pa.binary())])


def _spans_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and doc_id: windows already met under a smaller doc_id become spans.

    The first document of each window is remembered until the bucket ends. When
    that are GATHERED windows, they go on one by one, to be settled with others
    of their kind, and the bucket's rest begins anew; so memory is bounded
    whatever a bucket holds.
    """
    now, first, held, whole = None, {}, 0, True  # whole: nothing of the bucket has gone on yet

    def onward() -> list[tuple]:
        return [
            (xxhash.xxh64_intdigest(text, 1) - (1 << 63), seen[0], crc, start, 1, text)
            for window, seen in first.items()
            for text in [b" ".join(window)]
            for crc, start in zip(seen[1::2], seen[2::2])
        ]

    for batch in batches:
        out: list[tuple] = []
        bucket, doc = batch.column("bucket").to_numpy(), batch.column("doc_id").to_numpy()
        n = batch.num_rows
        edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [n]]) if n else np.zeros(1, np.int64)
        crcs, starts, sizes, packed = (batch.column(c) for c in ("crc", "start", "size", "packed"))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if bucket[a] != now:
                if not whole:
                    out += onward()
                now, first, held, whole = bucket[a], {}, 0, True
                if b < n and doc[a] == doc[b - 1] and packed.slice(a, b - a).null_count == 0:
                    continue  # one document only
            for r in range(a, b):
                d, crc, at, size = int(doc[r]), crcs[r].as_py(), starts[r].as_py(), sizes[r].as_py()
                if (text := packed[r].as_py()) is None:  # a span found before
                    out.append((0, d, crc, at, size, None))
                    continue
                words, run = text.split(b" "), 0
                for i in range(size):
                    window = tuple(words[i : i + WINDOW])
                    seen = first.get(window)
                    if seen is not None and seen[0] < d:
                        run += 1
                        continue
                    if seen is None:
                        first[window] = [d, crc, at + i]
                    else:  # again in the first document that has it
                        seen += (crc, at + i)
                    held += 1
                    if run:
                        out.append((0, d, crc, at + i - run, run, None))
                        run = 0
                if run:
                    out.append((0, d, crc, at + size - run, run, None))
                if held >= GATHERED:
                    out += onward()
                    first, held, whole = {}, 0, False
        yield _batch(out)
    if not whole:
        yield _batch(onward())


def _spans_of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows sorted by their hash and doc_id: all that a smaller doc_id has too are spans.

    Only the first document of each window is remembered, and only until the
    hash changes, so any number of occurrences takes no memory.
    """
    now, first = None, {}
    for batch in batches:
        out: list[tuple] = []
        for b, doc, crc, start, window in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "crc", "start", "packed"))):
            if b != now:
                now, first = b, {}
            if first.setdefault(window, doc) < doc:
                out.append((0, doc, crc, start, 1, None))
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_WINDOWS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _WINDOWS)], schema=_WINDOWS)


_TRAVEL = "bucket long, doc_id long, crc long, start int, size int, packed binary"


def _bundle(rows: list[tuple]) -> bytes:
    """Rows as one compressed Arrow stream; super-k-mers overlap, so together they shrink far more than row by row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _WINDOWS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
        stream.write_batch(_batch(rows))
    return sink.getvalue().to_pybytes()


def _unbundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle in batch.column("bundle"):
            yield from pa.ipc.open_stream(bundle.as_buffer())


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, starts, ends): word spans whose windows also start in a document with a smaller doc_id.

    crc is the text's xxhash64. Super-k-mers go to the bucket of their
    minimiser, in compressed bundles, and sorting by doc_id shows there which
    windows came before. Windows of crowded buckets travel one by one to a
    bucket of their own, after each task has settled those it holds itself, so a
    passage that many documents share is gathered before the shuffle.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("crc"), F.encode("text", "utf-8").alias("text")
    )
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_buckets(rows))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LEAST_BUNDLED, min(BUNDLED, parts * BUNDLE))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, crowds = Cutter(), crowded.value
        held: dict[bytes, list] = {}  # window -> [doc_id, crc, starts]

        bundles: dict[int, list[tuple]] = {}

        def out() -> pa.RecordBatch:
            made = [(k, _bundle(rows)) for k, rows in bundles.items()]
            bundles.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["part", "bundle"])

        def deal(lines: list[tuple]) -> int:
            for line in lines:
                bundles.setdefault(line[6] if len(line) > 6 else line[0] % parts, []).append(line[:6])
            return sum(100 + len(line[5] or b"") for line in lines)

        def flush() -> list[tuple]:
            lines = [
                (xxhash.xxh64_intdigest(w, 1) - (1 << 63), doc, crc, s, 1, w) for w, (doc, crc, starts) in held.items() for s in starts
            ]
            held.clear()
            return lines

        gathered = 0
        for batch in slices(batches):
            lines: list[tuple] = []
            for doc, crc, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "crc", "text"))):
                words = text.split()
                minimiser, start, size = cutter.cut(words)
                place = np.searchsorted(crowds, minimiser)
                hot = crowds[np.minimum(place, len(crowds) - 1)] == minimiser if len(crowds) else np.zeros(len(minimiser), bool)
                settled: list[tuple[int, int, int]] = []  # (doc_id, crc, start)
                for b, s, n, many in zip(minimiser.tolist(), start.tolist(), size.tolist(), hot.tolist()):
                    if not many:
                        # half of the hash deals, the other half names the bucket; two in one bucket do no harm
                        lines.append((b >> 32, doc, crc, s, n, b" ".join(words[s : s + n + WINDOW - 1]), b % parts))
                        continue
                    for i in range(s, s + n):
                        window = b" ".join(words[i : i + WINDOW])
                        seen = held.get(window)
                        if seen is None:
                            held[window] = [doc, crc, [i]]
                        elif seen[0] < doc:
                            settled.append((doc, crc, i))
                        elif seen[0] > doc:
                            settled += [(seen[0], seen[1], j) for j in seen[2]]
                            held[window] = [doc, crc, [i]]
                        elif seen[1] == crc:
                            if seen[2][-1] < i:  # else a repeated row
                                seen[2].append(i)
                        else:  # the same doc_id with another text
                            lines.append((xxhash.xxh64_intdigest(window, 1) - (1 << 63), doc, crc, i, 1, window))
                settled.sort()
                k = 0
                while k < len(settled):
                    d, c, s = settled[k]
                    n = 1
                    while k + n < len(settled) and settled[k + n] == (d, c, s + n):
                        n += 1
                    lines.append((c ^ s, d, c, s, n, None))
                    k += n
                if gathered + len(lines) * 100 > most:
                    gathered += deal(lines)
                    lines = []
                    if gathered > most:
                        yield out()
                        gathered = 0
            if len(held) > GATHERED:
                lines += flush()
            gathered += deal(lines)
            if gathered > most:
                yield out()
                gathered = 0
        deal(flush())
        yield out()

    sent = rows.mapInArrow(send, "part int, bundle binary").repartitionById(parts, F.col("part"))
    travelled = sent.mapInArrow(_unbundle, _TRAVEL).sortWithinPartitions("bucket", "doc_id")
    found = checkpointed(travelled.mapInArrow(_spans_in_buckets, _TRAVEL))
    more = found.where("packed IS NOT NULL").repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(_spans_of_windows, _TRAVEL)
    spans = found.where("packed IS NULL").union(more)
    listed = spans.groupBy("doc_id", "crc").agg(F.collect_set(F.struct("start", "size")).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for spans in batch.column("spans").to_pylist():
                begin: list[int] = []
                end: list[int] = []
                for s in sorted((x["start"], x["size"]) for x in spans):
                    stop = s[0] + s[1] + WINDOW - 1
                    if end and s[0] <= end[-1]:
                        end[-1] = max(end[-1], stop)
                    else:
                        begin.append(s[0]), end.append(stop)
                starts.append(begin), ends.append(end)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("crc"), pa.array(starts, kind), pa.array(ends, kind)], names=["doc_id", "crc", "starts", "ends"]
            )

    return listed.mapInArrow(merge, "doc_id long, crc long, starts array<int>, ends array<int>")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space) of every row.

    A word goes if a window of WINDOW words that covers it also starts in a
    document with a smaller doc_id. Null text has no words; texts under WINDOW
    words lose none; a document with a null doc_id neither loses words nor
    makes others lose any; rows repeated in doc_id and text get equal results;
    very long texts are cut piece by piece, and their spans are held by one
    task; an empty table gives an empty result; other columns are not read.
    """
    spans = checkpointed(repeated_spans(docs)).withColumnsRenamed({"doc_id": "doc", "crc": "its"})
    # two numbers and the two arrays of a row in bytes, so a broadcast is bounded in bytes
    size = spans.agg(F.sum(F.size("starts") * 8 + 64)).first()[0] or 0
    spans = F.broadcast(spans) if size <= SMALL else spans
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("key")).join(spans, F.expr("doc_id = doc AND key = its"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, removed, sha, kept = [], [], [], []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                words = text.split()
                left, at = [], 0
                for s, e in zip(starts or (), ends or ()):
                    left += words[at:s]
                    at = e
                left += words[at:]
                joined = b" ".join(left)
                n.append(len(words)), removed.append(len(words) - len(left)), sha.append(hashlib.sha256(joined).hexdigest()), kept.append(joined)
            made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    source = rows.select("doc_id", F.encode("text", "utf-8").alias("text"), "starts", "ends")
    schema = source.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "binary")
    return source.mapInArrow(cut, schema).withColumn("kept", F.decode("kept", "utf-8"))
