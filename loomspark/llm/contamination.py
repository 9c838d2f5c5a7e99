"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, if_small, lower_az

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def _shingles(words: Column, width: Column | int) -> Column:
    """All runs of `width` words, space-joined; none if there are fewer words."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(1), F.size(words) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, width)))


def _hashes(hashes: Column, width: int) -> Column:
    """A hash of each run of `width` words, from the words' hashes."""
    starts = F.when(F.size(hashes) >= width, F.sequence(F.lit(1), F.size(hashes) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(width)]))


def item_sketches(benchmark: DataFrame, containment: float, k: int) -> DataFrame:
    """One row per distinct item: item (a number), item_id (its smallest), width, shingles, n, need and sketch.

    Items are partitioned by size, in powers of two of their number n of
    distinct shingles. A document that holds `need` of the n shingles misses
    n - need at most, so it holds one of any n - need + 1: the sketch is that
    many of the smallest hashes (bottom-k MinHash), with the bound of the
    largest size in the partition. Shingles that fewer items hold come first, so
    an opening that many items share is in none of their sketches unless they
    have too little else. Items shorter than k words have one shingle, their
    whole text; items without words are left out.
    """
    words = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(k))
    listed = words.select("item_id", width.alias("width"), F.array_sort(F.array_distinct(_shingles(F.col("words"), width))).alias("shingles"))
    whole = listed.groupBy("width", "shingles").agg(F.min("item_id").alias("item_id")).withColumn("n", F.size("shingles"))
    # a shingle's hash is made of its words' hashes, as in the documents
    def hashed(w: int) -> Column:
        return F.transform("shingles", lambda s: F.element_at(_hashes(F.transform(F.split(s, " "), lambda x: F.xxhash64(x)), w), 1))

    by_width = F.coalesce(*[F.when(F.col("width") == w, hashed(w)) for w in range(1, k + 1)])
    largest = F.pow(F.lit(2), F.ceil(F.log2("n")))
    misses = largest - F.ceil(largest * F.lit(containment)) + 1
    numbered = checkpointed(whole.select(
        F.monotonically_increasing_id().alias("item"),
        "item_id",
        "width",
        "shingles",
        "n",
        F.ceil(F.round(F.col("n") * F.lit(containment), 6)).cast("int").alias("need"),
        F.least(F.col("n"), misses.cast("int")).alias("size"),
        by_width.alias("hashes"),
    ))
    each = numbered.select("item", "size", F.explode("hashes").alias("hash"))
    common = each.groupBy("hash").agg(F.count("*").alias("items"))
    ordered = each.join(common, "hash").groupBy("item", "size").agg(F.array_sort(F.collect_list(F.struct("items", "hash"))).alias("all"))
    sketch = ordered.select(F.col("item").alias("i"), F.slice(F.col("all.hash"), 1, F.col("size")).alias("sketch"))
    return numbered.join(sketch, F.col("item") == F.col("i")).drop("i", "size", "hashes")


def candidate_pairs(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """(doc, item) of documents, given as (doc_id, m, hash), that hold a hash of the item's sketch and are large enough for it."""
    return rows.join(if_small(sketch, 1_000_000), "hash").where("m >= need").select(F.col("doc_id").alias("doc"), "item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, k: int = 5) -> DataFrame:
    """One row per document that holds a benchmark item: doc_id, item_id, containment and n_items.

    An item is held if `containment` of its distinct k-word shingles (A-Z in lower
    case, letters and digits) occur in the document. Sketch hashes meet the
    documents' shingle hashes, unless the document is too small for an item of
    that size; each document and item that meet are verified: the item's shingles
    are looked up among the document's own and counted. Equal items count once,
    under their smallest item_id. item_id is the best item (ties: the smallest),
    n_items the number held.

    Null texts and texts without words hold nothing; rows that share a doc_id
    give one row with the best of them; null ids are reported as null; a very
    long text is split into words within one task; empty tables give an empty
    result; other columns are not read.
    """
    items = checkpointed(item_sketches(benchmark, containment, k))
    widths = sorted(r.width for r in items.select("width").distinct().limit(k).toLocalIterator()) or [k]
    docs = docs.select("doc_id", "text")
    words = docs.select("doc_id", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    hashed = words.select("doc_id", F.array_distinct(F.concat(*[_hashes(F.col("words"), w) for w in widths])).alias("hashes"))
    # explode() would infer a filter that repeats all of the above for every shingle; explode_outer() does not
    rows = hashed.select("doc_id", F.size("hashes").alias("m"), F.explode_outer("hashes").alias("hash"))
    sketch = checkpointed(items.select(F.explode("sketch").alias("hash"), "item", "need"))
    candidates = checkpointed(candidate_pairs(rows, sketch))
    met = checkpointed(candidates.select("doc").distinct())
    texts = docs.join(if_small(met, 1_000_000), F.expr("doc_id <=> doc"), "left_semi")
    texts = texts.select("doc_id", F.xxhash64("text").alias("crc"), _words(F.col("text")).alias("words"))
    held = texts.select("doc_id", "crc", F.array_distinct(F.concat(*[_shingles(F.col("words"), F.lit(w)) for w in widths])).alias("own"))
    held = held.select("doc_id", "crc", F.explode_outer("own").alias("shingle"))
    wanted = checkpointed(items.select("item", "item_id", "n", "need", F.explode("shingles").alias("shingle")))
    listed = checkpointed(wanted.select("shingle").distinct())
    held = held.join(if_small(listed, 1_000_000), "shingle", "left_semi")
    asked = candidates.join(if_small(wanted, 1_000_000), "item").withColumnRenamed("shingle", "its")
    shared = held.join(asked, F.expr("doc_id <=> doc AND shingle = its")).groupBy("doc_id", "crc", "item", "item_id", "n", "need")
    true = shared.agg(F.count_distinct("shingle").alias("common")).where("common >= need")
    pairs = true.groupBy("doc_id", "item", "item_id").agg(F.max(F.col("common") / F.col("n")).alias("share"))
    best = F.max(F.struct("share", (-F.col("item_id")).alias("least")))
    return pairs.groupBy("doc_id").agg(best.alias("best"), F.count("*").alias("n_items")).select(
        "doc_id", (-F.col("best.least")).alias("item_id"), F.round("best.share", 6).alias("containment"), "n_items"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item, all columns unchanged."""
    own = fresh(docs.columns, "_doc")
    gone = checkpointed(contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(own)))
    return docs.join(if_small(gone, 1_000_000), F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
