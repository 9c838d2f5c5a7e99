"""Sharding along a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

#: Bits to which each dimension is quantised.
BITS = 8


def hilbert_index(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of points given as rows of quantised coordinates.

    The usual two passes over the bits, from high to low: undo the rotations of
    every sub-cube, then Gray-code, then interleave.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        fix ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= fix
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | x[i] >> b & 1
    return index


def _curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([s.to_numpy(np.int64) for s in (a, b, c, d)], axis=1)))


def _code(df: DataFrame, name: str) -> Column:
    """A value's place among all distinct values of the column, in 0 to 2**BITS - 1; null comes first.

    The distinct values are ranked by a range sort, and only the first value of
    each place, 2**BITS at most, goes to the driver and into the expression.
    """
    placed = ranked(df.select(F.col(name).alias("value")).distinct(), F.col("value").asc_nulls_first(), name="place")
    n = max(1, placed.count())
    place = lambda at: F.floor(at * (1 << BITS) / F.lit(n))
    firsts = placed.where((F.col("place") == 0) | (place(F.col("place")) != place(F.col("place") - 1)))
    rows = sorted((int(r.code), r.value) for r in firsts.select(place(F.col("place")).cast("int").alias("code"), "value").collect() if r.value is not None)
    if not rows:
        return F.lit(0)
    starts, codes = F.array(*[F.lit(v) for _, v in rows]), F.array(F.lit(0), *[F.lit(c) for c, _ in rows])
    held = F.size(F.filter(starts, lambda start: start <= F.col(name)))
    return F.when(F.col(name).isNull(), 0).otherwise(F.element_at(codes, held + 1))


def _size_code(df: DataFrame, size: Column) -> Column:
    """A size's place among the sizes of all rows, in 0 to 2**BITS - 1, so that every code holds as many rows.

    Sizes are counted in steps of about one in a hundred; the counts of the
    steps, some 4,000 at most, go to the driver.
    """
    step = F.floor(F.log2(size) * 64).cast("int")
    counts = {r.step: r["count"] for r in df.groupBy(step.alias("step")).count().collect()}
    if not counts:
        return F.lit(0)
    low, n, before, codes = min(counts), sum(counts.values()), 0, []
    for s in range(low, max(counts) + 1):
        codes.append((before << BITS) // n)
        before += counts.get(s, 0)
    return F.element_at(F.array(*[F.lit(c) for c in codes]), step - low + 1)


def _spread(value: Column, low: int, high: int) -> Column:
    """Quantise a number between two bounds."""
    top = (1 << BITS) - 1
    return F.floor((F.coalesce(value, F.lit(low)) - F.lit(low)) / F.lit(max(1, high - low)) * top).cast("int")


def shard(docs: DataFrame, shards: int = 24, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, curve, shard and slot; with `whole` all columns of docs too.

    Source, language, text size (by rank) and doc_id (arrival) are quantised and mapped to a Hilbert index; documents are sorted by it and the
    sorted run is cut into `shards` pieces whose counts differ by one at most,
    so a filter on any of the dimensions needs few shards. Ties on the curve
    follow the text's checksum, then doc_id; repeated rows get slots of their
    own. Of a very long text only size and checksum are used. Null text counts as empty, a null in a dimension (doc_id too) as its
    smallest value; an empty table gives an empty result; other columns are not
    read without `whole`, and replaced where they are named like added ones.
    """
    added = ("size", "text_crc32", "curve", "shard", "slot")
    data = F.coalesce(F.encode("text", "utf-8"), F.encode(F.lit(""), "utf-8"))
    size = (F.octet_length(data) + 8).cast("long")
    bounds = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = (int(x) if x is not None else 0 for x in bounds)
    slim = docs.select(
        "doc_id",
        _code(docs, "source").alias("source"),
        _code(docs, "lang").alias("lang"),
        size.alias("size"),
        _size_code(docs, size).alias("size_code"),
        F.crc32(data).alias("text_crc32"),
        *([F.struct(*[docs[c] for c in docs.columns if c not in added]).alias("row")] if whole else []),
    )
    curve = F.pandas_udf(_curve, "long")  # made here, as workers import this module without a session
    points = slim.withColumn("curve", curve("source", "lang", "size_code", _spread(F.col("doc_id"), low, high)))
    line = ranked(points.drop("source", "lang", "size_code"), "curve", "text_crc32", "doc_id", name="at")
    n = line.count()
    placed = line.withColumn("shard", F.expr(f"CAST((at * {shards}) DIV {max(1, n)} AS INT)"))
    placed = placed.withColumn("slot", F.expr(f"at - ((CAST(shard AS BIGINT) * {n} + {shards - 1}) DIV {shards})"))
    return placed.select(*(["row.*"] if whole else ["doc_id"]), *added)
