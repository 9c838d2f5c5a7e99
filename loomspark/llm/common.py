"""Helpers the operators share: word patterns, checkpoints, ranks and links."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A word of letters and digits; everything from U+0080 on counts as a letter.
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, _UPPER, _LOWER)


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(columns: Iterable[str], name: str) -> str:
    """`name`, lengthened until no column has it; Spark's names ignore case."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches, which Spark bounds in bytes, in pieces of few rows, as what is made of a text may be larger than it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_batch(
    df: DataFrame, carry: list[str], adds: dict[str, str], measure: Callable[[list[bytes]], list[tuple]], text: str = "text"
) -> DataFrame:
    """df's columns in `carry` and what measure() gives for a list of texts, as UTF-8 bytes; null counts as empty.

    Carried values pass unchanged, nulls included.
    """
    added = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in adds.items()))
    kinds = [to_arrow_type(f.dataType) for f in added]
    schema = StructType([*df.select(*[df[c] for c in carry]).schema, *added])
    own = fresh(carry, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = measure([t or b"" for t in batch.column(own).to_pylist()])
            columns = [pa.array(list(c), k) for c, k in zip(zip(*made), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + columns, names=[*carry, *adds])

    return df.select(*[df[c] for c in carry], F.encode(df[text], "utf-8").alias(own)).mapInArrow(run, schema)


def per_text(df: DataFrame, carry: list[str], adds: dict[str, str], measure: Callable[[bytes], tuple], text: str = "text") -> DataFrame:
    """per_batch() with a measure of one text."""
    return per_batch(df, carry, adds, lambda texts: [measure(t) for t in texts], text)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a temporary folder takes its place, on one machine only:
    elsewhere the executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}"


_apart: ContextVar[str] = ContextVar("apart", default="tables")


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Inside, Arrow batches have few rows, as one text may be long; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, where a lost executor takes nothing along.

    Unlike checkpoint(), this computes df once. The tables of an application
    stay until clear_checkpoints().
    """
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{_apart.get()}/{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_checkpoints(spark: SparkSession) -> None:
    """Delete the tables that checkpointed() wrote for this application; what still reads them fails afterwards."""
    _delete(spark, application_folder(spark))


@contextmanager
def tables_apart(spark: SparkSession, name: str) -> Iterator[None]:
    """Inside, checkpointed() writes to a folder of that name; what was in it goes first."""
    _delete(spark, f"{application_folder(spark)}/{name}")
    before = _apart.set(name)
    try:
        yield
    finally:
        _apart.reset(before)


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Number all rows from 0 in the given order without a one-task window.

    A range sort spreads the rows, each partition numbers its own, and the
    partitions' counts (one row each, so the broadcast is bounded by the number
    of partitions) give the offsets. The checkpoint fixes the sort's boundaries.
    """
    at, number = fresh(df.columns, "_at"), fresh(df.columns, "_part")
    placed = checkpointed(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(at, 33)
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    offset = fresh(df.columns, "_before")
    offsets = placed.groupBy(part.alias(number)).agg(F.count("*").alias("n")).select(number, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(offset))
    inside = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(number, part).join(F.broadcast(offsets), number).withColumn(name, F.col(offset) + inside).drop(number, at, offset)


#: Bytes up to which a counted table is broadcast.
SMALL = 1 << 26


def if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Ask for a broadcast only if a count shows at most max_rows rows and SMALL bytes; else leave the join to shuffle.

    Give it a checkpointed table, so that the count costs little.
    """
    size = F.lit(16 + 8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(df[name]), F.lit(0))
        elif kind in ("array<int>", "array<bigint>"):
            size += F.coalesce(8 * F.size(df[name]), F.lit(0))
    n, size = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= SMALL else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, component): the smallest node reachable.

    Alternates large-star and small-star steps, so paths shrink geometrically;
    every step groups and joins by node and is written out. Nodes without an
    edge are not in the result.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    pairs = checkpointed(pairs)
    before = None
    while True:
        # large star: every node's larger neighbours point to its smallest neighbour
        ways = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
        both = pairs.select(F.explode(ways).alias("way")).select("way.x", "way.y")
        least = both.groupBy("x").agg(F.min("y").alias("low")).select(F.col("x").alias("node"), F.least("x", "low").alias("least"))
        large = checkpointed(both.where("y > x").join(least, F.col("x") == F.col("node")).select("least", "y").where("least < y").distinct())
        # small star: every node and its smaller neighbours point to the smallest of them
        low = large.groupBy("y").agg(F.min("least").alias("low")).withColumnRenamed("y", "node")
        hung = large.join(low, F.col("y") == F.col("node")).select("low", F.explode(F.array("least", "y")).alias("v"))
        pairs = checkpointed(hung.where("low < v").select(F.col("low").alias("u"), "v").distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = pairs.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.union(pairs.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
