"""Write-side operators as new snapshots: ingest, upsert, change logs, retention, queues, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import top_per_group


def ingest(new: DataFrame, archive: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of `new` to append: the first of each key that the archive does not hold; rows without a key are none.

    What goes is anti-joined: keys that the archive holds, then later rows of a key.
    """
    unknown = new.where(F.col(key).isNotNull()).join(archive.select(key), key, "left_anti")
    several = unknown.groupBy(key).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    gone = unknown.select(key, order).join(several, key).where(F.col(order) != F.col("_first")).select(key, order)
    return unknown.join(gone, [key, order], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, changes: list[str]) -> DataFrame:
    """old with `changes` taken from new where the key exists, and new's other rows added; other columns survive."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    columns = []
    for c in old.columns:
        if c == key or c not in changes:
            columns.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            columns.append(F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def apply_changes(ops: DataFrame, key: str, op: str, value: str, order: list[str]) -> DataFrame:
    """State after add, update and delete operations in order: the last operation decides; deletes leave nothing.

    An update without a value keeps the value before it.
    """
    last_op = F.max_by(op, F.struct(*order))
    gone = F.max(F.when(F.col(op) == "delete", F.struct(*order)))
    state = ops.groupBy(key).agg(last_op.alias("_op"), gone.alias("_gone"))
    latest = ops.where(F.col(value).isNotNull() & (F.col(op) != "delete")).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(F.struct(*order)).alias("_at"))
    kept = state.where(F.col("_op") != "delete").join(latest, key, "left")
    alive = F.when(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone")), F.col(value))
    return kept.select(key, alive.alias(value))


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return top_per_group(df, keys, order, n)


def retain(df: DataFrame, category: str, ts: str, now: Column, days: dict[str, int], default: int) -> DataFrame:
    """Rows younger than their category's days; 0 keeps all."""
    limit = F.lit(default)
    for name, d in days.items():
        limit = F.when(F.col(category) == name, d).otherwise(limit)
    age = F.datediff(now, F.to_date(ts))
    return df.where((limit == 0) | (age <= limit))


def not_queued(new: DataFrame, queue: DataFrame, key: str, open_rows: Column) -> DataFrame:
    """Rows whose key has no open row in the queue."""
    return new.join(queue.where(open_rows).select(key).distinct(), key, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Snapshot replace: only the partitions that df has are overwritten."""
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def normalize_entries(rows: DataFrame, raw: str) -> DataFrame:
    """Calendar entries from JSON with the field names and shapes of several services: uid, title, start, end, location, calendar and notes.

    A date may be a string or an object that holds one; an entry without an id
    is named by its title and start.
    """
    of = lambda path: F.get_json_object(F.col(raw), path)

    def field(*names: str) -> Column:
        said = []
        for n in names:
            whole = of(f"$.{n}")
            inner = F.coalesce(*[of(f"$.{n}.{k}") for k in ("dateTime", "date", "value", "start", "text")], F.lit(""))
            said.append(F.nullif(F.when(F.startswith(whole, F.lit("{")), inner).otherwise(whole), F.lit("")))
        return F.trim(F.coalesce(*said, F.lit("")))

    out = rows.withColumns(
        {
            "title": field("title", "summary"), "start": field("start", "when"), "end": field("end"), "location": field("location"),
            "calendar": field("calendar", "cal"), "notes": field("notes", "description"), "uid": field("id", "uid"),
        }
    )
    return out.withColumn("uid", F.when(F.col("uid") != "", F.col("uid")).otherwise(F.concat_ws("@", "title", "start")))
