"""A contained store of table versions, and what is built on it: checked publishing with roll-back, incremental export, batches that count once.

A version is a folder of Parquet files and a manifest that names it. Files are
written and checked before the manifest appears, which is one atomic rename, so
readers see a whole version or the one before, whatever fails in between.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import norm
from .components import _written

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*(/[A-Za-z0-9][A-Za-z0-9_.-]*)*")


class Refused(ValueError):
    """What was written doesn't hold; the version before stays."""


@dataclass
class Manifest:
    """A version: the folders that hold its rows, and notes such as a watermark."""

    version: int
    folders: list[str]
    rows: int
    schema: str
    batch: str | None = None
    restores: int | None = None
    notes: dict = field(default_factory=dict)


def _kind(schema: str) -> StructType:
    return StructType.fromJson(json.loads(schema))


class Store:
    """Tables under one folder that driver and executors share. One manifest is written at a time; of two writers one is refused."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _table(self, name: str) -> str:
        if not _NAME.fullmatch(name) or ".." in name:
            raise Refused(f"{name!r} is no place inside the store")
        return f"{self.root}/{name}"

    def versions(self, name: str) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self._table(name)}/_manifests")
        found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in found if re.fullmatch(r"\d+\.json", n))

    def manifest(self, name: str, version: int | None = None) -> Manifest | None:
        """The manifest of a version, the newest if none is named; None if there is none."""
        listed = self.versions(name)
        if not listed or version is not None and version not in listed:
            return None
        stream = self._fs().open(self._path(f"{self._table(name)}/_manifests/{listed[-1] if version is None else version:08d}.json"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, name: str, manifest: Manifest) -> Manifest:
        fs, folder = self._fs(), f"{self._table(name)}/_manifests"
        staged, target = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{manifest.version:08d}.json")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise Refused(f"another writer was first with version {manifest.version} of {name}")
        return manifest

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest if none is named; None if there is none."""
        held = self.manifest(name, version)
        if held is None:
            return None
        if not held.folders:
            return self.spark.createDataFrame([], _kind(held.schema))
        return self.spark.read.schema(_kind(held.schema)).parquet(*held.folders)

    def publish(
        self, name: str, df: DataFrame, checks: dict[str, Column] | None = None, append: bool = False, batch: str | None = None, notes: dict | None = None, least: int = 0
    ) -> Manifest:
        """Write df as a new version, or as further rows of it, once all checks hold for every row and there are `least` rows.

        The checks run on what was written, read back. If one fails, the files go
        and Refused names the check and how many rows break it. A batch that a
        version has already is not written again: the version that has it is
        returned, so a batch that is replayed after a failure counts once.
        """
        before = self.manifest(name)
        if batch is not None and (done := self.batch(name, batch)):
            return done
        folder = f"{self._table(name)}/_data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        written = self.spark.read.schema(df.schema).parquet(folder)
        broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, c in enumerate((checks or {}).values())]
        n, *bad = written.agg(F.count("*"), *broken).first()
        said = [f"{check}: {k} rows" for check, k in zip(checks or {}, bad) if k] + ([f"{n} rows, not {least}"] if n < least else [])
        kept = before.folders if append and before else []
        if append and before and _kind(before.schema).simpleString() != df.schema.simpleString():
            said.append(f"columns differ from {_kind(before.schema).simpleString()}")
        if said:
            self._fs().delete(self._path(folder), True)
            raise Refused("; ".join(said))
        if not n:
            self._fs().delete(self._path(folder), True)
        rows = n + (before.rows if append and before else 0)
        return self._commit(name, Manifest(before.version + 1 if before else 1, [*kept, *([folder] if n else [])], rows, df.schema.json(), batch, None, notes or (before.notes if append and before else {})))

    def batch(self, name: str, batch: str) -> Manifest | None:
        """The version that a batch made, if it counts now: not if it was rolled back since."""
        held = self.manifest(name)
        while held is not None:
            if held.restores is not None:
                held = self.manifest(name, held.restores)
            elif held.batch == batch:
                return held
            else:
                held = self.manifest(name, held.version - 1) if held.version > 1 else None
        return None

    def rollback(self, name: str, version: int | None = None) -> Manifest:
        """A new version with the rows of an earlier one, the one before the newest if none is named."""
        newest = self.manifest(name)
        wanted = self.manifest(name, newest.version - 1 if newest and version is None else version) if newest else None
        if wanted is None:
            raise Refused(f"{name} has no such version")
        return self._commit(name, Manifest(newest.version + 1, wanted.folders, wanted.rows, wanted.schema, None, wanted.restores or wanted.version, wanted.notes))

    def vacuum(self, name: str, keep: int = 2) -> int:
        """Delete the folders that none of the last `keep` versions names, left-overs of failed writers among them; gives their number."""
        fs, data = self._fs(), self._path(f"{self._table(name)}/_data")
        held = {f.rsplit("/", 1)[1] for v in self.versions(name)[-keep:] for f in self.manifest(name, v).folders}
        gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in held] if fs.exists(data) else []
        return sum(fs.delete(p, True) for p in gone)


# --- incremental export -------------------------------------------------------------------------------------------

_BLOCK = ("group_key", "place", "block")


def rendered(docs: DataFrame, ident: str, question: Column, title: Column, url: Column, text: Column, hint: Column | None = None) -> DataFrame:
    """(group_key, place, block): every group of equal questions as text blocks, a head in place 0 and then its sources by id.

    The head has the question as the first document says it, the number of
    sources, the newest id and the newest hint that isn't empty. Blocks of a
    group are rows, so a group of any size is written by many tasks; read in the
    order of place they are its document. Texts are whole, however long. Rows
    without a question are left out.
    """
    said = F.trim(F.coalesce(question, F.lit("")))
    rows = docs.select(
        F.substring(F.sha1(norm(question)), 1, 16).alias("group_key"), F.col(ident).cast("long").alias("id"), said.alias("question"),
        (F.coalesce(hint, F.lit("")) if hint is not None else F.lit("")).alias("hint"),
        F.concat(F.lit("### "), F.coalesce(F.nullif(F.concat_ws(" · ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(url), F.lit(""))), F.lit("")), F.lit("source")), F.lit("\n\n"), F.trim(F.coalesce(text, F.lit("")))).alias("block"),
    ).where("question <> ''")
    heads = rows.groupBy("group_key").agg(
        F.min_by("question", "id").alias("question"), F.count("*").alias("n"), F.max("id").alias("newest"), F.max_by("hint", F.when(F.col("hint") != "", F.col("id"))).alias("hint")
    )
    answer = F.when(F.col("hint") != "", F.concat(F.lit("\n## Answer\n\n"), "hint", F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("---\nhash: "), "group_key", F.lit("\nsources: "), "n", F.lit("\nnewest: "), "newest", F.lit("\n---\n# Question\n\n"), "question", F.lit("\n"), F.coalesce(answer, F.lit("")), F.lit("\n## Sources"))
    return heads.select("group_key", F.lit(-1).cast("long").alias("place"), head.alias("block")).union(rows.select("group_key", "id", "block"))


def export(store: Store, name: str, docs: DataFrame, ident: str, question: Column, title: Column, url: Column, text: Column, hint: Column | None = None, full: bool = False) -> dict:
    """Render the groups that have documents above the watermark (all with `full`), and publish those whose text has changed.

    Ids and questions of all documents tell the touched groups, and checksums of
    blocks those that changed; only their texts are shuffled. The store keeps,
    beside the blocks, one checksum per group; a run that changes nothing writes
    nothing. A failed run leaves watermark and blocks as they were. Returns
    counts and the watermark.
    """
    before = store.manifest(name)
    mark = -1 if full or before is None else int(before.notes.get("watermark", -1))
    key = F.substring(F.sha1(norm(question)), 1, 16)
    slim = docs.where(F.trim(F.coalesce(question, F.lit(""))) != "").select(key.alias("_key"), F.col(ident).cast("long").alias("_id"))
    groups = slim.groupBy("_key").agg(F.max("_id").alias("newest"))
    top, n_groups = groups.agg(F.max("newest"), F.count("*")).first()
    touched = groups.where(F.col("newest") > mark).select("_key")
    of = (ident, question, title, url, text, hint)
    # texts stay where they are for the checksums: each block is one number before rows meet the touched groups
    numbers = rendered(docs, *of).select("group_key", F.xxhash64("place", "block").alias("number"))
    numbers = numbers.join(touched, F.col("group_key") == F.col("_key"), "left_semi")
    sums = _written(numbers.groupBy("group_key").agg(F.sum(F.col("number").cast("decimal(38,0)")).cast("string").alias("checksum")))
    seen = sums.count()
    held = store.read(f"{name}.sums")
    fresh = sums if held is None else sums.join(_latest(held).select(F.col("group_key").alias("k"), F.col("checksum").alias("c")), (F.col("group_key") == F.col("k")) & (F.col("checksum") == F.col("c")), "left_anti")
    run = before.version + 1 if before else 1
    fresh = _written(fresh.withColumn("run", F.lit(run).cast("long")))
    changed = fresh.count()
    notes = {"watermark": max(mark, int(top if top is not None else -1), int(before.notes.get("watermark", -1)) if before else -1)}
    if changed or before is None:
        moved = docs.withColumn("_group", key).join(fresh.select(F.col("group_key").alias("_key")), F.col("_group") == F.col("_key"), "left_semi")
        moved = rendered(moved, *of).withColumn("run", F.lit(run).cast("long"))
        store.publish(f"{name}.sums", fresh, append=True)
        store.publish(name, moved, {"blocks have text": F.col("block").isNotNull()}, append=True, notes=notes)
    elif notes["watermark"] != before.notes.get("watermark"):
        store._commit(name, Manifest(run, before.folders, before.rows, before.schema, None, None, notes))
    return {"written": changed, "skipped": seen - changed, "groups": n_groups, "watermark": notes["watermark"]}


def _latest(rows: DataFrame) -> DataFrame:
    """The rows of each group's last run."""
    last = rows.groupBy(F.col("group_key").alias("_k")).agg(F.max("run").alias("_run"))
    return rows.join(last, (F.col("group_key") == F.col("_k")) & (F.col("run") == F.col("_run")), "left_semi")


def exported(store: Store, name: str) -> DataFrame:
    """(group_key, place, block, run) of every group as it was written last."""
    return _latest(store.read(name))


def due(sources: DataFrame, runs: DataFrame, now: Column, retry: float = 60.0) -> DataFrame:
    """(source, every, failures, since) of the sources whose turn it is: `every` seconds after the last good run.

    runs has source, at (seconds) and ok. After failures a source waits `retry`
    seconds, twice as long each time, `every` at most. One that never ran is due.
    """
    good = runs.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("_good"), F.max("at").alias("_last"))
    failed = runs.join(good.select("source", F.col("_good").alias("_g")), "source").where("NOT ok AND (_g IS NULL OR at > _g)").groupBy("source").agg(F.count("*").alias("_failed"))
    known = sources.join(good, "source", "left").join(failed, "source", "left").withColumn("failures", F.coalesce("_failed", F.lit(0)))
    waits = F.least(F.col("every"), F.lit(retry) * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(40))))
    ready = F.when(F.col("failures") > 0, F.col("_last") + waits <= now).otherwise(F.col("_good").isNull() | (F.col("_good") + F.col("every") <= now))
    return known.where(ready).select("source", "every", "failures", (now - F.col("_good")).alias("since"))
