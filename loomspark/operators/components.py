"""Connected components of pairs by label propagation with pointer jumping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that the cluster shares (spark.checkpoint.dir; on one machine a temporary one where unset)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def _written(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of a pair reaches.

    Each round a node takes the smallest label around it and then its label's
    label, so the distance to the smallest node halves at least every other
    round; every round groups and joins by node and is written out.
    """
    ways = F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))
    links = _written(pairs.select(F.explode(ways).alias("w")).select("w.x", "w.y").distinct())
    labels = _written(links.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).select(F.col("x").alias("node"), "label"))
    while True:
        around = links.join(labels, links.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        nearer = labels.join(around, labels.node == around.x).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        after = nearer.join(jump, F.col("new") == F.col("_n"), "left").select("node", "label", F.least("new", F.coalesce("_l", "new")).alias("new"))
        after = _written(after)
        changed = after.where("label <> new").limit(1).count()
        labels = after.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
