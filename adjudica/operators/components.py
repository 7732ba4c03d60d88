"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the session names one (a cluster's shared folder), else the checkpoint folder that was set.
    Without either, a local session has one of its own; on a cluster that is an error, as executors share no local folder."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adjudica-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_STORED: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``clear_stored`` deletes."""
    _STORED.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _STORED[-1]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: lineage ends there, and a lost executor costs a read,
    not a recomputation. The table stays until ``clear_stored``, as later plans may read it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession) -> int:
    """Deletes the tables and files that this process has stored; call it when no result that reads them is needed any more."""
    jvm, n = spark.sparkContext._jvm, len(_STORED)
    for path in _STORED:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _STORED.clear()
    return n


@contextmanager
def rows_a_batch(spark: SparkSession, n: int):
    """Where rows are long lists or bytes, few of them are sent to Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reached. Null ends are no edges.

    A round takes the smallest label among a node's neighbours and then that label's own label, so that
    chains shrink geometrically; rounds end when no label changes, and only whether one did comes to the driver.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).select(F.col("a").alias("node"), "label"), "cc-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("beyond"))
        nxt = stored(step.join(jump, F.col("new") == F.col("j"), "left").select("node", "old", F.coalesce(F.least("new", "beyond"), "new").alias("label")), "cc-labels")
        changed = nxt.where("old <> label").limit(1).count()
        labels = nxt.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
