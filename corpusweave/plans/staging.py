"""Tables written to the cluster's shared folder, used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def default_root(spark: SparkSession) -> None:
    """For tests and trials: name a folder where none is set.

    On a single machine that is a temporary folder, on a cluster one in the warehouse, which
    all executors share.
    """
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        root = tempfile.mkdtemp(prefix="corpusweave-")
    else:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staged-tables"
    # The setting itself is fixed once a session has begun.
    spark.sparkContext.setCheckpointDir(root)


def shared_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it back.

    The result survives lost executors, carries no lineage, and its size on disk is
    known to the optimizer, so later joins are sized from facts instead of estimates.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def remove(*staged: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for df in staged:
        path = getattr(df, "_staged_at", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage_observed(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stage`` that also aggregates ``metrics`` over the rows while they are written."""
    observation = Observation(label)
    observed = df.observe(observation, *[m.alias(name) for name, m in metrics.items()])
    return stage(observed, label), observation.get
