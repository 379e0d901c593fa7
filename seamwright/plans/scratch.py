"""Cutting lineage in iterative plans."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a folder of its own only where a local session names none."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and context._jsc.sc().getCheckpointDir().isDefined():
        root = context._jsc.sc().getCheckpointDir().get()
    if root is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/seamwright-checkpoints-{uuid.uuid4().hex}"
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the reliable checkpoint folder."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as columns on the shared folder until the process ends: texts that recur take little room there, while cut keeps each of them."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/seamwright/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be closed
        pass
