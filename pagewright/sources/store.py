"""Cutting a plan with a reliable checkpoint."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A path for a new table in the shared folder, ``spark.checkpoint.dir``; only a local session may leave it unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and (master.startswith("local-cluster") or not master.startswith("local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or tempfile.mkdtemp(prefix='pagewright-')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir``, which the cluster sets; only a local session may leave it unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        set_in_session = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not set_in_session and (context.master.startswith("local-cluster") or not context.master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(set_in_session or tempfile.mkdtemp(prefix="pagewright-"))
    return df.checkpoint()
