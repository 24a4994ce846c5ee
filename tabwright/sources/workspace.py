"""Where intermediate tables live: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session, as in tests, may leave
    it out and gets a folder of its own; on a cluster a machine's folder would be seen
    by that machine alone, so a missing setting is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that executors share")
        folder = tempfile.mkdtemp(prefix="tabwright-")
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{shared_dir(spark).rstrip('/')}/tabwright/{uuid.uuid4().hex}/{name}"


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint that outlives lost executors."""
    folder, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
