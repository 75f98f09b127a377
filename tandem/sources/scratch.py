"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    """The checkpoint folder.  Unset, a folder of our own serves a local master only; a cluster needs the setting."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tandem-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{_root(spark)}/{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder and read from there: the plan above is cut and a lost executor costs a task.

    What depends on how rows happened to be dealt out (a partition's number, a row's
    place in it) stays as it was written.
    """
    _root(rows.sparkSession)
    return rows.checkpoint()
