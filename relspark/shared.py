"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder. Where none is set it becomes the one that spark.checkpoint.dir names.

    With neither, a local master gets a folder of this machine (tests); on a cluster that is a RuntimeError, as executors
    would not see one another's files.
    """
    context = spark.sparkContext
    if folder := context.getCheckpointDir():
        return re.sub("^file:/(?!/)", "file:///", folder)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir, or the context's checkpoint folder, to one that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    context.setCheckpointDir(named)
    return shared_folder(spark)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark knows; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
