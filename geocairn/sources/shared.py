"""Where intermediate results go: the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new name in spark.checkpoint.dir; only in a session of one machine, where that is unset, a temporary folder is taken for it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return f"{context._jsc.sc().getCheckpointDir().get()}/kept-{context.applicationId}/{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder, so that a lost executor loses no work."""
    new_folder(df.sparkSession)
    return df.checkpoint(eager=True)
