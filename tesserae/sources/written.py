"""Tables in the shared folder: what a job writes once and reads several times, or cuts a loop's lineage with."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def new_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below one of this machine only where that is unset and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='tesserae-')}")
    return f"{root}/tesserae-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a written table; it survives lost executors and is computed once."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
