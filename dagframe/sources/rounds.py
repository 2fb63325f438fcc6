"""Tables of an iterative job's rounds, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Used only under a local master, where spark.checkpoint.dir is unset.
LOCAL_FOLDER = "file:///tmp/checkpoints"


def round_folder(spark: SparkSession) -> str:
    """A new folder's name in the folder that driver and executors share. What is written there stays, as results may read it; the cluster clears its checkpoints."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = LOCAL_FOLDER
    return f"{folder.rstrip('/')}/rounds-{uuid.uuid4().hex}"


def round_writer(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a round's table as Parquet and reads it back, which cuts its lineage."""
    root = round_folder(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return written
