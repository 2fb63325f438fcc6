"""What the corpus operators share: tables in the cluster's shared folder, size-checked joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where spark.checkpoint.dir is unset.
LOCAL_FOLDER = "file:///tmp/checkpoints"
#: A side is broadcast only if it was counted to need no more than so many bytes.
BROADCAST_BYTES = 32 << 20

#: White space that separates words, as the body of a character class.
BLANKS = r"\x20\x09-\x0D"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only under a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return LOCAL_FOLDER
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


#: Rows of an Arrow batch: texts can be long, and JVM and Python each hold a batch for every core.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, for every operator that hands texts to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Scratch:
    """Tables of one operator run, as Parquet in the shared folder; reading them back cuts the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        small_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, *names: str) -> None:
        """Drop all tables but those that the result still reads."""
        for name in sorted(self.names - set(names)):
            self.drop(name)

    def drop(self, name: str) -> None:
        self.names.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(big: DataFrame, small: DataFrame, on: list[str], small_bytes: int, how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join on equal, non-null keys; small is broadcast when small_bytes, which the caller counted, allows it, else both sides are shuffled."""
    return big.join(F.broadcast(small) if small_bytes <= limit else small, on, how)

