"""Files as tables: delimited text, JSON arrays and lines, event logs, directories of records; and their writers."""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.operators.eventlog import EVENT
from dagframe.operators.stores import new_rows


def csv_table(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = False) -> DataFrame:
    """A text table with a header: every field a string, empty ones empty.

    Strict reading fails on rows with too few or too many fields; it parses whole rows, whatever
    columns are asked for. Files are split over tasks, unless fields with line ends are to be read.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "mode": "FAILFAST" if strict else "PERMISSIVE", "columnPruning": not strict}
    return spark.read.options(**options).csv(path).fillna("")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of objects; blank lines are skipped, a bad one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def event_log(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A log of JSON lines in order of seq, of one run or all."""
    rows = json_lines(spark, path, EVENT)
    return (rows if run_id is None else rows.where(F.col("run_id") == run_id)).orderBy("run_id", "seq")


def log_table(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """A log that append_events keeps; of one run, only its folder is read."""
    rows = spark.read.schema(f"{EVENT}, bucket int").parquet(path)
    if run_id is None:
        return rows.drop("bucket")
    return rows.where((F.col("bucket") == zlib.crc32(run_id.encode()) % BUCKETS) & (F.col("run_id") == run_id)).drop("bucket").orderBy("seq")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A directory with one object a file; files that don't decode are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "DROPMALFORMED").json(path)


def jdbc_log(spark: SparkSession, url: str, table: str = "run_event", run_id: str | None = None, **options: str) -> DataFrame:
    """A log in a database; the filter goes to it."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


#: Folders of a log, by a hash of the run.
BUCKETS = 64


def append_events(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Append to a Parquet log what it doesn't hold: rows are known by run_id and seq.

    The log lies in folders by a hash of the run. Only those of the batch's runs are read, and of
    these only row groups whose runs are in the batch's range; one writer at a time.
    """
    names = [c.split()[0] for c in EVENT.split(", ")]
    bucket = F.pmod(F.crc32(F.col("run_id").cast("binary")), F.lit(BUCKETS)).cast("int")
    rows = batch.select(*[F.col(n) if n in batch.columns else F.lit(None).cast(c.split(maxsplit=1)[1]).alias(n) for n, c in zip(names, EVENT.split(", "), strict=True)], bucket.alias("bucket"))
    held = rows.agg(F.collect_set("bucket").alias("buckets"), F.min("run_id").alias("low"), F.max("run_id").alias("high")).first()  # no more than BUCKETS
    try:
        stored = spark.read.schema(f"{EVENT}, bucket int").parquet(path)
    except AnalysisException as e:  # the first batch makes the folder
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is None:
        fresh = rows.dropDuplicates(["run_id", "seq"])
    else:
        near = stored.where(F.col("bucket").isin(held.buckets) & F.col("run_id").between(held.low, held.high))
        fresh = new_rows(near, rows, ["run_id", "seq"])
    fresh.write.mode("append").partitionBy("bucket").parquet(path)
