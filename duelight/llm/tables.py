"""Reading the input tables and cutting lineage through shared storage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One supplied table, by a path that Spark opens itself."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the session leaves it unset (a local test), a temporary folder is
    chosen once and set, so that later calls find the same one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Later stages start from the files, so a lost executor costs no recomputation
    of what came before, and the planner sees true sizes.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def with_file_order(table: DataFrame, name: str) -> DataFrame:
    """A table read from Parquet, with a column `name` that orders its rows as they were written.

    Spark packs files into tasks by their size, so rows of a sorted table are read in
    any order; but its part files are numbered in the order of the sort, and each
    holds its rows in order. The number of the part is in the bits from 42 on, that of
    its file, where it has several, from 32 on, and the row's below.
    """
    file = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(file, pattern, 1).try_cast("long"), F.lit(0))
    order = F.shiftleft(number(r"part-(\d+)"), 42) + F.shiftleft(number(r"-c(\d+)\."), 32) + F.col("_metadata.row_index")
    return table.withColumn(name, order)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing starts from any more: what came of them is written too."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder by the file system of its path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
