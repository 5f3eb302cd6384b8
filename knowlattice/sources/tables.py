"""Parquet tables of a folder, and results kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only where that is unset on a single machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder: on a cluster it must be one that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="knowlattice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{what}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where its scan has fewer splits than there are cores (so it is small); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, folder: str, name: str) -> str:
    """What tells this state of a table from any other: a hash of its files' paths, sizes and times, and how many there are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{name}.parquet").select("path", "length", "modificationTime")
    n, summed = files.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).first()
    return f"{n:x}-{int(summed or 0) % 2**64:016x}"


def stored_once(spark: SparkSession, what: str, write: Callable[[str], object]) -> str:
    """The path below the shared folder that ``write`` has filled, now or before: ``what`` must name the content fully."""
    base = shared_folder(spark, "x").rsplit("/", 1)[0]
    path = f"{base}/{what}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        write(path)
    return path
