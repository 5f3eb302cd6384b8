"""Files as tables: strict text files, blobs held against what is stated of them, files nobody names, and publishing once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File types by extension.
TYPES = {".md": "text/markdown", ".txt": "text/plain", ".pdf": "application/pdf"}


def listing(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(name, size, and with ``content`` the bytes) of all files below a path; names are relative to it. Without content no file is opened.

    Spark lists and reads the files, so the path may be in any store that Spark reaches. Unfinished files (.tmp) are passed over,
    and Spark does not list files without bytes.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(~F.col("path").endswith(".tmp"))
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().split(":", 1)[-1].lstrip("/")
    name = F.expr(f"substring(path, locate({_quoted(base)}, path) + {len(base) + 1})")
    return found.select(name.alias("name"), F.col("length").alias("size"), *(["content"] if content else []))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def type_of(name: Column) -> Column:
    """The type that a name's extension stands for, or null."""
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return known[F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))]


def text_files(spark: SparkSession, path: str, declared: DataFrame | None = None) -> DataFrame:
    """(name, type, size, sha256, text, problem) of the text files below a path.

    ``problem``: type_unknown (no known extension), type_differs (from ``declared``: name, type), not_text (a known type
    that is no text), invalid_utf8 (bytes are never replaced); then text is null. A mark of byte order goes.
    """
    found = listing(spark, path, content=True).withColumn("type", type_of(F.col("name")))
    if declared is not None:
        found = found.join(declared.select("name", F.col("type").alias("_declared")), "name", "left")
    else:
        found = found.withColumn("_declared", F.lit(None).cast("string"))
    raw = F.col("content").cast("string")
    problem = (
        F.when(F.col("type").isNull(), "type_unknown").when(F.col("_declared") != F.col("type"), "type_differs").when(~F.col("type").startswith("text/"), "not_text").when(~F.is_valid_utf8(raw), "invalid_utf8")
    )
    text = F.when(problem.isNull(), F.regexp_replace(raw, "^﻿", ""))
    return found.select("name", "type", "size", F.sha2("content", 256).alias("sha256"), text.alias("text"), problem.alias("problem"))


def blob_key(sha256: Column) -> Column:
    """Where content of this hash is kept."""
    return F.concat(F.lit("blobs/"), F.substring(sha256, 1, 2), F.lit("/"), sha256)


def verified(stated: DataFrame, found: DataFrame) -> DataFrame:
    """``stated`` (name, size, sha256) with ``state``: missing, size_differs, hash_differs or ok, by ``found`` (name, size, sha256).

    A name that is stated twice is judged twice; files that nobody states are left to ``orphans``.
    """
    seen = found.select("name", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    state = F.when(F.col("_size").isNull(), "missing").when(~F.col("_size").eqNullSafe(F.col("size")), "size_differs").when(~F.col("_sha").eqNullSafe(F.col("sha256")), "hash_differs").otherwise("ok")
    return stated.join(seen, "name", "left").withColumn("state", state).drop("_size", "_sha")


def orphans(found: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files (name) that no reference (name) names."""
    return found.join(referenced.select("name").distinct(), "name", "left_anti")


def publication(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``wanted`` (name, sha256) with ``action``: write what is not there, skip what is equal, refuse what differs."""
    there = found.select("name", F.col("sha256").alias("_there"))
    action = F.when(F.col("_there").isNull(), "write").when(F.col("_there") == F.col("sha256"), "skip").otherwise("refuse")
    return wanted.join(there, "name", "left").withColumn("action", action).drop("_there")
