"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowlattice.llm import decontamination, packing, pii, shingles, simhash, toxicity
from knowlattice.llm.common import shared_dir, table, written
from knowlattice.llm.components import components


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the length of the text as it now is."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return df.select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumnsRenamed({"severity": "_severity", "rejected": "_rejected"}), model)
    return scored.where(~F.col("rejected")).drop("severity", "rejected").withColumnsRenamed({"_severity": "severity", "_rejected": "rejected"}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; rows without id come last.

    SimHash links fingerprints of at most 3 differing bits; sets of five-word shingles with a likeness of 0.8 or more, which
    often differ in more bits, are linked besides. Groups are what both kinds of links hold together.
    """
    # Row numbers follow the splits of a scan, which change when executors come or go: they are drawn once and written.
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    keyed = rows.select(key.alias("key"), "text")
    prints = written(simhash.near_duplicates(keyed, key="key").select("key", "component_id"), "by_simhash")
    sets = written(shingles.near_duplicates(keyed, key="key"), "by_shingles")
    # Both name a group by its smallest key: a row that is smallest in its two groups goes if these lead to a smaller one.
    both = prints.join(sets.select("key", F.col("component_id").alias("b")), "key").select(F.col("component_id").alias("a"), "b").where("a != b")
    both = written(both.distinct(), "both")
    groups = components(both.select(F.col("a._row").alias("a"), F.col("b._row").alias("b")))
    held = both.select(F.explode(F.array("a", "b")).alias("key")).join(groups, F.col("key._row") == F.col("node"))
    gone = held.join(held.groupBy("root").agg(F.min("key").alias("least")), "root").where("key != least").select(F.col("node").alias("_row"))
    first = lambda found: found.where("key = component_id").select(F.col("key._row").alias("_row"))
    kept = first(prints).join(first(sets), "_row", "left_semi").join(gone, "_row", "left_anti")
    return rows.join(kept, "_row", "left_semi").select(docs.columns)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; a document that held nothing else goes."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    cut = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))).withColumn("text", decontamination.without_spans(F.col("text"), F.col("spans")))
    return _with_text(cut, docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets get surrogates."""
    return _with_text(pii.pseudonymise(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed token sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: SQL cannot express the fitted model, the surrogates or the packing; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
