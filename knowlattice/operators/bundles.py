"""Rules for evaluation data: chunks of a corpus, queries, and judgments; each function names the rules that rows break.

Rows carry ``file``, the bundle they are from; ids are compared within a bundle. Each rule is one condition or one grouping, so a bundle
of any size is checked by plain aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc

# Identifiers, and the longest that each field may be in code points.
STABLE_ID = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,200}$"
MOST = {"content": 1_000_000, "parentContent": 1_000_000, "contextHeader": 100_000, "resourceName": 120, "title": 512, "query": 256}
CHUNK = "chunkId: string, resourceId: string, resourceVersionId: string, processingRunId: string, content: string, contextHeader: string, resourceName: string, title: string, parentChunkId: string, parentContent: string"
QUERY = "id: string, query: string, tags: array<string>"
QRELS = "queryId: string, relevant: array<struct<chunkId: string, grade: double>>"


def plain(c: Column | str) -> Column:
    return F.trim(nfkc(c))


def _text_rules(name: str, needed: bool) -> list[Column]:
    value = F.col(f"_{name}")
    rules = [F.when(F.length(value) > MOST[name], f"{name}_too_long")]
    return ([F.when(F.coalesce(value, F.lit("")) == "", f"{name}_empty")] if needed else []) + rules


def _listed(rows: DataFrame, keys: list[str], rules: list[Column]) -> DataFrame:
    return rows.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def corpus_violations(chunks: DataFrame) -> DataFrame:
    """(file, id, rule) of chunks (file, fields of ``CHUNK``): fields that are missing, empty, too long or no identifiers; parents and
    resources that don't agree; ids that repeat or are both child and parent. A chunk may break several rules; each is named once."""
    seen = chunks
    for name in ("content", "contextHeader", "resourceName", "title", "parentContent"):
        seen = seen.withColumn(f"_{name}", plain(name))
    ids = ["chunkId", "resourceId", "resourceVersionId", "processingRunId"]
    seen = seen.withColumns({f"_{c}": plain(c) for c in [*ids, "parentChunkId"]}).withColumn("_parent", F.nullif("_parentChunkId", F.lit("")))
    has_content = F.coalesce(F.col("_parentContent"), F.lit("")) != ""
    rules = [F.when(~F.coalesce(F.col(f"_{c}").rlike(STABLE_ID), F.lit(False)), f"{c}_not_stable") for c in ids]
    rules += _text_rules("content", True) + _text_rules("contextHeader", False) + _text_rules("parentContent", False)
    rules += [F.when(F.col(c).isNotNull() & (F.col(f"_{c}") == ""), f"{c}_empty") for c in ("resourceName", "title")] + _text_rules("resourceName", False) + _text_rules("title", False)
    rules += [
        F.when(F.col("_parent").isNotNull() & ~F.col("_parent").rlike(STABLE_ID), "parentChunkId_not_stable"), F.when(F.col("_parent") == F.col("_chunkId"), "own_parent"),
        F.when(F.col("_parent").isNotNull() & ~has_content, "parent_without_content"), F.when(F.col("_parent").isNull() & has_content, "content_without_parent"),
    ]
    own = _listed(seen.withColumn("id", F.col("_chunkId")), ["file", "id"], rules)
    repeated = seen.groupBy("file", F.col("_chunkId").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("file", "id", F.lit("chunkId_repeated").alias("rule"))
    parents = seen.where("_parent is not null").groupBy("file", F.col("_parent").alias("id")).agg((F.min("_parentContent") != F.max("_parentContent")).alias("differ"))
    differ = parents.where("differ").select("file", "id", F.lit("parent_content_differs").alias("rule"))
    both = parents.join(seen.select("file", F.col("_chunkId").alias("id")).distinct(), ["file", "id"], "left_semi").select("file", "id", F.lit("parent_is_child").alias("rule"))
    name = F.coalesce("_resourceName", F.concat(F.lit("Evaluation resource "), "_resourceId"))
    about = F.to_json(F.struct("_resourceVersionId", "_processingRunId", name.alias("name"), F.coalesce("_title", name).alias("title")))
    torn = seen.groupBy("file", F.col("_resourceId").alias("id")).agg((F.min(about) != F.max(about)).alias("differ")).where("differ").select("file", "id", F.lit("resource_differs").alias("rule"))
    return own.unionByName(repeated).unionByName(differ).unionByName(both).unionByName(torn).distinct()


def query_violations(queries: DataFrame) -> DataFrame:
    """(file, id, rule) of queries (file, fields of ``QUERY``): ids, texts of 1 to 256 code points, tags that are not blank."""
    seen = queries.withColumns({"_query": plain("query"), "_id": plain("id")})
    rules = [F.when(~F.coalesce(F.col("_id").rlike(STABLE_ID), F.lit(False)), "id_not_stable"), *_text_rules("query", True), F.when(F.exists("tags", lambda t: F.coalesce(F.trim(t), F.lit("")) == ""), "tag_empty")]
    own = _listed(seen.withColumn("id", F.col("_id")), ["file", "id"], rules)
    repeated = seen.groupBy("file", F.col("_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("file", "id", F.lit("id_repeated").alias("rule"))
    return own.unionByName(repeated).distinct()


def qrel_violations(qrels: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, rule) of judgments (fields of ``QRELS``) against the ids of ``queries`` and ``chunks``: each query is judged once, by chunks that
    exist and are named once, with grades 0 to 2, one of them above 0; and each query is judged."""
    seen = qrels.select(plain("queryId").alias("id"), "relevant")
    asked = queries.select(plain("id").alias("id")).distinct()
    known = chunks.select(plain("chunkId").alias("chunk")).distinct()
    grades = F.transform("relevant", lambda r: r["grade"])
    names = F.transform("relevant", lambda r: r["chunkId"])
    rules = [
        F.when(~F.coalesce(F.col("id").rlike(STABLE_ID), F.lit(False)), "queryId_not_stable"), F.when(F.coalesce(F.size("relevant"), F.lit(0)) <= 0, "nothing_relevant"),
        F.when(F.exists("relevant", lambda r: ~F.coalesce(r["grade"].isin(0, 1, 2), F.lit(False))), "grade_out_of_range"), F.when((F.size("relevant") > 0) & ~F.exists(grades, lambda g: F.coalesce(g > 0, F.lit(False))), "no_grade_above_zero"),
        F.when(F.size(F.array_distinct(names)) < F.size(names), "chunk_twice"),
    ]
    own = _listed(seen, ["id"], rules)
    one = lambda df, rule: df.select("id", F.lit(rule).alias("rule"))
    twice = one(seen.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "query_twice")
    unknown = one(seen.join(asked, "id", "left_anti"), "query_unknown")
    missing = one(asked.join(seen, "id", "left_anti"), "query_not_judged")
    stray = one(seen.select("id", F.explode("relevant").alias("r")).select("id", plain("r.chunkId").alias("chunk")).join(known, "chunk", "left_anti"), "chunk_unknown")
    return own.unionByName(twice).unionByName(unknown).unionByName(missing).unionByName(stray).distinct()
