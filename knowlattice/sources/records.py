"""Records in text files, each checked and known by its line: JSON Lines, tab-separated judgments, and JSON bundles.

A file is split among tasks as usual; a line's number is its place in its split and the lines of the splits before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The header of a file of judgments, and what a judgment may be.
QRELS_HEADER, GRADES = "query-id\tcorpus-id\tscore", (0, 1, 2)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of all lines of the text files below a path, counted from 1; a carriage return at the end goes."""
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "\r$", "").alias("value"))
    # One row a split, however large the file.
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # Numbers of one task follow each other without a gap within a split.
    return rows.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line"), "value")


def _kind(v: Column, field: str) -> Column:
    """The JSON type of a field: STRING, BIGINT, ...; VOID for null, null where it is not there."""
    return F.schema_of_variant(F.try_variant_get(v, f"$['{field}']", "variant"))


def json_lines(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """(file, line, problem, fields) of JSON Lines. ``fields``: name to ``string``, ``bigint`` or ``double``, with ``?`` where it may be missing.

    ``problem`` is null, or invalid_json, not_an_object, missing:<field>, type:<field>, or (line null) empty_file for a file
    without any record (Spark does not list files without bytes). Blank lines are passed over but counted. Types are those of the JSON text: "1" is no number. Fields are null where a row has a problem.
    """
    lines = numbered_lines(spark, path)
    rows = lines.where(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    problem = F.when(F.col("_v").isNull(), "invalid_json").when(~F.schema_of_variant("_v").startswith("OBJECT"), "not_an_object")
    accepted = {"string": ["STRING"], "bigint": ["BIGINT"], "double": ["BIGINT", "DOUBLE"]}
    for name, kind in fields.items():
        seen = F.coalesce(_kind(F.col("_v"), name), F.lit("VOID"))
        if not kind.endswith("?"):
            problem = problem.when(seen == "VOID", f"missing:{name}")
        fits = seen.isin(*accepted[kind.rstrip("?")], "VOID") | (seen.startswith("DECIMAL") if kind.startswith("double") else F.lit(False))
        problem = problem.when(~fits, f"type:{name}")
    checked = rows.withColumn("problem", problem)
    values = [F.when(F.col("problem").isNull(), F.try_variant_get("_v", f"$['{n}']", k.rstrip("?"))).alias(n) for n, k in fields.items()]
    made = checked.select("file", "line", "problem", *values)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    empty = files.join(rows.select("file").distinct(), "file", "left_anti").select("file", F.lit(None).cast("long").alias("line"), F.lit("empty_file").alias("problem"), *[F.lit(None).cast(k.rstrip("?")).alias(n) for n, k in fields.items()])
    return made.unionByName(empty)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, problem, query_id, doc_id, grade) of tab-separated judgments with their header.

    ``problem``: header (the first line that is not blank is another one), fields (not three, or a blank one), grade (not 0, 1 or 2), or
    duplicate (a pair that an earlier line of the file has judged); no_judgments (line null) for a file with a header alone.
    """
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    first = lines.groupBy("file").agg(F.min(F.struct("line", "value")).alias("h"), F.count("*").alias("_n"))
    rows = lines.join(first.select("file", F.col("h.line").alias("_header"), (F.col("h.value") == QRELS_HEADER).alias("_good"), "_n"), "file")
    part = F.transform(F.split("value", "\t"), lambda p: F.trim(p))
    number = F.try_element_at(part, F.lit(3)).try_cast("double")
    fields = (F.size(part) == 3) & ~F.exists(part, lambda p: p == "")
    seen = rows.where(F.col("line") > F.col("_header")).select("file", "line", part.alias("p"), fields.alias("_three"), (fields & F.coalesce(number.isin(*GRADES), F.lit(False))).alias("_graded"), number.cast("int").alias("grade"))
    pair = W.partitionBy("file", F.get("p", 0), F.get("p", 1)).orderBy(~F.col("_graded"), "line")
    seen = seen.withColumn("_again", F.col("_graded") & (F.row_number().over(pair) > 1))
    problem = F.when(~F.col("_three"), "fields").when(~F.col("_graded"), "grade").when(F.col("_again"), "duplicate")
    good = lambda c: F.when(F.col("problem").isNull(), c)
    made = seen.withColumn("problem", problem).select("file", "line", "problem", good(F.get("p", 0)).alias("query_id"), good(F.get("p", 1)).alias("doc_id"), good(F.col("grade")).alias("grade"))
    none = [F.lit(None).cast("string").alias("query_id"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("int").alias("grade")]
    header = rows.where((F.col("line") == F.col("_header")) & ~F.col("_good")).select("file", "line", F.lit("header").alias("problem"), *none)
    alone = rows.where("_n = 1 and _good").select("file", F.lit(None).cast("long").alias("line"), F.lit("no_judgments").alias("problem"), *none)
    return made.unionByName(header).unionByName(alone)


def bundles(spark: SparkSession, path: str, array: str, schema: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON bundles (one object a file, its records in ``array``), and what is wrong with the files.

    Records: (file, at, fields of ``schema``). Problems: (file, problem) with invalid_json, not_an_object, schema_version (not ``version``),
    missing:<array> (no array, or none in it). A file with a problem has no records. A bundle is one value: it must fit a task.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("_v"))
    kind = F.coalesce(_kind(F.col("_v"), array), F.lit(""))
    problem = (
        F.when(F.col("_v").isNull(), "invalid_json").when(~F.schema_of_variant("_v").startswith("OBJECT"), "not_an_object")
        .when(~F.coalesce(F.try_variant_get("_v", "$.schemaVersion", "string") == version, F.lit(False)), "schema_version").when(~kind.startswith("ARRAY<") | (kind == "ARRAY<VOID>"), f"missing:{array}")
    )
    checked = whole.withColumn("problem", problem)
    rows = checked.where("problem is null").select("file", F.posexplode(F.try_variant_get("_v", f"$['{array}']", f"array<struct<{schema}>>")).alias("at", "r")).select("file", "at", "r.*")
    return rows, checked.where("problem is not null").select("file", "problem")


def layout_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages of layout results (JSON Lines with result.layoutParsingResults), and what is wrong with lines.

    Pages: (file, page, line, text), numbered through each file from 1. Problems: (file, line, problem): invalid_json, no_layouts, or empty_page for a line
    with a page without text. A page's text is its markdown, or the ``text`` of that.
    """
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    where = "$.result.layoutParsingResults"
    array = F.coalesce(F.schema_of_variant(F.try_variant_get("_v", where, "variant")).startswith("ARRAY<"), F.lit(False))
    layouts = F.try_variant_get("_v", where, "array<variant>")
    of = lambda x: F.coalesce(F.try_variant_get(x, "$.markdown.text", "string"), F.when(F.schema_of_variant(F.try_variant_get(x, "$.markdown", "variant")) == "STRING", F.try_variant_get(x, "$.markdown", "string")), F.lit(""))
    seen = rows.withColumn("_texts", F.when(array, F.transform(layouts, of)))
    problem = F.when(F.col("_v").isNull(), "invalid_json").when(F.col("_texts").isNull(), "no_layouts").when(F.exists("_texts", lambda t: F.trim(t) == ""), "empty_page")
    seen = seen.withColumn("problem", problem)
    good = seen.where("problem is null").select("file", "line", "_texts")
    before = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    numbered = good.withColumn("_before", F.coalesce(F.sum(F.size("_texts")).over(before), F.lit(0)))
    pages = numbered.select("file", "line", "_before", F.posexplode("_texts").alias("at", "text")).select("file", (F.col("_before") + F.col("at") + 1).cast("int").alias("page"), "line", "text")
    return pages, seen.where("problem is not null").select("file", "line", "problem")
