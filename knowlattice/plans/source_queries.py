"""Queries over files: each writes files made of the given tables, some of them damaged, and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bundles as B
from ..sources import files, records
from ..sources.tables import shared_folder, table
from .registry import query

#: Documents in one file.
BUNDLE = 50
_NAME = "'part=' || lpad(CAST(part AS VARCHAR), 6, '0')"


def _parts(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", "text", F.floor(F.col("doc_id") / BUNDLE).alias("n")).select("*", F.lpad(F.col("n").cast("string"), 6, "0").alias("part"))


def _written(lines: DataFrame, what: str, ending: str = "txt") -> str:
    """A folder with one text file for each ``part``, its rows (``line``) in the order of ``at``."""
    path = shared_folder(lines.sparkSession, what)
    rows = lines.repartition("part").sortWithinPartitions("part", "at").select("part", "line")
    rows.write.partitionBy("part").option("lineSep", "\n").text(path)
    return path


def _named(found: DataFrame) -> DataFrame:
    """The files by their folder alone: Spark names the files themselves."""
    return found.where(F.col("name").contains("part=")).withColumn("name", F.regexp_extract("name", "(part=[0-9a-z]+)", 1))


_FILES = f"""p AS (SELECT doc_id, text, doc_id // {BUNDLE} AS part FROM documents WHERE text IS NOT NULL),
whole AS (SELECT part, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM p GROUP BY part)"""


@query(f"""WITH {_FILES} SELECT {_NAME} AS name, CASE WHEN part % 3 = 1 THEN 'invalid_utf8' END AS problem, CASE WHEN part % 3 != 1 THEN sha256(body) END AS sha256, CASE WHEN part % 3 != 1 THEN CAST(length(body) AS INTEGER) END AS chars FROM whole""")
def text_source(spark, sf):
    """Text files read strictly: bytes that are no UTF-8 are named, not replaced."""
    docs = _parts(spark, sf)
    bad = (F.col("n") % 3 == 1) & (F.col("doc_id") % BUNDLE == F.min("doc_id").over(_of_part()) % BUNDLE)
    line = F.when(bad, F.concat(F.expr("cast(unhex('C328') as string)"), F.col("text"))).otherwise(F.col("text"))
    found = _named(files.text_files(spark, _written(docs.select("part", F.col("doc_id").alias("at"), line.alias("line")), "texts")))
    return found.select("name", "problem", F.when(F.col("problem").isNull(), F.col("sha256")).alias("sha256"), F.length("text").alias("chars"))


def _of_part():
    from pyspark.sql import Window

    return Window.partitionBy("part")


_STATE = "CASE WHEN part % 7 = 1 THEN 'missing' WHEN part % 7 = 2 THEN 'size_differs' WHEN part % 7 = 3 THEN 'hash_differs' ELSE 'ok' END"


def _stored(spark, sf) -> tuple[DataFrame, DataFrame]:
    """What is stated of the files, and the files: some are not there, shorter, or of other letters; some nobody states."""
    docs = _parts(spark, sf)
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n"), F.lit("\n"))
    stated = docs.groupBy("part").agg(body.alias("body")).select(F.concat(F.lit("part="), "part").alias("name"), F.octet_length("body").cast("long").alias("size"), F.sha2("body", 256).alias("sha256"))
    kind = F.col("n") % 7
    line = F.when(kind == 2, F.concat("text", F.lit("x"))).when(kind == 3, F.translate(F.col("text"), "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza")).otherwise(F.col("text"))
    kept = docs.where(kind != 1).select("part", F.col("doc_id").alias("at"), line.alias("line"))
    stray = docs.where(kind == 4).select(F.concat("part", F.lit("stray")).alias("part"), F.col("doc_id").alias("at"), F.col("text").alias("line"))
    path = _written(kept.unionByName(stray), "blobs")
    return stated, _named(files.listing(spark, path, content=True).withColumn("sha256", F.sha2("content", 256)).drop("content"))


@query(f"WITH {_FILES} SELECT {_NAME} AS name, sha256(body) AS sha256, {_STATE} AS state FROM whole")
def blob_integrity(spark, sf):
    """Files held against their stated size and hash."""
    return files.verified(*_stored(spark, sf)).select("name", "sha256", "state")


@query(f"WITH {_FILES} SELECT {_NAME} || 'stray' AS name FROM whole WHERE part % 7 = 4")
def orphan_files(spark, sf):
    """Files that nobody names."""
    stated, found = _stored(spark, sf)
    return files.orphans(found, stated).select("name")


@query(f"WITH {_FILES} SELECT {_NAME} AS name, CASE WHEN part % 7 = 1 THEN 'write' WHEN part % 7 IN (2, 3) THEN 'refuse' ELSE 'skip' END AS action FROM whole")
def idempotent_publish(spark, sf):
    """What a second publication does with each file."""
    stated, found = _stored(spark, sf)
    return files.publication(stated, found).select("name", "action")


@query("SELECT DISTINCT doc_id, CASE WHEN k = 5 THEN 'type_unknown' WHEN k = 4 THEN 'not_text' WHEN k = 3 THEN 'type_differs' END AS problem FROM (SELECT doc_id, doc_id % 6 AS k FROM documents)")
def file_types(spark, sf):
    """Names and stated types of uploads: both must agree, in a known type."""
    k = F.col("doc_id") % 6
    docs = table(spark, sf, "documents").select("doc_id", k.alias("k"), F.concat(F.lit("dir.d/Name "), F.col("doc_id").cast("string"), F.get(F.array(*map(F.lit, [".md", ".TXT", ".txt", ".md", ".pdf", ".exe"])), k.cast("int"))).alias("name"))
    declared = F.get(F.array(*map(F.lit, ["text/markdown", "text/plain", "text/plain", "text/plain", "application/pdf", "text/plain"])), F.col("k").cast("int"))
    kind = files.type_of(F.col("name"))
    problem = F.when(kind.isNull(), "type_unknown").when(kind != declared, "type_differs").when(~kind.startswith("text/"), "not_text")
    return docs.select("doc_id", problem.alias("problem"))


_JSONL = "CASE doc_id % 11 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'missing:text' WHEN 4 THEN 'type:_id' WHEN 5 THEN 'type:title' END"


@query(f"""WITH d AS (SELECT *, doc_id // {BUNDLE} AS part FROM documents WHERE text IS NOT NULL), n AS (SELECT *, sum(CASE WHEN doc_id % 11 = 6 THEN 2 ELSE 1 END) OVER (PARTITION BY part ORDER BY doc_id) AS line FROM d)
SELECT {_NAME} AS name, CAST(line AS BIGINT) AS line, {_JSONL} AS problem, CASE WHEN {_JSONL} IS NULL THEN CAST(doc_id AS VARCHAR) END AS id, CASE WHEN {_JSONL} IS NULL THEN md5(text) END AS h FROM n""")
def jsonl_source(spark, sf):
    """JSON Lines with planted faults and blank lines, each fault named with its line."""
    k, i = F.col("doc_id") % 11, F.col("doc_id").cast("string")
    whole = F.to_json(F.struct(i.alias("_id"), F.col("text")))
    line = (
        F.when(k == 1, F.substring(whole, 1, 5)).when(k == 2, F.lit("[1]")).when(k == 3, F.to_json(F.struct(i.alias("_id")))).when(k == 4, F.to_json(F.struct(F.col("doc_id").alias("_id"), "text")))
        .when(k == 5, F.to_json(F.struct(i.alias("_id"), F.lit(True).alias("title"), "text"))).when(k == 6, F.concat(F.lit(" \n"), whole)).when(k == 7, F.concat(whole, F.lit("\r"))).otherwise(whole)
    )
    path = _written(_parts(spark, sf).select("part", F.col("doc_id").alias("at"), line.alias("line")), "jsonl")
    found = records.json_lines(spark, path, {"_id": "string", "title": "string?", "text": "string"})
    return found.select(F.regexp_extract("file", "(part=[0-9]+)", 1).alias("name"), "line", "problem", F.col("_id").alias("id"), F.md5("text").alias("h"))


_TSV = "CASE doc_id % 13 WHEN 1 THEN 'fields' WHEN 2 THEN 'fields' WHEN 3 THEN 'grade' WHEN 4 THEN 'grade' WHEN 5 THEN 'duplicate' END"


@query(f"""WITH d AS (SELECT DISTINCT doc_id, doc_id // {BUNDLE} AS part FROM documents WHERE text IS NOT NULL), n AS (SELECT *, 1 + sum(CASE WHEN doc_id % 13 = 5 THEN 2 ELSE 1 END) OVER (PARTITION BY part ORDER BY doc_id) AS line FROM d),
r AS (SELECT part, line, {_TSV} AS problem, doc_id FROM n UNION ALL SELECT part, line - 1, NULL, doc_id FROM n WHERE doc_id % 13 = 5)
SELECT {_NAME} AS name, CAST(line AS BIGINT) AS line, problem, CASE WHEN problem IS NULL THEN 'q' || doc_id END AS query_id, CASE WHEN problem IS NULL THEN CAST(doc_id % 3 AS INTEGER) END AS grade FROM r WHERE part % 5 != 2
UNION ALL SELECT {_NAME}, 1, 'header', NULL, NULL FROM (SELECT DISTINCT part FROM d) WHERE part % 5 = 2
UNION ALL SELECT {_NAME}, CAST(line AS BIGINT), problem, CASE WHEN problem IS NULL THEN 'q' || doc_id END, CASE WHEN problem IS NULL THEN CAST(doc_id % 3 AS INTEGER) END FROM r WHERE part % 5 = 2""")
def tsv_source(spark, sf):
    """Tab-separated judgments with planted faults: headers, fields, grades, pairs judged twice."""
    docs = _parts(spark, sf).select("part", "n", "doc_id").distinct()
    k, i = F.col("doc_id") % 13, F.col("doc_id").cast("string")
    good = F.concat(F.lit("q"), i, F.lit("\td"), i, F.lit("\t"), (F.col("doc_id") % 3).cast("string"))
    line = (
        F.when(k == 1, F.concat(F.lit("q"), i, F.lit("\td"))).when(k == 2, F.concat(F.lit("q"), i, F.lit("\t \t1"))).when(k == 3, F.concat(F.lit("q\td"), i, F.lit("\t3")))
        .when(k == 4, F.concat(F.lit("q\td"), i, F.lit("\tone"))).when(k == 5, F.concat(good, F.lit("\n"), good)).otherwise(good)
    )
    header = docs.groupBy("part").agg(F.first("n").alias("n")).select("part", F.lit(-1).cast("long").alias("at"), F.when(F.col("n") % 5 == 2, "query\tcorpus\tscore").otherwise(records.QRELS_HEADER).alias("line"))
    path = _written(docs.select("part", F.col("doc_id").alias("at"), line.alias("line")).unionByName(header), "qrels")
    return records.judgments(spark, path).select(F.regexp_extract("file", "(part=[0-9]+)", 1).alias("name"), "line", "problem", "query_id", "grade")


_RULES = """CASE WHEN k = 1 THEN 'chunkId_not_stable' END, CASE WHEN k = 2 THEN 'content_empty' END, CASE WHEN k = 3 THEN 'title_too_long' END, CASE WHEN k = 4 THEN 'own_parent' END, CASE WHEN k = 5 THEN 'parent_without_content' END,
CASE WHEN k = 6 THEN 'content_without_parent' END, CASE WHEN k = 7 THEN 'resourceVersionId_not_stable' END"""


@query(f"""WITH d AS (SELECT DISTINCT doc_id, doc_id // {BUNDLE} AS part, doc_id % 17 AS k FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, CASE WHEN k = 1 THEN 'c ' || doc_id ELSE 'c' || doc_id END AS id FROM d WHERE part % 6 NOT IN (1, 2)),
own AS (SELECT part, id, unnest([{_RULES}]) AS rule FROM c),
twice AS (SELECT part, id, 'chunkId_repeated' AS rule FROM c WHERE k = 8),
pairs AS (SELECT part, 'p' || part AS id, 'parent_content_differs' AS rule FROM c WHERE k IN (9, 10) GROUP BY part HAVING count(*) > 1),
twofold AS (SELECT part, id, 'parent_is_child' AS rule FROM c WHERE k = 4),
torn AS (SELECT part, 'r' || part AS id, 'resource_differs' AS rule FROM c WHERE k IN (11, 12) GROUP BY part HAVING count(*) > 1)
SELECT {_NAME} AS name, id, rule FROM (SELECT * FROM own UNION SELECT * FROM twice UNION SELECT * FROM pairs UNION SELECT * FROM twofold UNION SELECT * FROM torn) WHERE rule IS NOT NULL
UNION ALL SELECT {_NAME}, NULL, CASE part % 6 WHEN 1 THEN 'invalid_json' ELSE 'schema_version' END FROM (SELECT DISTINCT part FROM d) WHERE part % 6 IN (1, 2)""")
def bundle_rules(spark, sf):
    """JSON bundles of chunks with planted faults: what is wrong with the files, and which rules their chunks break."""
    docs = _parts(spark, sf).dropDuplicates(["doc_id"]).withColumn("k", F.col("doc_id") % 17)
    k, i, n = F.col("k"), F.col("doc_id").cast("string"), F.col("n").cast("string")
    chunk_id = F.when(k == 1, F.concat(F.lit("c "), i)).otherwise(F.concat(F.lit("c"), i))
    shared = k.isin(9, 10)
    parent = F.when(k == 4, chunk_id).when(k == 5, F.concat(F.lit("p"), i)).when(shared, F.concat(F.lit("p"), n))
    chunk = F.struct(
        chunk_id.alias("chunkId"), F.when(k.isin(11, 12), F.concat(F.lit("r"), n)).otherwise(F.concat(F.lit("own"), i)).alias("resourceId"), F.when(k == 7, "").otherwise(F.concat(F.lit("v"), i)).alias("resourceVersionId"),
        F.lit("run").alias("processingRunId"), F.when(k == 2, " ").otherwise(F.concat(F.lit("words "), i)).alias("content"), F.when(k == 3, F.repeat(F.lit("t"), 513)).alias("title"), parent.alias("parentChunkId"),
        F.when(k.isin(4, 6), "above").when(shared, F.concat(F.lit("above "), i)).alias("parentContent"),
    )
    twice = docs.select("part", "n", "doc_id", F.explode(F.when(k == 8, F.array(chunk, chunk)).otherwise(F.array(chunk))).alias("c"))
    whole = twice.groupBy("part", "n").agg(F.array_sort(F.collect_list("c")).alias("chunks"))
    version = F.when(F.col("n") % 6 == 2, "other").otherwise("corpus-v1")
    body = F.to_json(F.struct(version.alias("schemaVersion"), "chunks"), {"ignoreNullFields": "true"})
    line = F.when(F.col("n") % 6 == 1, F.substring(body, 1, 40)).otherwise(body)
    path = _written(whole.select("part", F.lit(0).alias("at"), line.alias("line")), "bundles")
    rows, problems = records.bundles(spark, path, "chunks", B.CHUNK, "corpus-v1")
    name = F.regexp_extract("file", "(part=[0-9]+)", 1).alias("name")
    return B.corpus_violations(rows).select(name, "id", "rule").unionByName(problems.select(name, F.lit(None).cast("string").alias("id"), F.col("problem").alias("rule")))
