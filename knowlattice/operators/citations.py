"""Citations: whether what they point at is still there, the evidence of a plan's items, and the state of a whole plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import locator_problem

# The risk of a plan's item by its type.
RISKS = {"tag_add": "low", "page_create": "medium"}
PDF = "application/pdf"


def citation_states(citations: DataFrame, versions: DataFrame, files: DataFrame, chunks: DataFrame, blocks: DataFrame, current: DataFrame) -> DataFrame:
    """``citations`` with ``status`` (active, needs_review, broken) and the first ``reason`` that applies.

    ``citations``: (..., version_id, locator JSON, page_version_id, block_key). ``versions``: (version_id, resource_id, name, size, sha256, mime,
    length, page_count, canonical: whether its canonical text is intact). ``files``: (name, size, sha256) as they are. ``chunks``: active (chunk_id, version_id). ``blocks``:
    (page_version_id, block_key). ``current``: (resource_id, current_version_id). All by plain joins on keys that are distinct there; citations may repeat.
    """
    # What is known of each version comes first, and reasons as soon as they can be told: citations, of which there are most, move few columns.
    known = versions.select("version_id", "resource_id", F.col("name").alias("_name"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"), "mime", "length", "page_count", "canonical")
    there = files.select(F.col("name").alias("_name"), F.col("size").alias("_real_size"), F.col("sha256").alias("_real_sha"))
    kept = F.when(F.col("_real_size").isNull(), "storage_missing").when((F.col("_real_size") != F.col("_size")) | (F.col("_real_sha") != F.col("_sha")), "integrity_failed")
    facts = known.join(there, "_name", "left").join(current, "resource_id", "left").select("version_id", F.lit(True).alias("_version"), kept.alias("_kept"), (F.col("mime") == PDF).alias("_pdf"), "length", "page_count", "canonical", "current_version_id")
    keys = F.json_object_keys("locator")
    names = lambda *ks: F.arrays_overlap(keys, F.array(*map(F.lit, ks)))
    locator = locator_problem(F.col("locator"), F.col("length"), F.col("page_count"))
    early = (
        F.when(F.col("_version").isNull(), "version_missing").when(F.col("_kept").isNotNull(), F.col("_kept"))
        .when(locator.isNotNull(), F.concat(F.lit("locator:"), locator)).when(F.col("_pdf") & names("startOffset", "endOffset") & ~F.coalesce("canonical", F.lit(False)), "canonical_missing")
        .when(F.col("_pdf") & names("page", "pageStart", "pageEnd", "pages") & F.col("page_count").isNull(), "page_count_unavailable")
    )
    newer = ~F.col("version_id").eqNullSafe(F.col("current_version_id"))
    chunk = F.try_variant_get(F.try_parse_json("locator"), "$.chunkId", "string")
    found = citations.join(facts, "version_id", "left").select(*citations.columns, early.alias("_early"), newer.alias("_newer"), chunk.alias("_chunk"))
    found = found.join(chunks.select(F.col("chunk_id").alias("_chunk"), "version_id", F.lit(True).alias("_has_chunk")), ["_chunk", "version_id"], "left")
    early = F.coalesce("_early", F.when(F.col("_chunk").isNotNull() & F.col("_has_chunk").isNull(), "chunk_missing"))
    found = found.select(*citations.columns, early.alias("_early"), "_newer")
    found = found.join(blocks.select("page_version_id", "block_key", F.lit(True).alias("_has_block")), ["page_version_id", "block_key"], "left")
    reason = F.coalesce("_early", F.when((F.coalesce("block_key", F.lit("")) != "") & F.col("_has_block").isNull(), "block_missing"))
    judged = found.withColumn("_reason", reason)
    status = F.when(F.col("_reason").isNotNull(), "broken").when(F.col("_newer"), "needs_review").otherwise("active")
    return judged.select(*citations.columns, status.alias("status"), F.coalesce("_reason", F.when(F.col("_newer"), "newer_version")).alias("reason"))


def evidence(policy: Column, item_type: Column, valid: Column, invalid: Column) -> Column:
    """Evidence of a plan's item from its citations: error (a citation that is required to hold does not), unverified, used, needs_evidence, or not_applicable for tags."""
    warned = policy == "warn"
    return (
        F.when(~warned & (invalid > 0), "error").when(item_type == "tag_add", "not_applicable").when(warned & ((invalid > 0) | (valid == 0)), "unverified").when(valid > 0, "used").otherwise("needs_evidence")
    )


def warnings(policy: Column, item_type: Column, valid: Column, invalid: Column) -> Column:
    """How many warnings an item has: one for each citation that does not hold, and one if none does."""
    return F.when(policy == "warn", invalid + ((item_type != "tag_add") & (valid == 0)).cast("int")).otherwise(0)


def risk(item_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in RISKS.items() for x in pair])[item_type], F.lit("high"))


def plan_states(items: DataFrame) -> DataFrame:
    """(plan_id, items, warnings, status) of plans' items (plan_id, evidence, warnings): error, draft where evidence is needed, ready_with_warnings, ready."""
    seen = items.groupBy("plan_id").agg(F.count("*").alias("items"), F.sum("warnings").cast("long").alias("warnings"), F.bool_or(F.col("evidence") == "error").alias("_error"), F.bool_or(F.col("evidence") == "needs_evidence").alias("_draft"))
    status = F.when(F.col("_error"), "error").when(F.col("_draft"), "draft").when(F.col("warnings") > 0, "ready_with_warnings").otherwise("ready")
    return seen.select("plan_id", "items", "warnings", status.alias("status"))


def vector_status(enabled: Column, error: Column, hits: Column) -> Column:
    """What a search says of its vectors: disabled, blocked (egress is not allowed: the search must not go on), degraded after another error, no_embeddings without hits, else used."""
    return (
        F.when(~enabled | (error == "EMBEDDING_DISABLED"), "disabled").when(error == "EMBEDDING_EGRESS_BLOCKED", "blocked").when(error.isNotNull(), "degraded").when(F.coalesce(hits, F.lit(0)) == 0, "no_embeddings").otherwise("used")
    )
