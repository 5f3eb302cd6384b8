"""Pages of parsed documents: one canonical text with the places of pages and blocks in it, and what is wrong with pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunking import canonical

#: Kinds of blocks, and what a page's status may be.
KINDS, STATUSES = ("text", "table", "formula"), ("succeeded", "failed", "skipped")
GAP = 2  # line feeds between blocks


def canonical_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, text, pages, blocks) of pages (``key``, page, blocks: array of kind, text, order).

    Each page begins with a comment that numbers it; blocks follow in order, parted by a blank line. ``pages`` (number, start, end) and
    ``blocks`` (kind, start, end, page, headings) count code points, as ``chunking`` takes them. Places are running sums
    over one document's blocks; a page without blocks has an empty range. Documents with a problem (``page_problems``) are not left out here.
    """
    in_order = F.array_sort(F.transform("blocks", lambda b, i: F.struct(F.coalesce(b["order"], i).alias("order"), i.alias("at"), b["kind"].alias("kind"), canonical(b["text"]).alias("text"))))
    marked = pages.select(key, "page", F.concat(F.lit("<!-- page:"), F.col("page").cast("string"), F.lit(" -->")).alias("marker"), in_order.alias("b"))
    # One row for each page's marker (-1) and each block, in the order of the text.
    rows = marked.select(key, "page", F.posexplode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col("marker").alias("text"))), F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["text"].alias("text"))))).alias("item", "x"))
    w = W.partitionBy(key).orderBy("page", "item")
    rows = rows.withColumn("_gap", F.when(F.row_number().over(w) == 1, 0).otherwise(GAP)).select(key, "page", "item", "x.kind", "x.text", "_gap")
    end = F.sum(F.col("_gap") + F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("text"))
    of_page = placed.groupBy(key, "page").agg(
        F.min("end").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("item", "start", "end", "kind", "text", "_gap"))).alias("items")
    )
    item = lambda x: F.concat(F.repeat(F.lit("\n"), x["_gap"]), x["text"])
    block = lambda p: F.transform(F.filter(p["items"], lambda x: x["item"] > 0), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), p["page"].cast("int").alias("page"), F.array().cast("array<string>").alias("headings")))
    whole = of_page.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "start", "end", "items"))).alias("p"))
    return whole.select(
        key,
        F.array_join(F.flatten(F.transform("p", lambda p: F.transform(p["items"], item))), "").alias("text"),
        F.filter(F.transform("p", lambda p: F.struct(p["page"].cast("int").alias("number"), p["start"].alias("start"), p["end"].alias("end"))), lambda p: p["end"] > p["start"]).alias("pages"),
        F.flatten(F.transform("p", block)).alias("blocks"),
    )


def page_problems(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, problem) of documents whose pages (``key``, page, status, blocks) can't be joined: the first that holds.

    Pages are numbered from 1 without a gap, have succeeded, and hold blocks of known kinds that are not blank; one block there must be.
    """
    bad_kind = F.exists("blocks", lambda b: ~F.coalesce(F.lower(F.trim(b["kind"])), F.lit("")).isin(*KINDS))
    blank = F.exists("blocks", lambda b: F.trim(F.coalesce(b["text"], F.lit(""))) == "")
    seen = pages.groupBy(key).agg(
        F.count_if(F.col("page").isNull() | (F.col("page") < 1)).alias("unnumbered"), F.count_distinct("page").alias("distinct"), F.count("*").alias("n"), F.max("page").alias("last"),
        F.count_if(~F.coalesce("status", F.lit("succeeded")).isin(*STATUSES)).alias("unknown"), F.count_if(F.coalesce("status", F.lit("succeeded")) != "succeeded").alias("open"),
        F.count_if(bad_kind).alias("kinds"), F.count_if(blank).alias("blanks"), F.sum(F.coalesce(F.size("blocks"), F.lit(0))).alias("blocks"),
    )
    problem = (
        F.when(F.col("kinds") > 0, "block_kind").when(F.col("blanks") > 0, "block_blank").when(F.col("unnumbered") > 0, "page_number").when(F.col("unknown") > 0, "page_status")
        .when((F.col("distinct") < F.col("n")) | (F.col("last") != F.col("n")), "page_order").when(F.col("open") > 0, "page_incomplete").when(F.col("blocks") == 0, "no_blocks")
    )
    return seen.select(key, problem.alias("problem")).where("problem is not null")
