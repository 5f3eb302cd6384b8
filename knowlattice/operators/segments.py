"""Structure of texts by lines: line records, classes, profiles, strategies, sections, fixed-size chunks.

All are Spark expressions and windows within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TARGET, OVERLAP = 384, 76
# Patterns of line classes (the same in Java and RE2).
FENCE = r"^\s*(?:```|~~~)"
HEADING = r"^\s{0,3}#{1,6}\s+\S"
NUMBERED = r"(?i)^\s*(?:\d+(?:\.\d+){0,5}[.)]?|第\s*[一二三四五六七八九十百千万\d]+\s*[章节]|(?:chapter|section|kapitel)\s+\d+)\s+\S+"
RULE = r"^\s*[-*_](?:\s*[-*_]){2,}\s*$"
DASHES = r"^:?-{3,}:?$"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def cells(line: Column) -> Column:
    """What the pipes of a line part, without one at either end."""
    return F.split(F.regexp_replace(F.regexp_replace(trimmed(line), r"^\|", ""), r"\|$", ""), r"\|", -1)


def is_table_row(line: Column) -> Column:
    return line.contains("|") & (F.size(cells(line)) >= 2)


def is_separator(line: Column) -> Column:
    return is_table_row(line) & F.forall(cells(line), lambda c: trimmed(c).rlike(DASHES))


def is_table_line(line: Column) -> Column:
    """A row that looks like one of a table: a pipe at an end or between blanks, three cells, or a rule of dashes."""
    t = trimmed(line)
    return is_table_row(line) & (t.startswith("|") | t.endswith("|") | t.rlike(r"\s\|\s") | (F.size(cells(line)) >= 3) | is_separator(line))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, start, line_text): each line of each text with the code point it starts at; null texts have none."""
    split = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "line_text"))
    before = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return split.withColumn("start", F.coalesce(F.sum(F.length("line_text") + 1).over(before), F.lit(0)).cast("long"))


def is_marker(line: Column) -> Column:
    """Numbered headings, rules, and lines of 4 to 100 characters in capitals, one of A to Z among them."""
    short = trimmed(line)
    capitals = F.length(short).between(4, 100) & short.rlike("[A-Z]") & (F.upper(short) == short)
    return line.rlike(NUMBERED) | line.rlike(RULE) | capitals


def classified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``lines`` with code (fences and what they hold) and, outside it and independent of each other, heading, marker, table and page_break.

    ``kind`` is the first of these that holds, else text.
    """
    line, fence = F.col("line_text"), F.col("line_text").rlike(FENCE)
    upto = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    found = lines(docs, key, text).withColumn("code", fence | (F.sum(fence.cast("int")).over(upto) % 2 == 1))
    out = lambda c: ~F.col("code") & c
    found = found.withColumns({"heading": out(line.rlike(HEADING)), "marker": out(is_marker(line)), "table": out(is_table_line(line)), "page_break": out(line.contains("\f"))})
    return found.withColumn("kind", F.when(F.col("code"), "code").when(F.col("heading"), "heading").when(F.col("marker"), "marker").when(F.col("table"), "table").otherwise("text"))


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its lines of each class (one line may count in several), page breaks, code points, headings per code point."""
    counted = classified(docs, key, text).groupBy(key).agg(
        F.count_if("heading").alias("headings"), F.count_if("marker").alias("markers"), F.count_if("table").alias("table_lines"), F.count_if("code").alias("code_lines"),
        F.count_if("page_break").alias("page_breaks"), (F.sum(F.length("line_text") + 1) - 1).alias("code_points"),
    )
    return counted.withColumn("density", F.when(F.col("code_points") > 0, F.col("headings") / F.col("code_points")).otherwise(0.0))


def strategy(headings: Column, density: Column, markers: Column, page_breaks: Column, parser_blocks: Column | None = None, parser_pages: Column | None = None, strong_blocks: Column | None = None) -> Column:
    """How a text is cut: by a parser's blocks (a code, table or formula block, several blocks or several pages), headings, markers, or size."""
    count = lambda c: F.lit(0) if c is None else F.coalesce(c, F.lit(0))
    return F.when((count(strong_blocks) > 0) | (count(parser_blocks) > 1) | (count(parser_pages) > 1), "parser").when((headings >= 3) & (density > 0.005), "heading").when((markers >= 5) | (page_breaks > 0), "heuristic").otherwise("legacy")


def heading_title(line: str = "line_text") -> Column:
    return F.trim(F.regexp_replace(line, r"^\s*#+", ""))


def marker_title(line: str = "line_text") -> Column:
    return trimmed(F.regexp_replace(line, "\f", " "))


def sections(docs: DataFrame, starts: Column, key: str = "doc_id", text: str = "text", title: Column | None = None) -> DataFrame:
    """(key, section, start, end, title): ranges that begin at the lines where ``starts`` holds; what stands before the first is section 0."""
    found = classified(docs, key, text).withColumn("begins", starts)
    upto = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    numbered = found.withColumn("section", F.sum(F.col("begins").cast("int")).over(upto).cast("int"))
    return numbered.groupBy(key, "section").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.length("line_text")).alias("end"), F.max(F.when(F.col("begins"), heading_title() if title is None else title)).alias("title")
    )


def fixed_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, sequence, start, end, content): pieces of ``target`` code points, each ``overlap`` into the one before; blank ones are left out."""
    step = target - overlap
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1 - overlap, F.lit(0)), F.lit(step)))
    pieces = docs.select(key, text, F.posexplode(starts).alias("sequence", "start"))
    end = F.least(F.col("start") + target, n)
    return pieces.select(key, "sequence", "start", end.alias("end"), F.substr(text, F.col("start") + 1, F.lit(target)).alias("content")).where("trim(content) != ''")


def coverage_gaps(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sequence, problem) of chunks (key, sequence, start, end) that leave a gap, turn back or are empty."""
    w = W.partitionBy(key).orderBy("sequence")
    last_end, last_start = F.lag("end", 1, 0).over(w), F.lag("start", 1, -1).over(w)
    problem = F.when(F.col("end") <= F.col("start"), "empty").when(F.col("start") > last_end, "gap").when(F.col("start") <= last_start, "order")
    return chunks.select(key, "sequence", problem.alias("problem")).where("problem is not null")


def overlapping(ranges: DataFrame, others: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of the same document whose half-open ranges (start, end) and (other_start, other_end) overlap; missing bounds count as overlapping."""
    meets = (F.col("start") < F.col("other_end")) & (F.col("end") > F.col("other_start"))
    return ranges.join(others, key).where(F.coalesce(meets, F.lit(True)))
