"""Context for an answer: items rendered and packed into a token budget, and the rules for where citations point."""

from __future__ import annotations

import functools
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimate, prefix

WIKI_SHARE = 0.6
ITEMS = "{query} {kind}, channel string, rank int, id {id_kind}, text string, tokens long, outcome string"


def first_of_sources(sources: Iterable[DataFrame], by: list[str], page: str = "page_id") -> DataFrame:
    """Rows of the sources one after the other, of each page (per ``by``) the first: by source, then ``rank``.

    The sources have the same columns. Among rows of one page, source and rank an arbitrary one stays; null pages are one page.
    """
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        out = s if out is None else out.unionByName(s)
    place = F.row_number().over(W.partitionBy(*by, page).orderBy("_source", "rank"))
    return out.withColumn("_place", place).where("_place = 1").drop("_place", "_source")


def _wiki(row, budget: int) -> tuple[str, bool]:
    whole = f"### Wiki · {row.title}\n{row.content or ''}".strip()
    if estimate(whole) <= budget:
        return whole, False
    blocks = (row.content or "").split("\n\n")
    hits = [i for i, b in enumerate(blocks) if any(t in b.lower() for t in (row.terms if row.terms is not None else []))] or [0]
    near = sorted({j for i in hits for j in (i - 1, i, i + 1) if 0 <= j < len(blocks)})
    return prefix(f"### Wiki · {row.title}\n" + "\n\n".join(blocks[j] for j in near), budget), True


def _raw(row, budget: int) -> tuple[str, bool]:
    head, header = f"### Raw · {row.title}\n", f"Context header:\n{row.header}\n" if row.header else ""
    child, parent = row.content or "", row.parent or ""
    whole = (head + (header + "\n" if header else "") + (f"Parent context:\n{parent}\n\n" if parent else "") + f"Child chunk:\n{child}").strip()
    if estimate(whole) <= budget:
        return whole, False
    # The child first, then as much of the parent as is left room for.
    lead = f"{head}{header}Child chunk:\n"
    text = lead + prefix(child, max(1, budget - estimate(lead)))
    left = budget - estimate(text) - estimate("\n\nParent context:\n")
    if parent and left > 0:
        text += "\n\nParent context:\n" + prefix(parent, left)
    return prefix(text, budget), True


def assemble(ranked: DataFrame, query: str = "item_id") -> DataFrame:
    """(query, channel, rank, id, text, tokens, outcome): a query's ranked items put into its ``budget`` of tokens, wiki items first.

    ``ranked``: (query, budget, channel wiki or raw, rank, id, title, header, parent, content, terms). Wiki items have 60 %
    of the budget, raw ones the rest; each item after the first costs a separator. What does not fit whole is cut
    (page_truncated, chunk_truncated), what finds nothing left is named budget_exhausted. Only the few ranked items of one
    query meet in a task. Null texts are empty.
    """
    kinds = dict(ranked.dtypes)

    def run(items: pd.DataFrame) -> pd.DataFrame:
        budget = int(items["budget"].iloc[0] or 0)
        left = {"wiki": int(budget * WIKI_SHARE)}
        left["raw"] = budget - left["wiki"]
        out, seen, some = [], set(), False
        order = items.assign(_raw=items["channel"] != "wiki").sort_values(["_raw", "rank"], kind="stable")
        for row in order.itertuples(index=False):
            gap = 1 if some else 0
            if row.channel == "wiki" and row.id in seen:
                continue
            room = left[row.channel] - gap
            text, cut = (_wiki if row.channel == "wiki" else _raw)(row, room) if room > 0 else ("", False)
            if not text:
                out.append((row.channel, row.rank, row.id, "", 0, "budget_exhausted"))
                continue
            seen.add(row.id)
            some, used = True, estimate(text)
            left[row.channel] -= gap + used
            out.append((row.channel, row.rank, row.id, text, used, ("page_truncated" if row.channel == "wiki" else "chunk_truncated") if cut else "whole"))
        made = pd.DataFrame(out, columns=["channel", "rank", "id", "text", "tokens", "outcome"])
        made.insert(0, query, items[query].iloc[0])
        return made

    return ranked.groupBy(query).applyInPandas(run, ITEMS.format(query=query, kind=kinds[query], id_kind=kinds["id"]))


# What a locator may say; of these what must be whole numbers, page numbers, and texts.
FIELDS = ["chunkId", "startOffset", "endOffset", "page", "pageStart", "pageEnd", "pages", "lineStart", "lineEnd", "blockId", "selector"]
NUMBERS = ["startOffset", "endOffset", "page", "pageStart", "pageEnd", "lineStart", "lineEnd"]
PAGES, TEXTS = ["page", "pageStart", "pageEnd"], ["chunkId", "blockId", "selector"]
MOST_SELECTOR = 1000


def locator_problem(locator: Column, source_length: Column, page_count: Column) -> Column:
    """The first rule that a citation's locator (JSON) breaks, null if none. Lengths or counts that aren't known (null) bind nothing.

    Types are those of the JSON text: a number in quotes is none, 1.0 is a whole number, and null is no value that any field may have.
    """
    v, keys = F.try_parse_json(locator), F.json_object_keys(locator)
    kind = {k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) for k in FIELDS}
    number = {k: F.when(_numeric(kind[k]), F.try_variant_get(v, f"$.{k}", "double")) for k in NUMBERS}
    pages = F.when(kind["pages"].isin("ARRAY<VOID>", "ARRAY<BIGINT>", "ARRAY<DOUBLE>") | kind["pages"].startswith("ARRAY<DECIMAL"), F.try_variant_get(v, "$.pages", "array<double>"))
    text = {k: F.when(kind[k] == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in TEXTS}
    has = lambda k: F.array_contains(keys, k)
    known = F.array(*map(F.lit, FIELDS))
    some = lambda conditions: functools.reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions))
    whole = lambda c: F.coalesce((c >= 0) & (c == F.floor(c)), F.lit(False))
    return (
        F.when(keys.isNull() | v.isNull(), "not_an_object")
        .when(F.size(F.array_intersect(keys, known)) == 0, "no_position")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown_field")
        .when(some(has(k) & ~whole(number[k]) for k in NUMBERS), "not_a_number")
        .when(some(number[k] < 1 for k in PAGES), "page_below_one")
        .when((has("startOffset") | has("endOffset")) & ~F.coalesce(number["endOffset"] > number["startOffset"], F.lit(False)), "range_not_rising")
        .when(number["endOffset"] > source_length, "beyond_source")
        .when(number["pageEnd"] < number["pageStart"], "page_range_not_rising")
        .when(has("pages") & (pages.isNull() | F.exists(pages, lambda p: ~whole(p) | (p < 1))), "pages_not_numbers")
        .when(some([*(number[k] > page_count for k in PAGES), F.exists(pages, lambda p: p > page_count)]), "beyond_pages")
        .when(some([*(has(k) & (F.trim(F.coalesce(text[k], F.lit(""))) == "") for k in TEXTS), F.length(text["selector"]) > MOST_SELECTOR]), "empty_or_long")
    )


def _numeric(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def cited_sources(seeds: DataFrame, citations: DataFrame, versions: DataFrame, resources: DataFrame) -> DataFrame:
    """The sources of pages: ``seeds`` (page_id, page_version) with their ``citations`` (page_id, page_version, version_id, ...) of
    ``versions`` (version_id, resource_id, ...) of ``resources`` (resource_id, ...). One joined batch; what any side lacks is left out.

    A page that is named twice among the seeds is taken once; a citation that repeats is kept.
    """
    pages = seeds.select("page_id", "page_version").distinct()
    return citations.join(pages, ["page_id", "page_version"], "left_semi").join(versions, "version_id").join(resources, "resource_id")


def in_scope(rows: DataFrame, stated: DataFrame, traces: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is stated (key) or named by a trace (ids: an array of keys); ids that no row has are passed over.

    A key that is named often counts once; rows that repeat are each kept; null keys name nothing, nor do null arrays.
    """
    named = traces.select(F.explode("ids").alias(key)).unionByName(stated.select(key)).distinct()
    return rows.join(named, key, "left_semi")
