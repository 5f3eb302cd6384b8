"""Reciprocal rank fusion of keyword and vector rankings, and the gate that lets results seed a graph expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK_CONSTANT = 10
MIN_SCORE, MIN_MARGIN = 0.70, 0.10


def fuse(keyword: DataFrame, vector: DataFrame, k: int, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """The k best by 1/(10 + keyword_rank) + 1/(10 + vector_rank), a missing side adding nothing.

    ``keyword``: (query, key, keyword_rank, keyword_score); ``vector``: (query, key, vector_rank, cosine). The
    normalised score is the keyword score, else the cosine moved to 0 to 1.
    """
    both = keyword.join(vector, [query, key], "full_outer")
    part = lambda rank: F.coalesce(1.0 / (RANK_CONSTANT + F.col(rank)), F.lit(0.0))
    scored = both.withColumn("rrf", part("keyword_rank") + part("vector_rank"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cosine") + 1) / 2))
    scored = scored.withColumn("normalised", F.coalesce("keyword_score", moved, F.lit(0.0)))
    rank = F.row_number().over(W.partitionBy(query).orderBy(F.round("rrf", 12).desc(), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def gate(fused: DataFrame, query: str = "item_id") -> DataFrame:
    """With margin (to the next in fused order; the last one's to 0), passes, and the reason where a result does not pass."""
    score = F.coalesce("keyword_score", "normalised")
    following = F.lead(score, 1, 0.0).over(W.partitionBy(query).orderBy("rank"))
    margin = score - following
    reason = (
        F.when(F.col("keyword_rank").isNull(), "no_keyword_rank")
        .when(F.round(score, 9) < MIN_SCORE, "score_below_min")
        .when(F.round(margin, 9) < MIN_MARGIN, "margin_below_min")
    )
    return fused.withColumns({"margin": margin, "reason": reason}).withColumn("passes", F.col("reason").isNull())


def refused(text: Column, top_k: Column, token_budget: Column, most_chars: int = 256, most_results: int = 20, most_tokens: int = 50_000) -> Column:
    """Why a request is refused, or null: an empty query, one of too many code points, results or tokens out of range (null stands for the default)."""
    beyond = lambda c, most: ~F.coalesce(c.between(1, most), F.lit(True))
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "query_empty").when(F.length(text) > most_chars, "query_too_long").when(beyond(top_k, most_results), "results_out_of_range").when(beyond(token_budget, most_tokens), "tokens_out_of_range")
    )
