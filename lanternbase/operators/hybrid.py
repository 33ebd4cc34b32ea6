"""Hybrid search: keyword and vector candidates fused, optionally rescored, decayed by age and cut to a context."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternbase.functions.scores import decay, sigmoid
from lanternbase.operators.lexical import keyword_search
from lanternbase.operators.vector import vector_search

#: Candidates that each retriever fetches for every result (fixed value).
OVERFETCH = 3
#: What results show of a chunk.
SHOWN = ("path", "start_line", "end_line", "text")


def fuse(by_vector: DataFrame, by_text: DataFrame, limit: int, vector_weight: float = 0.7, text_weight: float = 0.3) -> DataFrame:
    """query_id, id, score, raw_score, vector_score, text_score: weighted sums, a missing side counts as zero; the best ``limit`` stay."""
    v = by_vector.select("query_id", "id", F.col("score").alias("vector_score"))
    t = by_text.select("query_id", "id", F.col("score").alias("text_score"))
    both = v.join(t, ["query_id", "id"], "full_outer")
    total = F.coalesce(F.col("vector_score") * vector_weight, F.lit(0.0)) + F.coalesce(F.col("text_score") * text_weight, F.lit(0.0))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = both.withColumn("score", total).withColumn("place", F.row_number().over(best))
    return ranked.where(F.col("place") <= limit).select("query_id", "id", "score", F.col("score").alias("raw_score"), "vector_score", "text_score")


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    limit: int,
    vector_weight: float = 0.7,
    text_weight: float = 0.3,
    keyword: Callable[[DataFrame, int], DataFrame] | None = None,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Results of ``queries`` (query_id, query, vector) on ``chunks`` (id, path, start_line, end_line, text, embedding).

    ``keyword`` is a keyword search over the same chunks, such as that of a stored index; without it their texts are read. ``fetch`` adds path, lines and text
    to the results, where there is a shorter way to them than a join with all chunks.
    """
    near = vector_search(queries, chunks.select("id", "embedding"), OVERFETCH * limit)
    words = keyword(queries, OVERFETCH * limit) if keyword else keyword_search(queries, chunks.select("id", "text"), OVERFETCH * limit)
    found = fuse(near, words, limit, vector_weight, text_weight)
    return fetch(found) if fetch else found.join(chunks.select("id", *SHOWN), "id")


def rescore(results: DataFrame, queries: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """``results`` with the score of a cross-encoder, as a sigmoid of its logit; vector and text scores stay."""
    logit = F.pandas_udf(scorer, "double")
    both = results.join(queries.select("query_id", "query"), "query_id")
    score = sigmoid(logit("query", "text"))
    return both.withColumn("score", score).withColumn("raw_score", F.col("score")).drop("query")


def decayed(results: DataFrame, as_of: Column, half_life_days: float = 30.0) -> DataFrame:
    """raw_score is the score so far, score the one lessened by the age of dated files."""
    return results.withColumn("raw_score", F.col("score")).withColumn("score", F.col("score") * decay(F.col("path"), as_of, half_life_days))


def search(
    queries: DataFrame,
    chunks: DataFrame,
    limit: int,
    as_of: Column | None = None,
    half_life_days: float = 30.0,
    vector_weight: float = 0.7,
    text_weight: float = 0.3,
    scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
    keyword: Callable[[DataFrame, int], DataFrame] | None = None,
    fetch: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Hybrid search, then rescoring if there is a scorer, then decay. Decay comes after the cut and brings in no rows."""
    found = hybrid_search(queries, chunks, limit, vector_weight, text_weight, keyword, fetch)
    if scorer is not None:
        found = rescore(found, queries, scorer)
    return decayed(found, F.current_date() if as_of is None else as_of, half_life_days)


def context(results: DataFrame, limit: int = 3, threshold: float = 0.5) -> DataFrame:
    """Of each query, the best ``limit`` by decayed score among those whose undecayed score reaches the threshold."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return results.where(F.col("raw_score") >= threshold).withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
