"""Keyword search: all phrases must occur; BM25 over the whole index.

This is the search over texts that no index holds; ``segments`` has one that is stored. The texts are tokenised once for a batch of queries, and only the tokens that some query asks for become
rows; beyond LITERALS terms all do, and meet the terms in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternbase.functions.scores import rank_to_score
from lanternbase.functions.text import document_tokens, query_phrases
from lanternbase.sources.shared import keep

#: Parameters of BM25 (fixed values).
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms that go into the filter on tokens as literals.
LITERALS = 1000


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n documents, n_tokens, avgdl."""
    length = docs.select(F.size(document_tokens(F.col("text"))).alias("dl"))
    return length.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, df, tf over all documents; ids do not repeat."""
    tokens = docs.select(document_tokens(F.col("text")).alias("t"))
    # a document's distinct terms beside all of them: only sums by term are shuffled
    both = tokens.select(F.inline(F.array(F.struct(F.lit(0).alias("df"), F.lit(1).alias("tf"), F.col("t")), F.struct(F.lit(1).alias("df"), F.lit(0).alias("tf"), F.array_distinct("t").alias("t")))))
    each = both.select("df", "tf", F.explode("t").alias("term"))
    return each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def keyword_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, id, rank of every document of ``docs`` (id, text) that holds all phrases of a query of ``queries`` (query_id, query).

    rank is negative, lower is better. A phrase that a query repeats counts again; a query without phrases, or with one that
    has no terms, finds nothing.
    """
    phrases = queries.select("query_id", F.explode(query_phrases(F.col("query"))).alias("terms"))
    wanted = phrases.groupBy("query_id", "terms").agg(F.count("*").alias("times"))
    need = wanted.groupBy("query_id").agg(F.count("*").alias("need"), F.min(F.size("terms")).alias("least"))
    terms = wanted.select("terms").distinct().where(F.size("terms") > 0).select("terms", F.posexplode("terms").alias("nth", "term"))
    # one pass over the texts: a document's length, for the mean as well, and its tokens that a query asks for, before any becomes a row
    tokens = docs.select("id", document_tokens(F.col("text")).alias("t"))
    asked = {r["term"] for r in terms.select("term").limit(LITERALS + 1).collect()}
    placed = F.transform("t", lambda t, i: F.struct(i.alias("pos"), t.alias("term")))
    if len(asked) <= LITERALS:
        placed = F.filter(placed, lambda x: x["term"].isin(*sorted(asked)) if asked else F.lit(False))
    held = keep(tokens.select("id", F.size("t").alias("dl"), placed.alias("placed")))
    tokens = held.select("id", "dl", F.inline("placed"))
    starts = tokens.join(terms, "term").groupBy("terms", "id", "dl", (F.col("pos") - F.col("nth")).alias("at")).count()
    tf = starts.where(F.col("count") == F.size("terms")).groupBy("terms", "id", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("terms").agg(F.count("*").alias("df"))
    stats = held.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = tf.join(df, "terms").crossJoin(F.broadcast(stats)).select("terms", "id", weight.alias("weight"))
    found = hits.join(wanted, "terms").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("times")).alias("total"), F.count("*").alias("had"))
    return found.join(need, "query_id").where("had = need and least > 0").select("query_id", "id", (-F.col("total")).alias("rank"))


def keyword_search(queries: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """query_id, id, score (0 to 1), place (from 1) of the best ``limit`` documents of each query; ties to the smaller id."""
    scored = keyword_scores(queries, docs).select("query_id", "id", rank_to_score(F.col("rank")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
