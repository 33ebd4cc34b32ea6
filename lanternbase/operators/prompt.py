"""Prompts and printed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternbase.functions.text import trim

#: Opening of a prompt without a context file, and the format around chunks (fixed values).
OPENING = "You are a helpful assistant with access to the user's memory store.\n"
#: Characters that are shown of a text.
SNIPPET = 200


def opening(context_md: str | None) -> str:
    text = (context_md or "").strip()
    return f"{text}\n" if text else OPENING


def system_prompts(chosen: DataFrame, context_md: str | None = None) -> DataFrame:
    """query_id, prompt from ``chosen`` (query_id, place, path, start_line, end_line, text), chunks in order of place."""
    part = F.concat(F.lit("\n---\nSource: "), "path", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")\n"), trim(F.col("text")), F.lit("\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"])
    prompt = F.concat(F.lit(opening(context_md) + "\nRelevant memory:\n"), F.array_join(ordered, ""), F.lit("---\n"))
    return chosen.groupBy("query_id").agg(prompt.alias("prompt"))


def snippet(text: Column, full: bool = False) -> Column:
    short = trim(text)
    return short if full else F.when(F.char_length(short) > SNIPPET, F.concat(F.substring(short, 1, SNIPPET), F.lit("…"))).otherwise(short)


def result_lines(results: DataFrame, full: bool = False) -> DataFrame:
    """query_id, place, line: what is printed of each of ``results`` (with place, score and its parts)."""
    three = lambda c: F.format_string("%.3f", F.col(c))
    parts = F.concat_ws(" ", F.when(F.col("vector_score").isNotNull(), F.concat(F.lit("sem="), three("vector_score"))), F.when(F.col("text_score").isNotNull(), F.concat(F.lit("lex="), three("text_score"))))
    head = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] score="), three("score"), F.lit("  "), parts, F.lit("  "), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    body = F.array_join(F.transform(F.split(snippet(F.col("text"), full), "\r?\n"), lambda x: F.concat(F.lit("    "), x)), "\n")
    return results.select("query_id", "place", F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("line"))


def summary(counts: DataFrame) -> DataFrame:
    return counts.select(F.format_string("indexed: %d  skipped: %d  deleted: %d", "indexed", "skipped", "deleted").alias("summary"))
