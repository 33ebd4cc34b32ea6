"""The conversation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_role(role: Column) -> Column:
    """assistant, system, and user for anything else."""
    return F.when(role.isin("assistant", "system"), role).otherwise(F.lit("user"))


def history(turns: DataFrame) -> DataFrame:
    """All turns of all sessions, in order of time, then of turn."""
    return turns.select("session_id", "turn_index", decode_role(F.col("role")).alias("role"), "content", "ts").orderBy("ts", "turn_index")


def last_response(turns: DataFrame) -> DataFrame:
    """The latest assistant turn with a response id, of any session; one row or none."""
    return turns.where("role = 'assistant' and response_id is not null").orderBy(F.desc("ts"), F.desc("turn_index"), F.desc("session_id")).limit(1)


def messages(system: str, turns: list[tuple[str, str]], question: str) -> list[dict[str, str]]:
    """What goes to the model: system prompt, history, question."""
    return [{"role": "system", "content": system}, *({"role": r, "content": c} for r, c in turns), {"role": "user", "content": question}]
