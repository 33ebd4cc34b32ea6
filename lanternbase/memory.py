"""The engine over a workspace folder: index, search, conversation log, prompts."""

from __future__ import annotations

import datetime
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternbase.config import Config
from lanternbase.functions.models import Model, embedding_column
from lanternbase.operators import conversation, hybrid, prompt
from lanternbase.operators.segments import SegmentedIndex
from lanternbase.sources.turns import ROWS, TurnLog
from lanternbase.sources.markdown import exists, make_folder, read_optional, remove, scan

#: Instruction and mark of the fact extraction (fixed values).
FLUSH_PROMPT = (
    "You are extracting durable facts from a conversation to store in long-term memory.\n"
    "Write only facts worth keeping across future sessions: decisions made, preferences expressed, important context, things the user wants to be remembered.\n"
    "Be concise. Use short bullet points. Omit small talk and transient details.\n"
    "If there is nothing worth storing, reply with exactly: @@SILENT@@"
)
SILENT = "@@SILENT@@"


class Memory:
    def __init__(self, spark: SparkSession, config: Config, model: Model, scorer: Callable | None = None):
        self.spark, self.config, self.model, self.scorer = spark, config, model, scorer
        self.root = f"{config.workspace.rstrip('/')}/index"
        self.store = SegmentedIndex(spark, self.root)
        self.log = TurnLog(spark, f"{config.workspace.rstrip('/')}/conversations")

    # index

    def index(self, force: bool = False) -> dict[str, int]:
        """Brings the index in step with the files; counts of indexed, skipped and deleted files.

        What is written follows the changes. Texts whose embedding is stored are not embedded again, and those whose embedding failed are tried again.
        ``force`` indexes everything anew. Conversations are kept apart and stay. Without a folder of files
        one is made, and nothing is pruned.
        """
        if not exists(self.spark, f"{self.config.workspace}/memory"):
            make_folder(self.spark, f"{self.config.workspace}/memory")
            return {"indexed": 0, "skipped": 0, "deleted": 0}
        # one reading of the files for counts, catalogue and chunks, whatever is edited meanwhile
        held = f"{self.root}/scan-{uuid.uuid4().hex}"
        scan(self.spark, self.config.workspace).write.parquet(held)
        try:
            embed = lambda text: embedding_column(self.model, text)
            return self.store.update(self.spark.read.parquet(held), self.config.embed_model, embed, force)
        finally:
            remove(self.spark, held)

    def files(self) -> DataFrame:
        return self.store.files()

    def chunks(self) -> DataFrame:
        return self.store.chunks()

    # search

    def queries(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i, t, self.model.embed(t)) for i, t in enumerate(texts)], "query_id long, query string, vector array<float>")

    def search_keyword(self, text: str, limit: int) -> DataFrame:
        query = self.spark.createDataFrame([(0, text)], "query_id long, query string")
        found = self.store.search(query, limit)
        shown = self._shown(found)
        return shown.select("*", F.col("score").alias("raw_score"), F.lit(None).cast("double").alias("vector_score"), F.col("score").alias("text_score"))

    def _shown(self, found: DataFrame) -> DataFrame:
        return self.store.fetch(found, *hybrid.SHOWN)

    def search(self, text: str, limit: int, as_of: Column | None = None) -> DataFrame:
        c = self.config
        return hybrid.search(self.queries([text]), self.store.embedded(), limit, as_of, c.decay_half_life_days, c.semantic_weight, c.lexical_weight, self.scorer, self.store.search, self._shown)

    def search_for_context(self, text: str, as_of: Column | None = None) -> DataFrame:
        c = self.config
        return hybrid.context(self.search(text, c.retrieval_candidates, as_of), c.retrieval_limit, c.retrieval_threshold)

    def system_prompt(self, text: str, as_of: Column | None = None) -> str:
        return self.prompt_with(self.search_for_context(text, as_of))

    def prompt_with(self, chosen: DataFrame) -> str:
        """The system prompt with these chunks of one query."""
        context_md = read_optional(self.spark, f"{self.config.workspace}/context.md")
        row = prompt.system_prompts(chosen, context_md).first()
        return row["prompt"] if row else prompt.opening(context_md)

    # conversation

    def insert_turn(self, session_id: str, turn_index: int, role: str, content: str, response_id: str | None = None) -> None:
        row = (session_id, turn_index, role, content, response_id, time.time())
        self.log.append(self.spark.createDataFrame([row], ROWS).coalesce(1))

    def turns(self) -> DataFrame:
        return self.log.turns()

    def history(self) -> list[tuple[str, str]]:
        return [(r["role"], r["content"]) for r in conversation.history(self.turns()).toLocalIterator()]

    def last_response_id(self) -> str | None:
        row = self.log.last_response().first()
        return row["response_id"] if row else None

    def flush(self, messages: list[dict[str, str]], today: datetime.date | None = None) -> str | None:
        """Lets the model extract facts, appends them to today's file and indexes it; None if there is nothing to keep."""
        facts = self.model.chat([{"role": "system", "content": FLUSH_PROMPT}, *messages]).strip()
        if not facts or SILENT in facts:
            return None
        path = f"{self.config.workspace}/memory/{(today or datetime.date.today()).isoformat()}.md"
        old = read_optional(self.spark, path)
        gap = "" if old is None or old.endswith("\n\n") else "\n\n"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(where, True)
        out.write(bytearray(f"{old or ''}{gap}{facts}\n".encode()))
        out.close()
        self.index()
        return facts
