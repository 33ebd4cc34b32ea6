"""The conversation log: turns in files whose numbers, times and last response are known from the commit.

Each append adds one file and gives its turns the next numbers; files of about one size are merged into one in the order of time. The last response is in the file whose newest response is
newest, so one file is read for it, however long the log is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternbase import schema
from lanternbase.sources import commits

FANOUT = 16
ROWS = "session_id string, turn_index long, role string, content string, response_id string, ts double"
COLUMNS = [c.split()[0] for c in schema.TURNS.split(", ")]


class TurnLog:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout

    def _files(self) -> list[dict]:
        return commits.latest(self.spark, self.root)[1].get("files", [])

    def _read(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema.TURNS)
        return self.spark.read.schema(schema.TURNS).parquet(*[f"{self.root}/data/{f['name']}" for f in files])

    def append(self, rows: DataFrame) -> None:
        """Adds turns (session_id, turn_index, role, content, response_id, ts), numbered on from the last in the order of ts and turn_index."""

        def change(state: dict) -> dict:
            files, first = state.get("files", []), state.get("next", 1)
            # ranges of time, so that each file of a large append has its own
            ranged = rows.select(*[c.split()[0] for c in ROWS.split(", ")]).repartitionByRange("ts", "turn_index", "session_id").sortWithinPartitions("ts", "turn_index", "session_id")
            name = f"turns-{uuid.uuid4().hex}"
            # numbers ascend with time; those of a large append have gaps between its files
            numbered = ranged.select((F.monotonically_increasing_id() + first).alias("id"), "*")
            new = self._written(numbered, name)
            if not new:
                return state
            files = [*files, *new]
            at = commits.merge_from([f["n"] for f in files], self.fanout)
            if at < len(files):
                merged = self._read(files[at:]).coalesce(1).sortWithinPartitions("ts", "turn_index", "id")
                files = [*files[:at], *self._written(merged, f"merged-{uuid.uuid4().hex}")]
            return {"files": files, "next": max(f["most_id"] for f in new) + 1}

        commits.transact(self.spark, self.root, change)

    def _written(self, turns: DataFrame, name: str) -> list[dict]:
        """Writes turns below the data folder; a record of each file, in the order of time."""
        where = f"{self.root}/data/{name}"
        turns.select(*COLUMNS).write.parquet(where)
        answered = F.max(F.when((F.col("role") == "assistant") & F.col("response_id").isNotNull(), F.struct("ts", "turn_index", "id")))
        stored = self.spark.read.schema(schema.TURNS).parquet(where).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        found = stored.groupBy("file").agg(F.count("*").alias("n"), F.min("ts").alias("least"), F.max("ts").alias("most"), F.max("id").alias("most_id"), answered.alias("answer")).orderBy("least").collect()
        return [{"name": f"{name}/{r['file']}", "n": r["n"], "least": r["least"], "most": r["most"], "most_id": r["most_id"], "answer": list(r["answer"]) if r["answer"] else None} for r in found]

    def turns(self) -> DataFrame:
        """id, session_id, turn_index, role, content, response_id, ts of all turns."""
        return self._read(self._files())

    def last_response(self) -> DataFrame:
        """The newest assistant turn with a response id, from the one file that holds it; no rows if there is none."""
        answered = [f for f in self._files() if f["answer"]]
        if not answered:
            return self._read([])
        last = max(answered, key=lambda f: f["answer"])
        return self._read([last]).where(F.col("id") == last["answer"][2])

    def ordered(self) -> DataFrame:
        """All turns with place (from 1) by ts, turn_index and number. Files of separate times are numbered by themselves, and the places before them follow from the commit; files whose times
        overlap are numbered together."""
        files = sorted(self._files(), key=lambda f: (f["least"], f["most"]))
        groups: list[list[dict]] = []
        for f in files:
            if groups and f["least"] <= max(x["most"] for x in groups[-1]):
                groups[-1].append(f)
            else:
                groups.append([f])
        parts, before = [], 0
        for i, group in enumerate(groups):
            parts.append(self._read(group).withColumn("run", F.lit(i)).withColumn("before", F.lit(before).cast("long")))
            before += sum(f["n"] for f in group)
        if not parts:
            return self._read([]).withColumn("place", F.lit(0).cast("long"))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        own = Window.partitionBy("run").orderBy("ts", "turn_index", "id")
        return whole.withColumn("place", F.col("before") + F.row_number().over(own)).drop("run", "before")
