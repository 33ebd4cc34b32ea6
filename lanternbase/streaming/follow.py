"""Continuous indexing: a stream of a workspace's changes brings the index in step after each."""

from __future__ import annotations

from pyspark.sql.streaming import StreamingQuery

from lanternbase.memory import Memory
from lanternbase.sources.markdown import qualified
from lanternbase.sources.tree import FolderChanges

INTERVAL = "10 seconds"


def follow(memory: Memory, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream. New, edited and deleted files each start a pass, which writes what changed; a look that finds nothing new starts none."""
    spark = memory.spark
    spark.dataSource.register(FolderChanges)
    changes = spark.readStream.format(FolderChanges.name()).option("path", qualified(spark, f"{memory.config.workspace}/memory")).load()
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _n: None if batch.isEmpty() else memory.index() and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()
