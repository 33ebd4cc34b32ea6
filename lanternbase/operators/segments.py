"""An index in segments: each update writes what changed, and a commit names the segments that count.

A segment holds the changes of one update: ``files`` (paths that are new, changed or deleted), ``chunks`` (of the new and changed ones, numbered), ``postings`` (their blocks), ``dead`` (the
numbers of the chunks in older segments that it replaces), ``vectors`` (embeddings by the hash of model and input, of all inputs that no older segment has) and ``embeddings`` (the same, by the
chunks' numbers). Texts are written once and meet their vectors by number, so that no text is shuffled for them. Nothing that is written is changed. The bytes of an update
follow the change; small segments are merged into larger ones, so that their number stays small and each chunk is rewritten a logarithmic number of times.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternbase import schema
from lanternbase.functions.text import document_tokens
from lanternbase.operators import index, postings
from lanternbase.operators.chunk import counted_chunks, embedding_input, sha256
from lanternbase.sources import commits
from lanternbase.sources.markdown import exists, n_bytes, remove
from lanternbase.sources.shared import shared_dir

FILES = f"{schema.FILES}, deleted boolean"
CHUNKS = "id string, path string, start_line int, end_line int, model string, text string, context string, key string, dl int, doc_no long"
DEAD = "segment string, doc_no long, dl int"
VECTORS = "key string, vector array<float>"
EMBEDDINGS = "id string, doc_no long, embedding array<float>"
#: Segments of about one size that are merged together.
FANOUT = 4
#: Bytes of a row group of chunks, small for reads by number.
ROW_GROUP = 4 << 20
#: Paths or numbers that go to all tasks, to pick rows with texts or leave them out; where both are more, texts are shuffled.
FEW = 1 << 18
#: Chunks from which searches skip blocks, if they are not told.
PRUNE_FROM = 1_000_000


def _picked(rows: DataFrame, every: DataFrame, wanted: DataFrame, n_every: int, n: int, column: str) -> DataFrame:
    """Those of ``rows``, which may hold texts, whose column is in ``wanted``: ``n`` of the ``n_every`` values of ``every``. No way of it sorts texts."""
    if n == 0 or n == n_every:
        return rows if n else rows.limit(0)
    if n > FEW >= n_every - n:
        return rows.join(every.select(column).join(wanted, column, "left_anti").hint("broadcast"), column, "left_anti")
    return rows.join(wanted.select(column).hint("broadcast" if n <= FEW else "shuffle_hash"), column, "left_semi")


def _columns(schema_: str) -> list[str]:
    return [c.split()[0] for c in schema_.split(", ")]


class SegmentedIndex:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self._drafts = f"{shared_dir(spark)}/segment-drafts-{uuid.uuid4().hex}"

    # reading

    def state(self) -> list[dict]:
        """The live segments, oldest first: name, number of docs and tokens, of dead docs and tokens that it names, and width of vectors."""
        return commits.latest(self.spark, self.root)[1].get("segments", [])

    def _read(self, segments: list[dict], table: str, columns: str) -> DataFrame:
        """Rows of a table of some segments, with the segment's name and place in the list."""
        parts = [
            self.spark.read.schema(columns).parquet(f"{self.root}/segments/{s['name']}/{table}").select(F.lit(s["name"]).alias("segment"), F.lit(i).alias("place"), "*")
            for i, s in enumerate(segments)
            if table in s["tables"]
        ]
        if not parts:
            return self.spark.createDataFrame([], f"segment string, place int, {columns}")
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def _named_dead(self, segments: list[dict]) -> DataFrame | None:
        """segment, doc_no, dl of the chunks that some segments replace, in whichever segment; None if there are none."""
        parts = [self.spark.read.schema(DEAD).parquet(f"{self.root}/segments/{s['name']}/dead") for s in segments if "dead" in s["tables"]]
        if not parts:
            return None
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def _dead(self, segments: list[dict]) -> DataFrame | None:
        """segment, doc_no, dl of the replaced chunks of live segments; a merged segment names those of older ones only."""
        return self._named_dead(segments)

    def _files(self, segments: list[dict]) -> DataFrame:
        """The last row of each path, deleted ones among them."""
        newest = F.max_by(F.struct("hash", "mtime", "size", "deleted"), "place").alias("last")
        return self._read(segments, "files", FILES).groupBy("path").agg(newest).select("path", "last.*")

    def files(self) -> DataFrame:
        """path, hash, mtime, size of the files that the index holds."""
        return self._files(self.state()).where("not deleted").drop("deleted")

    def _live(self, segments: list[dict]) -> DataFrame:
        return self._living(self._read(segments, "chunks", CHUNKS), segments)

    def _living(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """Those of ``rows`` (segment, doc_no) whose chunk is not replaced."""
        dead = self._dead(segments)
        return rows if dead is None else rows.join(dead.select("segment", "doc_no"), ["segment", "doc_no"], "left_anti")

    def _vectors(self, segments: list[dict]) -> DataFrame:
        """key (binary), vector: one of each key."""
        return self._read(segments, "vectors", VECTORS).where("vector is not null").select(F.unhex("key").alias("key"), "vector").dropDuplicates(["key"])

    def chunks(self) -> DataFrame:
        """The chunks of those files. Whoever reads embeddings beside texts has both shuffled; ``embedded`` shuffles nothing."""
        segments = self.state()
        rows = self._live(segments)
        if any("embeddings" in s["tables"] for s in segments):
            rows = rows.join(self._read(segments, "embeddings", EMBEDDINGS).select("segment", "doc_no", "embedding"), ["segment", "doc_no"], "left")
        else:
            rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
        return rows.select(*_columns(schema.CHUNKS))

    def embedded(self) -> DataFrame:
        """id, embedding of the chunks of those files that have one, as they are stored."""
        segments = self.state()
        return self._living(self._read(segments, "embeddings", EMBEDDINGS).where("embedding is not null"), segments).select("id", "embedding")

    def stats(self) -> tuple[int, float]:
        """Number of chunks and their mean length in tokens."""
        segments = self.state()
        n = sum(s["docs"] for s in segments) - sum(s["dead_docs"] for s in segments)
        tokens = sum(s["tokens"] for s in segments) - sum(s["dead_tokens"] for s in segments)
        return n, tokens / n if n else 0.0

    # searching

    def _keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._drafts}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def search(self, queries: DataFrame, limit: int, prune: bool | None = None) -> DataFrame:
        """query_id, id, score (0 to 1), place (from 1) of the best ``limit`` chunks of each of ``queries`` (query_id, query) that hold all its phrases; ties to the smaller id.

        The same rows as ``lexical.keyword_search`` over ``chunks()``, from the blocks of the queries' terms. Queries of single terms can skip blocks that don't matter, by a few more
        passes over less: ``prune`` says whether to, by default from PRUNE_FROM chunks on. The rows are the same.
        """
        return self.search_counting(queries, limit, prune)[0]

    def search_counting(self, queries: DataFrame, limit: int, prune: bool | None = None) -> tuple[DataFrame, DataFrame | None]:
        """``search``, and how many spans of documents each pruned query has, has read and has skipped."""
        segments, (n, avgdl) = self.state(), self.stats()
        blocks, dead = self._read(segments, "postings", postings.BLOCKS).drop("place"), self._dead(segments)
        dead = dead if dead is None else dead.select("segment", "doc_no")
        wanted, counted = postings.small(postings.wanted_phrases(queries), self._keep), None
        plain, other = wanted.where("most = 1"), wanted.where("most > 1")
        if (n >= PRUNE_FROM if prune is None else prune) and not plain.isEmpty():
            scores, counted = postings.pruned_scores(blocks, dead, plain.drop("most"), n, avgdl, limit, self._keep)
            scores = scores if other.isEmpty() else scores.unionByName(postings.full_scores(blocks, dead, other.drop("most"), n, avgdl, self._keep))
        else:
            scores = postings.full_scores(blocks, dead, wanted.drop("most"), n, avgdl, self._keep)
        # a few rows for each query and file of numbers; their ids come from the files' columns, without texts
        found = postings.small(postings.best(scores, limit), self._keep)
        names = self._read(segments, "chunks", CHUNKS).select("segment", "doc_no", "id")
        numbers = postings.few(found, "doc_no")
        names = names if numbers is None else names.where(F.col("doc_no").isin(numbers))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        placed = found.join(names, ["segment", "doc_no"]).withColumn("place", F.row_number().over(order))
        return placed.where(F.col("place") <= limit).select("query_id", "id", "score", "place"), counted

    def fetch(self, found: DataFrame, *columns: str) -> DataFrame:
        """``found`` (with id, such as results of a search) with columns of their chunks: by the filter on ids that skips row groups, if the ids are few."""
        found = postings.small(found, self._keep)
        ids, segments = postings.few(found, "id"), self.state()
        rows = self._read(segments, "chunks", CHUNKS)
        rows = self._living(rows if ids is None else rows.where(F.col("id").isin(ids)), segments)
        return found.join(rows.select("id", *columns), "id")

    # writing

    def update(self, files: DataFrame, model: str, embed: Callable[[Column], Column] | None = None, force: bool = False) -> dict[str, int]:
        """Brings the index in step with ``files`` (path, content, mtime, size); counts of indexed, skipped and deleted files.

        ``embed`` makes the embedding column of a text column (null where it fails). Inputs whose vector the index has are not embedded again; files with a chunk whose embedding failed are
        tried again, though they count as skipped. ``force`` takes nothing over but vectors.
        """
        told: dict[str, int] = {}

        def change(state: dict) -> dict | None:
            known = state.get("segments", [])
            segments = [] if force else known
            disk = self._keep(index.catalog(files))
            changes = self._keep(index.diff(self._files(segments).where("not deleted"), disk))
            told.update(index.counts(changes).first().asDict())
            again = changes.where("status <> 'skipped'").select("path", "status")
            if embed is not None and segments:
                embedded = self._read(segments, "embeddings", EMBEDDINGS).where("embedding is not null").select("segment", "doc_no")
                failed = self._live(segments).select("segment", "doc_no", "path").join(embedded, ["segment", "doc_no"], "left_anti").select("path").distinct()
                again = again.unionByName(changes.where("status = 'skipped'").join(failed, "path", "left_semi").select("path", F.lit("indexed").alias("status")))
            if again.isEmpty() and not force:
                return None
            rows = disk.join(again.where("status = 'indexed'").select("path"), "path", "left_semi").withColumn("deleted", F.lit(False))
            gone = again.where("status = 'deleted'").select("path", F.lit(None).cast("string").alias("hash"), F.lit(None).cast("double").alias("mtime"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("deleted"))
            # contents meet the paths only where some files change and others stay
            indexed = again.where("status = 'indexed'").select("path")
            some = _picked(files, disk, indexed, told["indexed"] + told["skipped"], indexed.count(), "path")
            made = counted_chunks(some.select("path", "content"))
            return {"segments": self._extended(segments, rows.unionByName(gone), made, model, embed, known)}

        commits.transact(self.spark, self.root, change)
        return told

    def apply(self, files: DataFrame, made: DataFrame, model: str = "") -> None:
        """Adds one segment: ``files`` (path, hash, mtime, size, deleted) replace all chunks of their paths by those of ``made`` (id, path, start_line, end_line, text)."""
        counted = made.withColumn("context", F.lit("")).withColumn("dl", F.size(document_tokens(F.col("text"))))
        commits.transact(self.spark, self.root, lambda state: {"segments": self._extended(state.get("segments", []), files, counted, model, None, [])})

    def _extended(self, segments: list[dict], files: DataFrame, made: DataFrame, model: str, embed: Callable[[Column], Column] | None, known: list[dict]) -> list[dict]:
        """The segments with one more, written now; small ones merged."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        where = f"{self.root}/segments/{name}"
        files.select(*_columns(FILES)).write.option("compression", "zstd").parquet(f"{where}/files")
        key = F.lit(None).cast("string") if embed is None else sha256(F.concat_ws("\n", F.lit(model), embedding_input(F.col("context"), F.col("text"))))
        lines = [F.col(c).cast("int").alias(c) for c in ("start_line", "end_line")]
        rows = made.select("id", "path", *lines, F.lit(model).alias("model"), "text", "context", key.alias("key"), "dl")
        new = {"name": name} | self._write_chunks(rows, where)
        new["width"] = 0 if embed is None else self._write_embeddings(self._embedded(where, embed, segments, known), where)
        tables = ["files", *([] if embed is None else ["vectors", "embeddings"])]
        changed = self.spark.read.schema(FILES).parquet(f"{where}/files").select("path")
        gone = self._live(segments).join(changed, "path", "left_semi")
        new |= self._write_dead(gone, where) if segments else {"dead_docs": 0, "dead_tokens": 0}
        new["tables"] = [*tables, "chunks", "postings", *(["dead"] if new["dead_docs"] else [])]
        widths = {s["width"] for s in [*segments, new] if s["width"]}
        if len(widths) > 1:
            raise ValueError(f"embeddings of different widths: {sorted(widths)}")
        return self._merged([*segments, new])

    def _write_chunks(self, rows: DataFrame, where: str) -> dict:
        """Writes chunks with their numbers, which ascend with the ids of each file, and their postings. Only the text is read again, for its terms."""
        rows.sortWithinPartitions("id").withColumn("doc_no", F.monotonically_increasing_id()).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{where}/chunks")
        stored = self.spark.read.schema(CHUNKS).parquet(f"{where}/chunks")
        postings.write(stored.select("doc_no", "text"), f"{where}/postings", n_bytes(self.spark, f"{where}/chunks"))
        row = stored.agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        return {"docs": row["docs"], "tokens": row["tokens"], "width": 0}

    def _write_embeddings(self, vectors: DataFrame, where: str) -> int:
        """Writes the embeddings of a segment's chunks by number, from ``vectors`` (key, vector); their width, 0 if there are none."""
        mine = self.spark.read.schema(CHUNKS).parquet(f"{where}/chunks").select("id", "doc_no", F.unhex("key").alias("key"))
        rows = mine.join(vectors.withColumnRenamed("vector", "embedding"), "key", "left").select(*_columns(EMBEDDINGS))
        rows.write.option("compression", "zstd").parquet(f"{where}/embeddings")
        size = F.size("embedding")
        row = self.spark.read.schema(EMBEDDINGS).parquet(f"{where}/embeddings").where("embedding is not null").agg(F.min(F.when(size > 0, size)).alias("least"), F.max(size).alias("width")).first()
        if row["least"] and row["least"] != row["width"]:
            raise ValueError(f"embeddings of different widths: {[row['least'], row['width']]}")
        return row["width"] or 0

    def _write_dead(self, rows: DataFrame, where: str) -> dict:
        """Writes segment, doc_no and dl (its number of tokens) of chunks that count no longer."""
        rows.select(*_columns(DEAD)).write.option("compression", "zstd").parquet(f"{where}/dead")
        row = self.spark.read.schema(DEAD).parquet(f"{where}/dead").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        return {"dead_docs": row["n"], "dead_tokens": row["tokens"]}

    def _embedded(self, where: str, embed: Callable[[Column], Column], segments: list[dict], known: list[dict]) -> DataFrame:
        """key, vector of the inputs of a segment's chunks: those the index has, and new ones of the other inputs, each asked for once and written. So are those that ``segments`` don't hold."""
        stored = self.spark.read.schema(CHUNKS).parquet(f"{where}/chunks")
        had = self._vectors(known)
        # keys alone tell which inputs are new, and a number stands for each
        mine = stored.groupBy(F.unhex("key").alias("key")).agg(F.min("doc_no").alias("doc_no"))
        new = self._keep(mine.join(had.select("key"), "key", "left_anti").select("doc_no"))
        asked = stored.select("doc_no", "key", embedding_input(F.col("context"), F.col("text")).alias("input"))
        asked = _picked(asked, stored, new, stored.count(), new.count(), "doc_no")
        # failed ones are written as null: a filter on the new column would have the model asked twice
        asked.select("key", embed(F.col("input")).cast("array<float>").alias("vector")).write.option("compression", "zstd").parquet(f"{where}/vectors")
        if segments != known:
            taken = had.join(mine.select("key"), "key", "left_semi")
            taken.select(F.lower(F.hex("key")).alias("key"), "vector").write.mode("append").option("compression", "zstd").parquet(f"{where}/vectors")
        written = self.spark.read.schema(VECTORS).parquet(f"{where}/vectors").where("vector is not null").select(F.unhex("key").alias("key"), "vector")
        return had.unionByName(written) if segments == known else written

    # merging

    def _merged(self, segments: list[dict]) -> list[dict]:
        """The segments with the newest ones merged, if ``fanout`` of them are of about one size: none more than twice all newer ones together."""
        at = commits.merge_from([s["docs"] for s in segments], self.fanout)
        return self._merge(segments, at) if at < len(segments) else segments

    def _merge(self, segments: list[dict], at: int) -> list[dict]:
        """The segments from place ``at`` on as one."""
        older, some = segments[:at], segments[at:]
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        where = f"{self.root}/segments/{name}"
        last = self._files(some)
        # a deletion counts as long as an older segment may hold the path
        (last if older else last.where("not deleted")).write.option("compression", "zstd").parquet(f"{where}/files")
        rows = self._live(segments).where(F.col("segment").isin([s["name"] for s in some]))
        new = {"name": name} | self._write_chunks(rows.drop("segment", "place", "doc_no"), where)
        new |= {"dead_docs": 0, "dead_tokens": 0}
        # of the numbers that the merged segments name, those of older segments; the older ones' own stay with them
        dead = self._named_dead(some)
        if older and dead is not None:
            new |= self._write_dead(dead.where(F.col("segment").isin([s["name"] for s in older])), where)
        vectors = self._read(some, "vectors", VECTORS).where("vector is not null").select("key", "vector").dropDuplicates(["key"])
        vectors.write.option("compression", "zstd").parquet(f"{where}/vectors")
        embedded = any("embeddings" in s["tables"] for s in some)
        if embedded:
            new["width"] = self._write_embeddings(self._vectors(segments), where)
        new["tables"] = ["files", "chunks", "postings", "vectors", *(["embeddings"] if embedded else []), *(["dead"] if new["dead_docs"] else [])]
        return [*older, new]

    def compact(self) -> None:
        """Merges all segments into one."""
        commits.transact(self.spark, self.root, lambda state: {"segments": self._merge(state["segments"], 0)} if len(state.get("segments", [])) > 1 else None)

    def vacuum(self, keep: int = 2, older_than_s: float = 3600.0) -> list[str]:
        """Removes commits but the last ``keep``, and the segments that none of those names and that were begun ``older_than_s`` seconds ago or earlier; their names.

        Readers of a commit have until it is ``keep`` commits old; writers must finish within that time.
        """
        found = commits.numbers(self.spark, self.root)
        live = {s["name"] for n in found[-keep:] for s in commits.read(self.spark, self.root, n).get("segments", [])}
        gone = [n for n in self.written() if n not in live and int(n.split("-")[0]) < time.time_ns() - older_than_s * 1e9]
        for n in found[:-keep]:
            remove(self.spark, f"{self.root}/log/{n:020d}.json")
        for n in gone:
            remove(self.spark, f"{self.root}/segments/{n}")
        return gone

    def written(self) -> list[str]:
        """Names of all segments in the folder, whether a commit names them or not."""
        if not exists(self.spark, f"{self.root}/segments"):
            return []
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/segments")
        return sorted(s.getPath().getName() for s in where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where))

    def close(self) -> None:
        """Removes what searches and updates wrote on the way; results that have not been read yet need it."""
        if exists(self.spark, self._drafts):
            remove(self.spark, self._drafts)
