"""The registered queries of the retrieval engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternbase.functions.scores import decay, distance_to_similarity, rank_to_score, sigmoid
from lanternbase.functions.text import STOP_WORDS, query_tokens
from lanternbase.operators import conversation, hybrid, index, lexical, prompt, splits, vector
from lanternbase.operators.chunk import chunks, embedding_input
from lanternbase.operators.pivots import PivotIndex
from lanternbase.operators.segments import SegmentedIndex
from lanternbase.sources import tree
from lanternbase.sources.markdown import qualified, scan
from lanternbase.sources.shared import keep, shared_dir
from lanternbase.sources.turns import TurnLog

AS_OF = "2024-03-01"
TEXT_QUERY, ACCENT_QUERY, PHRASE_QUERY = "how do I find eaux ment", "für über", "of_the"
#: Letters whose shares are the embedding of a text in the queries of the stored index.
LETTERS = "etaoinsh"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _one(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "query_id long, query string")


def _keyword(query: str, limit: int = 20):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = lexical.keyword_search(_one(spark, query), _docs(spark, sf_dir), limit)
        return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "place")

    return run


def query_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _t(spark, sf_dir, "benchmark").select("item_id", query_tokens(F.col("text")).alias("t"))
    return got.select("item_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(_docs(spark, sf_dir)).select("n", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


def document_frequency_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(_docs(spark, sf_dir)).orderBy(F.desc("df"), "term").limit(50)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _first_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where("id = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector.nearest(_first_vector(spark, sf_dir), _vectors(spark, sf_dir), 15)
    return near.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), F.round(distance_to_similarity(F.col("distance")), 6).alias("similarity"), "place")


def vector_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector.vector_search(_first_vector(spark, sf_dir), _vectors(spark, sf_dir), 15)
    return near.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "place")


def _label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").cast("long").alias("query_id"), "vector")


def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector.nearest(_label_queries(spark, sf_dir), _vectors(spark, sf_dir), 15)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "place")


def _pivots(spark: SparkSession, sf_dir: str) -> PivotIndex:
    """The vectors in cells around pivots: written once for this application, then searched."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _pivot_indexes:
        made = PivotIndex(spark, f"{shared_dir(spark)}/pivots-{uuid.uuid4().hex}")
        made.write(_vectors(spark, sf_dir), 64)
        _pivot_indexes[key] = made
    return _pivot_indexes[key]


_pivot_indexes: dict[tuple[str, str], PivotIndex] = {}


def pivots_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _pivots(spark, sf_dir).nearest(_first_vector(spark, sf_dir), 15)
    return near.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), F.round(distance_to_similarity(F.col("distance")), 6).alias("similarity"), "place")


def pivots_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _pivots(spark, sf_dir).nearest(_label_queries(spark, sf_dir), 15)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "place")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the embedding of the same number and a dated path, as chunks: a table of this application, written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _chunk_tables:
        _chunk_tables[key] = keep(_joined(spark, sf_dir))
    return _chunk_tables[key]


_chunk_tables: dict[tuple[str, str], DataFrame] = {}


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, e = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings")
    path = F.concat(F.lit("memory/2024-"), F.lpad((F.col("doc_id") % 14 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("doc_id") % 31 + 1).cast("string"), 2, "0"), F.lit(".md"))
    both = docs.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return both.select(F.col("doc_id").alias("id"), path.alias("path"), F.lit(1).alias("start_line"), F.size(F.split("text", "\n")).alias("end_line"), "text", "embedding")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_vector(spark, sf_dir).withColumn("query", F.lit(TEXT_QUERY))


def _scores(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("id").alias("doc_id"), *more, *[F.round(c, 6).alias(c) for c in ("score", "raw_score", "vector_score", "text_score")])


def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(hybrid.hybrid_search(_asked(spark, sf_dir), _chunked(spark, sf_dir), 10))


def _decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.search(_asked(spark, sf_dir), _chunked(spark, sf_dir), 10, F.to_date(F.lit(AS_OF)))


def hybrid_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(_decayed(spark, sf_dir), "path")


def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    def logit(query, text):
        return text.str.count("e") / text.str.len().clip(lower=1) * 20 - 2

    found = hybrid.search(_asked(spark, sf_dir), _chunked(spark, sf_dir), 10, F.to_date(F.lit(AS_OF)), scorer=logit)
    return _scores(found, "path")


def context_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.context(_decayed(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "place")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown: two titles, and each line behind a bar sign pair promoted to a third-level header."""
    docs = _t(spark, sf_dir, "documents")
    body = F.regexp_replace("text", "\n(?=[A-M])", "\n### ")
    content = F.concat(F.lit("# "), "source", F.lit("\n## "), "lang", F.lit("\n"), body)
    return docs.select(F.concat(F.lit("memory/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), content.alias("content"))


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(_markdown(spark, sf_dir)).select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "context", "text")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(_markdown(spark, sf_dir)).select("path", F.col("start_line").cast("long").alias("start_line"), "id")


def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chunks(_markdown(spark, sf_dir))
    return got.select("path", F.col("start_line").cast("long").alias("start_line"), "context", F.md5(embedding_input(F.col("context"), F.col("text")).cast("binary")).alias("input_md5"))


def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("memory/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"), F.lit(0.0).alias("mtime"), F.octet_length("text").cast("long").alias("size"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier snapshot: the labelled documents, toxic ones with other content, and the pages, which are gone from the disk."""
    labels = _t(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = _t(spark, sf_dir, "documents").join(labels, "doc_id")
    content = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.select(F.concat(F.lit("memory/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2(content.cast("binary"), 256).alias("hash"))
    pages = _t(spark, sf_dir, "pages").select(F.concat(F.lit("memory/page-"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
    return old.unionByName(pages)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.diff(_stored(spark, sf_dir), index.catalog(_disk(spark, sf_dir)))


def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.counts(_changes(spark, sf_dir))


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.summary(index_counts(spark, sf_dir))


def stale_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stale(_stored(spark, sf_dir), index.catalog(_disk(spark, sf_dir)))


def file_hash_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.catalog(_disk(spark, sf_dir)).select("path", "hash", "size")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    answer = F.when(F.col("role") == "assistant", F.concat(F.lit("resp-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_index"), "role", F.col("text").alias("content"), answer.alias("response_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("double").alias("ts"))


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.history(_turns(spark, sf_dir))


def last_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.last_response(_turns(spark, sf_dir)).select("session_id", "turn_index", "response_id")


def _turn_log(spark: SparkSession, sf_dir: str) -> TurnLog:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _turn_logs:
        made = TurnLog(spark, f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}")
        made.append(_turns(spark, sf_dir))
        _turn_logs[key] = made
    return _turn_logs[key]


_turn_logs: dict[tuple[str, str], TurnLog] = {}


def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the stored log in their order."""
    got = _turn_log(spark, sf_dir).ordered()
    return got.select("place", "session_id", "turn_index", "role", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def log_last_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last response, from one file of the stored log."""
    return _turn_log(spark, sf_dir).last_response().select("session_id", "turn_index", "response_id")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.keyword_search(_one(spark, TEXT_QUERY), _docs(spark, sf_dir), 5)
    return found.join(_chunked(spark, sf_dir).drop("embedding"), "id").withColumn("score", F.round("score", 3)).withColumn("text_score", F.col("score")).withColumn("vector_score", F.lit(None).cast("double"))


def system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.system_prompts(_placed(spark, sf_dir))


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompt.result_lines(_placed(spark, sf_dir)).select("place", "line")


def score_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    x = F.col("value")
    return e.select("event_id", *[F.round(c, 6).alias(n) for n, c in (("from_rank", rank_to_score(-x)), ("from_distance", distance_to_similarity(x / 37)), ("squashed", sigmoid(x / 100)))])


#: Stored indexes of this application, by what they hold: built once, then searched.
_stored_indexes: dict[tuple[str, str, str], SegmentedIndex] = {}


def _stored_index(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[SegmentedIndex], None]) -> SegmentedIndex:
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _stored_indexes:
        made = SegmentedIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
        build(made)
        _stored_indexes[key] = made
    return _stored_indexes[key]


def _documents_index(spark: SparkSession, sf_dir: str) -> SegmentedIndex:
    """Whole documents as chunks, in one segment; ids are padded, so that their order as text is that of the numbers."""

    def build(made: SegmentedIndex) -> None:
        docs = _disk(spark, sf_dir).withColumn("id", F.lpad(F.regexp_extract("path", "([0-9]+)", 1), 12, "0"))
        files = docs.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "mtime", "size", F.lit(False).alias("deleted"))
        made.apply(files, docs.select("id", "path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("content").alias("text")))

    return _stored_index(spark, sf_dir, "documents", build)


def _searched(spark: SparkSession, sf_dir: str, queries: list[str], prune: bool) -> DataFrame:
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    found = _documents_index(spark, sf_dir).search(asked, 20, prune)
    return found.select("query_id", F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"), "place")


def postings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch from the stored postings: two terms, folded letters, a phrase, and a query with a phrase of no terms, which finds nothing."""
    return _searched(spark, sf_dir, [TEXT_QUERY, ACCENT_QUERY, PHRASE_QUERY, f"__ {TEXT_QUERY}"], False)


def postings_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by the scan that skips blocks."""
    return _searched(spark, sf_dir, [TEXT_QUERY, ACCENT_QUERY], True)


def _rounds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three snapshots of a folder: labelled documents, toxic ones with another text, beside pages; then all documents; then less the documents of low quality."""
    labels, docs = _t(spark, sf_dir, "labels").select("doc_id", "toxic", "quality"), _t(spark, sf_dir, "documents")
    name = F.concat(F.lit("memory/"), F.col("doc_id").cast("string"), F.lit(".md"))

    def snapshot(rows: DataFrame, content) -> DataFrame:
        return rows.select(name.alias("path"), content.alias("content"), F.lit(0.0).alias("mtime"), F.octet_length(content).cast("long").alias("size"))

    first = snapshot(docs.join(labels, "doc_id"), F.when(F.col("toxic") == 1, F.concat(F.lit("eaux ment "), "text")).otherwise(F.col("text")))
    pages = _t(spark, sf_dir, "pages").select(F.concat(F.lit("memory/page-"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), F.col("html").alias("content"), F.lit(0.0).alias("mtime"), F.octet_length("html").cast("long").alias("size"))
    low = labels.where("quality = 0").select("doc_id")
    return [first.unionByName(pages), snapshot(docs, F.col("text")), snapshot(docs.join(low, "doc_id", "left_anti"), F.col("text"))]


def _edited_index(spark: SparkSession, sf_dir: str) -> SegmentedIndex:
    """The index after those three rounds."""

    def build(made: SegmentedIndex) -> None:
        for files in _rounds(spark, sf_dir):
            made.update(files, "none")

    return _stored_index(spark, sf_dir, "edited", build)


def postings_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword results as they are shown, after two rounds of edits and deletions."""
    made = _edited_index(spark, sf_dir)
    found = made.search(_one(spark, TEXT_QUERY), 20)
    shown = made.fetch(found, *hybrid.SHOWN)
    score = F.round("score", 6)
    return shown.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5(F.col("text").cast("binary")).alias("text_md5"), score.alias("score"), score.alias("raw_score"), score.alias("text_score"), "place")


def _letter_shares(texts: pa.Array) -> pa.Array:
    lengths, counts = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), 1), np.empty((len(texts), len(LETTERS)))
    numbers = np.zeros(256, np.uint8)
    numbers[list(LETTERS.encode())] = np.arange(1, len(LETTERS) + 1)
    for i, text in enumerate(texts):
        counts[i] = np.bincount(numbers[np.frombuffer(text.as_buffer(), np.uint8)], minlength=len(LETTERS) + 1)[1:]
    shares = (counts / lengths[:, None]).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(LETTERS)), pa.array(shares.ravel()))


def _letters(text):
    """An embedding that SQL can make, too: the share of each of some letters. One pass over the bytes counts them all."""
    return F.arrow_udf(_letter_shares, "array<float>")(F.coalesce(text, F.lit("")))


def _passes(spark: SparkSession, sf_dir: str) -> tuple[SegmentedIndex, list[dict[str, int]]]:
    """An index with embeddings over the three rounds, the last one again, and again by force; the counts of each pass."""
    told: list[dict[str, int]] = []

    def build(made: SegmentedIndex) -> None:
        rounds = _rounds(spark, sf_dir)
        told.extend(made.update(files, "letters", _letters) for files in [*rounds, rounds[-1]])
        told.append(made.update(rounds[-1], "letters", _letters, force=True))
        _passes_told[(spark.sparkContext.applicationId, sf_dir)] = told

    made = _stored_index(spark, sf_dir, "embedded", build)
    return made, _passes_told[(spark.sparkContext.applicationId, sf_dir)]


_passes_told: dict[tuple[str, str], list[dict[str, int]]] = {}


def index_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each pass indexed, skipped and deleted; a pass without a change does nothing, a forced one indexes all."""
    told = _passes(spark, sf_dir)[1]
    return spark.createDataFrame([(i, t["indexed"], t["skipped"], t["deleted"]) for i, t in enumerate(told, 1)], "pass long, indexed long, skipped long, deleted long")


def segments_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live chunks' embeddings, all of them taken over by content in the forced pass."""
    e = F.col("embedding")
    return _passes(spark, sf_dir)[0].chunks().select("path", "id", "model", F.size(e).cast("long").alias("width"), *[F.round(e[i].cast("double"), 6).alias(f"share_{c}") for i, c in enumerate(LETTERS)])


def _shown_scores(found: DataFrame) -> DataFrame:
    scores = [F.round(c, 6).alias(c) for c in ("score", "raw_score", "vector_score", "text_score")]
    return found.select("id", "path", F.col("end_line").cast("long").alias("end_line"), F.md5(F.col("text").cast("binary")).alias("text_md5"), *scores)


def hybrid_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search of the stored index after the passes: vectors of chunks that are gone are orphans, and take no place among the candidates."""
    made = _passes(spark, sf_dir)[0]
    asked = _one(spark, TEXT_QUERY).withColumn("vector", _letters(F.col("query")))
    return _shown_scores(hybrid.search(asked, made.embedded(), 10, F.to_date(F.lit(AS_OF)), keyword=made.search, fetch=lambda found: made.fetch(found, *hybrid.SHOWN)))


def hybrid_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search of an index without embeddings: what words alone find, by their weight."""
    made = _edited_index(spark, sf_dir)
    asked = _one(spark, TEXT_QUERY).withColumn("vector", _letters(F.col("query")))
    return _shown_scores(hybrid.search(asked, made.embedded(), 10, F.to_date(F.lit(AS_OF)), keyword=made.search, fetch=lambda found: made.fetch(found, *hybrid.SHOWN)))


def segments_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after those rounds."""
    return _edited_index(spark, sf_dir).files().select("path", "hash", "size")


def segments_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live chunks after those rounds."""
    return _edited_index(spark, sf_dir).chunks().select("path", F.col("end_line").cast("long").alias("end_line"), "id", "model")


def segments_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and mean length of the live chunks, from the commit alone."""
    n, avgdl = _edited_index(spark, sf_dir).stats()
    return spark.range(1).select(F.lit(n).cast("long").alias("n"), F.round(F.lit(avgdl), 6).alias("avgdl"))


def _written(spark: SparkSession, sf_dir: str, kind: str, rows: DataFrame) -> str:
    """A folder of this application that holds rows (path, content) as files, written once by tasks."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _folders:
        folder = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
        tree.write_files(rows.repartition(spark.sparkContext.defaultParallelism), qualified(spark, folder))
        _folders[key] = folder
    return _folders[key]


_folders: dict[tuple[str, str, str], str] = {}


def markdown_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as Markdown files in nested folders, some names hidden, scanned again."""
    name = F.concat(F.lit("memory/"), "source", F.lit("/."), "lang", F.when(F.col("n_chars") > 1000, F.lit("/_long ")).otherwise(F.lit("/")), F.col("doc_id").cast("string"), F.lit(".md"))
    found = scan(spark, _written(spark, sf_dir, "tree", _t(spark, sf_dir, "documents").select(name.alias("path"), F.col("text").alias("content"))))
    return found.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), "size", (F.col("mtime") > 1e9).alias("dated"))


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sections as ``markdown_chunks``, from files that are read as lines by splits."""
    got = splits.file_chunks(spark, _written(spark, sf_dir, "markdown", _markdown(spark, sf_dir)))
    return got.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "context", "text")


def decay_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decay of dated files, of undated ones, and of those with bad or future dates."""
    day = F.concat(F.lit("-"), F.lpad((F.col("doc_id") % 14 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("doc_id") % 33).cast("string"), 2, "0"), F.lit(".md"))
    path = F.when(F.col("lang") == "en", F.concat(F.lit("memory/2023"), day)).when(F.col("lang") == "de", F.concat(F.lit("memory/"), "source", F.lit("/notes.md"))).when(F.col("lang") == "fr", F.concat(F.lit("2024"), day)).otherwise(F.concat(F.lit("memory/x2024"), day))
    rows = _t(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return rows.select("doc_id", "path", F.round(decay(F.col("path"), F.to_date(F.lit(AS_OF)), 30.0), 6).alias("decay"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "keyword_search_top20": _keyword(TEXT_QUERY),
    "keyword_search_accents": _keyword(ACCENT_QUERY),
    "phrase_match": _keyword(PHRASE_QUERY),
    "query_tokenise": query_tokenise,
    "corpus_stats": corpus_stats,
    "document_frequency_top50": document_frequency_top50,
    "vector_topk": vector_topk,
    "vector_minmax": vector_minmax,
    "vector_batch_topk": vector_batch_topk,
    "hybrid_fusion": hybrid_fusion,
    "hybrid_decay": hybrid_decay,
    "hybrid_rerank": hybrid_rerank,
    "context_retrieval": context_retrieval,
    "markdown_chunks": markdown_chunks,
    "chunk_ids": chunk_ids,
    "breadcrumbs": breadcrumbs,
    "index_diff": _changes,
    "index_counts": index_counts,
    "index_summary": index_summary,
    "stale_prune": stale_prune,
    "file_hash_catalog": file_hash_catalog,
    "conversation_history": conversation_history,
    "last_response": last_response,
    "system_prompt": system_prompt,
    "result_lines": result_lines,
    "score_transforms": score_transforms,
    "pivots_topk": pivots_topk,
    "pivots_batch_topk": pivots_batch_topk,
    "postings_lookup": postings_lookup,
    "postings_skipping": postings_skipping,
    "postings_after_edits": postings_after_edits,
    "segments_files": segments_files,
    "segments_chunks": segments_chunks,
    "segments_stats": segments_stats,
    "index_passes": index_passes,
    "segments_vectors": segments_vectors,
    "hybrid_after_edits": hybrid_after_edits,
    "hybrid_without_vectors": hybrid_without_vectors,
    "decay_of_paths": decay_of_paths,
    "markdown_tree": markdown_tree,
    "file_chunks": file_chunks,
    "log_order": log_order,
    "log_last_response": log_last_response,
}

# --- DuckDB SQL ---------------------------------------------------------------------------------------------------

_TOKENS = r"[x FOR x IN regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+') IF x <> '']"


def _bm25(terms: list[str]) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""q(term) AS (VALUES {values}),
d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
st AS (SELECT count(*)::DOUBLE n, avg(len(t)) avgdl FROM d),
tok AS (SELECT doc_id, unnest(t) term FROM d),
tf AS (SELECT doc_id, term, count(*)::DOUBLE tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*)::DOUBLE df FROM tf GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END idf FROM df, st),
s AS (SELECT tf.doc_id, sum(idf * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len(d.t) / st.avgdl))) r, count(*) m
      FROM tf JOIN idf USING (term) JOIN d USING (doc_id), st GROUP BY 1),
kw AS (SELECT doc_id, r / (1 + r) AS score, row_number() OVER (ORDER BY r / (1 + r) DESC, doc_id) AS place
       FROM s WHERE m = (SELECT count(*) FROM q))"""


_PHRASE = f"""WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
st AS (SELECT count(*)::DOUBLE n, avg(len(t)) avgdl FROM d),
tok AS (SELECT doc_id, unnest(t) term, generate_subscripts(t, 1) pos FROM d),
tf AS (SELECT a.doc_id, count(*)::DOUBLE tf FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1),
df AS (SELECT count(*)::DOUBLE df FROM tf),
i AS (SELECT CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END idf FROM df, st),
s AS (SELECT doc_id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) r FROM tf JOIN d USING (doc_id), st, i),
kw AS (SELECT doc_id, r / (1 + r) AS score, row_number() OVER (ORDER BY r / (1 + r) DESC, doc_id) AS place FROM s)
SELECT doc_id, round(score, 6) AS score, place::INT AS place FROM kw WHERE place <= 20"""

_KNN = """near AS (SELECT e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) distance,
 row_number() OVER (ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) place
 FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
sim AS (SELECT vec_id, distance, greatest(0.0, least(1.0, 1 - distance * distance / 2)) similarity, place FROM near WHERE place <= {k}),
mm AS (SELECT *, CASE WHEN max(similarity) OVER () - min(similarity) OVER () > 1e-6
 THEN (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) ELSE similarity END AS score FROM sim)"""

# the chunks searched are the documents, so only their vectors are candidates
_OWN = "FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) e,"
_FUSED = f"""WITH {_bm25(["eaux", "ment"])}, {_KNN.format(k=30).replace("FROM embeddings e,", _OWN)},
paths AS (SELECT doc_id, text, 'memory/2024-' || lpad((doc_id % 14 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 31 + 1)::VARCHAR, 2, '0') || '.md' AS path FROM documents),
ids AS (SELECT coalesce(m.vec_id, k.doc_id) doc_id, m.score vector_score, k.score text_score,
 coalesce(0.7 * m.score, 0) + coalesce(0.3 * k.score, 0) AS fused FROM mm m FULL JOIN (SELECT * FROM kw WHERE place <= 30) k ON m.vec_id = k.doc_id),
top AS (SELECT * FROM ids ORDER BY fused DESC, doc_id LIMIT 10),
shown AS (SELECT top.*, path, text FROM top JOIN paths USING (doc_id))"""

_DAY = "try_strptime(regexp_extract(path, '([0-9]{4}-[0-9]{2}-[0-9]{2})[.]md$', 1), '%Y-%m-%d')::DATE"
_DECAY = f"(CASE WHEN {_DAY} IS NULL THEN 1.0 ELSE exp(-ln(2) / 30 * greatest(0, date_diff('day', {_DAY}, DATE '{AS_OF}'))) END)"
_RERANKED = "(1 / (1 + exp(-((length(text) - length(replace(text, 'e', ''))) / greatest(length(text), 1) * 20 - 2))))"

_LINES = r"""WITH m AS (SELECT 'memory/' || doc_id || '.md' AS p, '# ' || source || chr(10) || '## ' || lang || chr(10) || regexp_replace(text, '\n([A-M])', chr(10) || '### \1', 'g') AS c FROM documents),
a AS (SELECT p, string_split(c, chr(10)) ls FROM m),
b AS (SELECT p, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END ls FROM a),
l AS (SELECT p, generate_subscripts(ls, 1) i, unnest(ls) line FROM b),
h AS (SELECT *, length(regexp_extract(line, '^(#{1,3}) ', 1)) lv, trim(regexp_replace(line, '^#+', '')) title FROM l),
w AS (SELECT *, count(*) FILTER (WHERE lv > 0) OVER o sec, max(i) FILTER (WHERE lv = 1) OVER o i1, max(i) FILTER (WHERE lv = 2) OVER o i2,
 max(i) FILTER (WHERE lv = 3) OVER o i3 FROM h WINDOW o AS (PARTITION BY p ORDER BY i)),
c AS (SELECT w.*, h1.title t1, CASE WHEN w.i2 > coalesce(w.i1, 0) THEN h2.title END t2,
 CASE WHEN w.i3 > greatest(coalesce(w.i1, 0), coalesce(w.i2, 0)) THEN h3.title END t3
 FROM w LEFT JOIN h h1 ON h1.p = w.p AND h1.i = w.i1 LEFT JOIN h h2 ON h2.p = w.p AND h2.i = w.i2 LEFT JOIN h h3 ON h3.p = w.p AND h3.i = w.i3),
g AS (SELECT p, min(i) s, max(i) e, any_value(concat_ws(' > ', t1, t2, t3)) context,
 regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM c GROUP BY p, sec)
"""

_SNAPSHOTS = """WITH disk AS (SELECT 'memory/' || doc_id || '.md' AS path, sha256(text) AS hash FROM documents),
stored AS (SELECT 'memory/' || doc_id || '.md' AS path, sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS hash FROM documents JOIN labels USING (doc_id)
 UNION ALL SELECT 'memory/page-' || page_id || '.md', sha256(html) FROM pages),
changes AS (SELECT path, CASE WHEN d.hash IS NULL THEN 'deleted' WHEN s.hash = d.hash THEN 'skipped' ELSE 'indexed' END AS status
 FROM stored s FULL JOIN disk d USING (path)),
counts AS (SELECT count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
 count(*) FILTER (WHERE status = 'deleted') AS deleted FROM changes)
"""

_TOP5 = f"""WITH {_bm25(["eaux", "ment"])},
shown AS (SELECT place, round(score, 3) AS score, 'memory/2024-' || lpad((doc_id % 14 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 31 + 1)::VARCHAR, 2, '0') || '.md' AS path,
 len(string_split(text, chr(10))) AS lines, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM kw JOIN documents USING (doc_id) WHERE place <= 5)"""

_TWO_QUERIES = [f"SELECT {i}::BIGINT AS query_id, * FROM (WITH {_bm25(t)} SELECT doc_id, round(score, 6) AS score, place::INT AS place FROM kw WHERE place <= 20)" for i, t in ((0, ["eaux", "ment"]), (1, ["fur", "uber"]))]

# the folder after three rounds of edits: documents without those of low quality, each one chunk
_LAST = r"""last AS (SELECT 'memory/' || doc_id || '.md' AS path, text AS content FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
lines AS (SELECT path, content, string_split(content, chr(10)) AS ls FROM last),
parts AS (SELECT path, len(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) AS end_line, regexp_replace(content, '^\s+|\s+$', '', 'g') AS text FROM lines),
live AS (SELECT path, end_line, text, sha256(path || ':1:' || end_line || ':' || sha256(text)) AS id FROM parts WHERE text <> '')"""



def _letters_sql(text: str) -> str:
    return "[" + ", ".join(f"((length({text}) - length(replace({text}, '{c}', ''))) / greatest(length({text}), 1))::FLOAT" for c in LETTERS) + "]"


_LIVE_BM25 = _bm25(["eaux", "ment"]).replace("SELECT doc_id, [x FOR", "SELECT id AS doc_id, [x FOR").replace("FROM documents", "FROM live")
_LIVE_FUSED = f"""WITH {_LAST}, {_LIVE_BM25}, asked AS (SELECT '{TEXT_QUERY}' AS query),
vec AS (SELECT id, {_letters_sql("text")} AS v FROM live), qv AS (SELECT {_letters_sql("query")} AS w FROM asked),
near AS (SELECT id, list_distance(v::DOUBLE[], w::DOUBLE[]) AS distance FROM vec, qv),
sim AS (SELECT id, greatest(0.0, least(1.0, 1 - distance * distance / 2)) AS similarity FROM near ORDER BY distance, id LIMIT 30),
mm AS (SELECT id, CASE WHEN max(similarity) OVER () - min(similarity) OVER () > 1e-6
 THEN (similarity - min(similarity) OVER ()) / (max(similarity) OVER () - min(similarity) OVER ()) ELSE similarity END AS vector_score FROM sim),
words AS (SELECT doc_id AS id, score AS text_score FROM kw WHERE place <= 30),"""
_LIVE_SHOWN = """top AS (SELECT * FROM ids ORDER BY score DESC, id LIMIT 10)
SELECT id, path, end_line::BIGINT AS end_line, md5(text) AS text_md5, round(score, 6) AS score, round(score, 6) AS raw_score, round(vector_score, 6) AS vector_score, round(text_score, 6) AS text_score
FROM top JOIN live USING (id)"""

_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE_SQL: dict[str, str] = {
    "keyword_search_top20": f"WITH {_bm25(['eaux', 'ment'])} SELECT doc_id, round(score, 6) AS score, place::INT AS place FROM kw WHERE place <= 20",
    "keyword_search_accents": f"WITH {_bm25(['fur', 'uber'])} SELECT doc_id, round(score, 6) AS score, place::INT AS place FROM kw WHERE place <= 20",
    "phrase_match": _PHRASE,
    "query_tokenise": rf"""WITH t AS (SELECT item_id, [x FOR x IN regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+') IF strlen(x) >= 2 AND lower(x) NOT IN ({_STOP_SQL})] AS l FROM benchmark)
SELECT item_id, len(l)::BIGINT AS n_tokens, array_to_string(l, ' ') AS tokens FROM t""",
    "corpus_stats": f"SELECT count(*) AS n, sum(len(t))::BIGINT AS n_tokens, round(avg(len(t)), 6) AS avgdl FROM (SELECT {_TOKENS} AS t FROM documents)",
    "document_frequency_top50": f"""WITH tok AS (SELECT doc_id, unnest({_TOKENS}) term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS tf FROM tok GROUP BY term ORDER BY df DESC, term LIMIT 50""",
    "vector_topk": f"WITH {_KNN.format(k=15)} SELECT vec_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity, place::INT AS place FROM mm",
    "vector_minmax": f"WITH {_KNN.format(k=15)} SELECT vec_id, round(score, 6) AS score, place::INT AS place FROM mm",
    "vector_batch_topk": """WITH q AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
n AS (SELECT label::BIGINT AS query_id, vec_id, list_distance(embedding::DOUBLE[], v::DOUBLE[]) d FROM (SELECT vec_id, embedding FROM embeddings), q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) place FROM n)
SELECT query_id, vec_id, round(d, 6) AS distance, place::INT AS place FROM r WHERE place <= 15""",
    "hybrid_fusion": _FUSED + " SELECT doc_id, round(fused, 6) AS score, round(fused, 6) AS raw_score, round(vector_score, 6) AS vector_score, round(text_score, 6) AS text_score FROM shown",
    "hybrid_decay": _FUSED + f" SELECT doc_id, path, round(fused * {_DECAY}, 6) AS score, round(fused, 6) AS raw_score, round(vector_score, 6) AS vector_score, round(text_score, 6) AS text_score FROM shown",
    "hybrid_rerank": _FUSED + f" SELECT doc_id, path, round({_RERANKED} * {_DECAY}, 6) AS score, round({_RERANKED}, 6) AS raw_score, round(vector_score, 6) AS vector_score, round(text_score, 6) AS text_score FROM shown",
    "context_retrieval": _FUSED + f", r AS (SELECT doc_id, fused * {_DECAY} AS score FROM shown WHERE fused >= 0.5), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r) SELECT doc_id, round(score, 6) AS score, place::INT AS place FROM p WHERE place <= 3",
    "markdown_chunks": _LINES + "SELECT p AS path, s AS start_line, e AS end_line, context, text FROM g WHERE text <> ''",
    "chunk_ids": _LINES + "SELECT p AS path, s AS start_line, sha256(p || ':' || s || ':' || e || ':' || sha256(text)) AS id FROM g WHERE text <> ''",
    "breadcrumbs": _LINES + "SELECT p AS path, s AS start_line, context, md5(CASE WHEN context = '' THEN text ELSE context || chr(10) || chr(10) || text END) AS input_md5 FROM g WHERE text <> ''",
    "index_diff": _SNAPSHOTS + "SELECT path, status FROM changes",
    "index_counts": _SNAPSHOTS + "SELECT * FROM counts",
    "index_summary": _SNAPSHOTS + "SELECT 'indexed: ' || indexed || '  skipped: ' || skipped || '  deleted: ' || deleted AS summary FROM counts",
    "stale_prune": _SNAPSHOTS + "SELECT path FROM stored EXCEPT SELECT path FROM disk",
    "file_hash_catalog": "SELECT 'memory/' || doc_id || '.md' AS path, sha256(text) AS hash, strlen(text)::BIGINT AS size FROM documents",
    "conversation_history": "SELECT conv_id::VARCHAR AS session_id, turn AS turn_index, CASE WHEN role IN ('assistant', 'system') THEN role ELSE 'user' END AS role, text AS content, (conv_id * 1000 + turn)::DOUBLE AS ts FROM conversations",
    "last_response": "SELECT conv_id::VARCHAR AS session_id, turn AS turn_index, 'resp-' || conv_id || '-' || turn AS response_id FROM conversations WHERE role = 'assistant' ORDER BY conv_id * 1000 + turn DESC, turn DESC LIMIT 1",
    "system_prompt": _TOP5 + r""" SELECT 0::BIGINT AS query_id, 'You are a helpful assistant with access to the user''s memory store.' || chr(10) || chr(10) || 'Relevant memory:' || chr(10)
 || string_agg(chr(10) || '---' || chr(10) || 'Source: ' || path || ' (lines 1-' || lines || ')' || chr(10) || body || chr(10), '' ORDER BY place) || '---' || chr(10) AS prompt FROM shown HAVING count(*) > 0""",
    "result_lines": _TOP5 + r""" SELECT place::INT AS place, '[' || place || '] score=' || printf('%.3f', score) || '  lex=' || printf('%.3f', score) || '  ' || path || ':1-' || lines || chr(10)
 || array_to_string(['    ' || x FOR x IN string_split(CASE WHEN length(body) > 200 THEN body[1:200] || '…' ELSE body END, chr(10))], chr(10)) || chr(10) AS line FROM shown""",
    "score_transforms": """SELECT event_id, round(CASE WHEN -value < 0 THEN value / (1 + value) ELSE 1 / (1 - value) END, 6) AS from_rank,
 round(greatest(0.0, least(1.0, 1 - (value / 37) * (value / 37) / 2)), 6) AS from_distance, round(1 / (1 + exp(-value / 100)), 6) AS squashed FROM events""",
    "postings_lookup": " UNION ALL ".join([*_TWO_QUERIES, f"SELECT 2::BIGINT, * FROM ({_PHRASE})"]),
    "postings_skipping": " UNION ALL ".join(_TWO_QUERIES),
    "postings_after_edits": f"WITH {_LAST}, "
    + _bm25(["eaux", "ment"]).replace("SELECT doc_id, [x FOR", "SELECT id AS doc_id, [x FOR").replace("FROM documents", "FROM live")
    + """ SELECT path, 1::BIGINT AS start_line, end_line::BIGINT AS end_line, md5(text) AS text_md5, round(score, 6) AS score, round(score, 6) AS raw_score, round(score, 6) AS text_score, place::INT AS place
 FROM kw JOIN live ON live.id = kw.doc_id WHERE place <= 20""",
    "markdown_tree": "SELECT 'memory/' || source || '/.' || lang || CASE WHEN n_chars > 1000 THEN '/_long ' ELSE '/' END || doc_id || '.md' AS path, sha256(text) AS hash, strlen(text)::BIGINT AS size, true AS dated FROM documents",
    "segments_files": f"WITH {_LAST} SELECT path, sha256(content) AS hash, strlen(content)::BIGINT AS size FROM last",
    "segments_chunks": f"WITH {_LAST} SELECT path, end_line::BIGINT AS end_line, id, 'none' AS model FROM live",
    "segments_stats": f"WITH {_LAST} SELECT count(*) AS n, round(avg(len({_TOKENS})), 6) AS avgdl FROM live",
    "index_passes": """WITH l AS (SELECT doc_id, toxic, quality FROM labels JOIN documents USING (doc_id)), n AS (SELECT
 (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM l) AS labelled,
 (SELECT count(*) FROM l WHERE toxic = 1) AS toxic, (SELECT count(*) FROM l WHERE quality = 0) AS low)
SELECT 1::BIGINT AS pass, labelled + pages AS indexed, 0::BIGINT AS skipped, 0::BIGINT AS deleted FROM n
UNION ALL SELECT 2, docs - labelled + toxic, labelled - toxic, pages FROM n
UNION ALL SELECT 3, 0, docs - low, low FROM n UNION ALL SELECT 4, 0, docs - low, 0 FROM n UNION ALL SELECT 5, docs - low, 0, 0 FROM n""",
    "segments_vectors": f"WITH {_LAST} SELECT path, id, 'letters' AS model, {len(LETTERS)}::BIGINT AS width, "
    + ", ".join(f"round({_letters_sql('text')}[{i}]::DOUBLE, 6) AS share_{c}" for i, c in enumerate(LETTERS, 1))
    + " FROM live",
    "hybrid_after_edits": f"""{_LIVE_FUSED}
ids AS (SELECT coalesce(m.id, k.id) AS id, vector_score, text_score, coalesce(0.7 * vector_score, 0) + coalesce(0.3 * text_score, 0) AS score FROM mm m FULL JOIN words k ON m.id = k.id),
{_LIVE_SHOWN}""",
    "hybrid_without_vectors": f"""{_LIVE_FUSED}
ids AS (SELECT id, NULL::DOUBLE AS vector_score, text_score, 0.3 * text_score AS score FROM words),
{_LIVE_SHOWN}""",
    "decay_of_paths": f"""WITH p AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'memory/2023' || day WHEN 'de' THEN 'memory/' || source || '/notes.md' WHEN 'fr' THEN '2024' || day ELSE 'memory/x2024' || day END AS path
 FROM (SELECT *, '-' || lpad((doc_id % 14 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 33)::VARCHAR, 2, '0') || '.md' AS day FROM documents)),
d AS (SELECT doc_id, path, try_strptime(regexp_extract(path, '(^|/)([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})[.]md$', 2), '%Y-%m-%d')::DATE AS day FROM p)
SELECT doc_id, path, round(CASE WHEN day IS NULL THEN 1.0 ELSE exp(-ln(2) / 30 * greatest(0, date_diff('day', day, DATE '{AS_OF}'))) END, 6) AS decay FROM d""",
}
ORACLE_SQL |= {
    "file_chunks": ORACLE_SQL["markdown_chunks"],
    "log_last_response": ORACLE_SQL["last_response"],
    "log_order": "SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn, turn) AS place, conv_id::VARCHAR AS session_id, turn AS turn_index, role, md5(text) AS content_md5 FROM conversations",
}
ORACLE_SQL |= {"pivots_topk": ORACLE_SQL["vector_topk"], "pivots_batch_topk": ORACLE_SQL["vector_batch_topk"]}
