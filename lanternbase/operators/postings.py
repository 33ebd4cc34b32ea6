"""A stored inverted index: blocks of postings, phrase matching within rows, and BM25 top-k that skips blocks.

Documents have numbers; those with the same number / SPAN form a span. A block holds the postings of a term in a span: the documents' numbers, how often the term
occurs, the documents' lengths and the positions, packed into bytes, and beside them the pairs of count and length that no other document of the block beats in both, from which the block's
largest score follows whatever the mean length is by then. Lists are made of the blocks that a search reads, none when they are written. Tables of blocks are sorted by term and span, so a filter on
terms reaches the scan and reads their row groups only, and the text of documents is not read at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternbase.functions.scores import rank_to_score
from lanternbase.functions.text import document_tokens, query_phrases
from lanternbase.functions.words import plain, split_plain
from lanternbase.operators.lexical import K1, LEAST_IDF, B

SPAN_BITS = 6
BLOCKS = "term string, span long, n int, tops binary, packed binary"
#: A block's lists, as ``_unpack`` makes them.
LISTS = "term string, span long, n int, docs array<long>, tfs array<int>, dls array<int>, positions array<array<int>>"
#: A file takes a term's blocks of as many neighbouring spans, as a power of two.
TOGETHER_BITS = 14
#: What is shuffled: a row for a term's postings in a slice of documents: the gaps between numbers from the first span on, counts, lengths and gaps between positions, seven bits a byte.
_PACKED = "term string, span long, n int, packed binary"
#: Tokens of a slice of documents, about, and bytes of packed rows that are made blocks together: an array of these takes eight times as many, and a few are held at once.
SLICE, UNPACKED = 1 << 20, 1 << 19
#: Bytes of texts that become tokens together: about a slice.
TEXTS = 6 << 20
#: Numbers that are made bytes together.
WRITTEN = 1 << 17
#: Bytes of stored texts, compressed, whose postings a partition sorts: they take some ten times that in memory.
PARTITION = 8 << 20
#: Terms or spans that go into a filter as literals; more are joined.
LITERALS = 1000
#: Spans with the highest bounds whose scores set the threshold, for each result asked for.
FIRST = 0.5


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some lengths, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _gaps(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The differences of neighbours; the first of each run, whose places are ``begin``, stays."""
    gaps = np.diff(x, prepend=0)
    gaps[begin] = x[begin]
    return gaps


def _sums(gaps: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What ``_gaps`` was made of."""
    total = np.cumsum(gaps, dtype=np.int64)
    return total - np.repeat(total[begin] - gaps[begin], lengths)


def _to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2 ** 35 - 1 as bytes of seven bits, the lowest first and the last one below 128; and how many bytes each takes."""
    made = [_few_to_bytes(values[a : a + WRITTEN]) for a in range(0, max(len(values), 1), WRITTEN)]
    return np.concatenate([d for d, _ in made]), np.concatenate([m for _, m in made])


def _few_to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    many = np.ones(len(values), np.int8)
    for bits in (7, 14, 21, 28):
        many += values >= 1 << bits
    at = np.cumsum(many, dtype=np.int64) - many
    data = np.empty(int(many.sum(dtype=np.int64)), np.uint8)
    for k in range(int(many.max(initial=0))):
        some = np.flatnonzero(many > k)
        data[at[some] + k] = ((values[some] >> 7 * k) & 127) | ((many[some] > k + 1) << 7)
    return data, many


def _from_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that ``_to_bytes`` made bytes, and where each one's bytes end."""
    end = np.flatnonzero(data < 128) + 1
    begin = np.append(0, end[:-1]) if len(end) else end
    many, values = end - begin, (data[begin] & 127).astype(np.int64)
    for k in range(1, int(many.max(initial=0))):
        some = np.flatnonzero(many > k)
        values[some] |= (data[begin[some] + k] & 127).astype(np.int64) << 7 * k
    return values, end


def _packed(doc: np.ndarray, tokens: pa.ListArray) -> pa.RecordBatch | None:
    lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten().dictionary_encode()
    if not len(flat):
        return None
    code, row, pos = flat.indices.to_numpy(), np.repeat(np.arange(len(doc), dtype=np.int32), lengths), _runs(lengths).astype(np.int32)
    # tokens by term; documents and positions keep their order
    order = np.sort((code.astype(np.int64) << 32) + np.arange(len(code))) & 0xFFFFFFFF
    code, row, pos = code[order], row[order], pos[order]
    first = _starts(code, row)
    tf = np.diff(np.append(first, len(code)))
    code, row = code[first], row[first]
    begin = _starts(code, doc[row] >> (SPAN_BITS + TOGETHER_BITS))
    n = np.diff(np.append(begin, len(code)))
    span, occurrences = doc[row[begin]] >> SPAN_BITS, np.add.reduceat(tf, begin)
    sizes = 3 * n + occurrences
    at = np.cumsum(sizes) - sizes
    values, place = np.empty(int(sizes.sum()), np.int32), np.repeat(at, n) + _runs(n)
    values[place] = _gaps(doc[row] - np.repeat(span << SPAN_BITS, n), begin)
    values[place + np.repeat(n, n)] = tf
    values[place + 2 * np.repeat(n, n)] = lengths[row]
    values[np.repeat(at + 3 * n, occurrences) + _runs(occurrences)] = _gaps(pos, first)
    data, many = _to_bytes(values)
    ends = np.append(0, np.cumsum(np.add.reduceat(many, at, dtype=np.int64))).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    columns = [flat.dictionary.take(pa.array(code[begin])), pa.array(span), pa.array(n.astype(np.int32)), binary]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PACKED.split(", ")])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and tokens of documents (number ascending, text if it is plain, else tokens), some texts at a time."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TEXTS, "right")))
            doc, text, other = (c.slice(at, stop - at) for c in batch.columns)
            tokens = split_plain(text)
            if text.null_count:
                place = np.arange(len(doc)) + np.where(text.is_valid().to_numpy(zero_copy_only=False), 0, len(doc))
                tokens = pa.concat_arrays([tokens, other.cast(tokens.type)]).take(pa.array(place))
            yield pa.RecordBatch.from_arrays([doc, tokens], names=["doc_no", "tokens"])
            at = stop


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings of documents (number ascending, tokens), by slices of about SLICE tokens."""
    for batch in batches:
        upto = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
            made = _packed(batch.column(0).slice(at, stop - at).to_numpy(), batch.column(1).slice(at, stop - at))
            if made is not None:
                yield made
            at = stop


def _few_rows(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, by the bytes of a column."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + UNPACKED, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def _numbers(packed: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some packed rows, and how many each row has."""
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    values, end = _from_bytes(np.frombuffer(packed.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]])
    return values, np.diff(np.searchsorted(end, offsets - offsets[0], "right"))


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the postings of some packed rows: row, document, count and length, and the gaps between the positions of all."""
    values, sizes = _numbers(batch.column("packed"))
    first, n = batch.column("span").to_numpy(), batch.column("n").to_numpy().astype(np.int64)
    at = np.cumsum(sizes) - sizes
    place, many = np.repeat(at, n) + _runs(n), np.repeat(n, n)
    doc = _sums(values[place], np.cumsum(n) - n, n) + np.repeat(first << SPAN_BITS, n)
    gaps = values[np.repeat(at + 3 * n, sizes - 3 * n) + _runs(sizes - 3 * n)]
    return np.repeat(np.arange(len(n)), n), doc, values[place + many], values[place + 2 * many], gaps


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of packed rows. Documents of a span that two slices share make a block in each."""
    for batch in _few_rows(batches, "packed"):
        row, doc, tf, dl, gaps = _postings(batch)
        span = doc >> SPAN_BITS
        block = _starts(row, span)
        n, occurrences = np.diff(np.append(block, len(doc))), np.add.reduceat(tf, block)
        sizes = 3 * n + occurrences
        at = np.cumsum(sizes) - sizes
        values, place, many = np.empty(int(sizes.sum()), np.int64), np.repeat(at, n) + _runs(n), np.repeat(n, n)
        values[place] = _gaps(doc - (span << SPAN_BITS), block)
        values[place + many], values[place + 2 * many] = tf, dl
        values[np.repeat(at + 3 * n, occurrences) + _runs(occurrences)] = gaps
        (offsets, tfs), (_, dls) = _tops(np.repeat(np.arange(len(n)), n), tf, dl, len(n))
        pairs = np.stack([tfs, dls], axis=1).ravel()
        columns = [batch.column("term").take(pa.array(row[block])), pa.array(span[block]), pa.array(n.astype(np.int32)), _binary(pairs, 2 * offsets[:-1]), _binary(values, at)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCKS.split(", ")])


def _binary(values: np.ndarray, at: np.ndarray) -> pa.BinaryArray:
    """The bytes of runs of numbers, whose places are ``at``; none is empty."""
    data, many = _to_bytes(values)
    ends = np.append(0, np.cumsum(np.add.reduceat(many, at, dtype=np.int64))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of packed rows or blocks, a row for each span of each."""
    for batch in _few_rows(batches, "packed"):
        row, doc, tf, dl, gaps = _postings(batch)
        block = _starts(row, doc >> SPAN_BITS)
        ends = pa.array(np.append(block, len(doc)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(doc), pa.array(tf.astype(np.int32)), pa.array(dl.astype(np.int32)), _positions(tf, gaps))]
        columns = [batch.column("term").take(pa.array(row[block])), pa.array(doc[block] >> SPAN_BITS), pa.array(np.diff(np.append(block, len(doc))).astype(np.int32)), *lists]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LISTS.split(", ")])


def _positions(tf: np.ndarray, gaps: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tf)).astype(np.int32)), pa.array(_sums(gaps, np.cumsum(tf) - tf, tf).astype(np.int32)))


def _each(batches: Iterator[pa.RecordBatch], positions: bool) -> Iterator[pa.RecordBatch]:
    """segment, term, doc_no, tf, dl (and positions) of each posting of blocks (segment, term, span, n, packed)."""
    for batch in _few_rows(batches, "packed"):
        row, doc, tf, dl, gaps = _postings(batch)
        named = [batch.column(c).take(pa.array(row)) for c in ("segment", "term")]
        columns = [*named, pa.array(doc), pa.array(tf.astype(np.int32)), pa.array(dl.astype(np.int32)), *([_positions(tf, gaps)] if positions else [])]
        yield pa.RecordBatch.from_arrays(columns, names=["segment", "term", "doc_no", "tf", "dl", "positions"][: len(columns)])


def _highest(batches: Iterator[pa.RecordBatch], avgdl: float) -> Iterator[pa.RecordBatch]:
    """segment, term, span, n, top (the largest of a block, for BM25) of blocks (segment, term, span, n, tops)."""
    for batch in _few_rows(batches, "tops"):
        values, sizes = _numbers(batch.column("tops"))
        tf, dl = values[::2], values[1::2]
        top = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl)), (np.cumsum(sizes) - sizes) // 2)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(top)], names=["segment", "term", "span", "n", "top"])


def _tops(block: np.ndarray, tf: np.ndarray, dl: np.ndarray, n_blocks: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Offsets and values of the counts, and of the lengths, of the postings of each block that no shorter document has as often."""
    tf, dl = tf.astype(np.int64), dl.astype(np.int64)
    many, far = int(tf.max(initial=0)) + 1, int(dl.max(initial=0)) + 1
    if n_blocks * many * far < 1 << 62:
        # one number for the three is sorted faster
        rest, tf = np.divmod(np.sort((block * far + dl) * many + (many - 1 - tf)), many)
        (block, dl), tf = np.divmod(rest, far), many - 1 - tf
    else:
        order = np.lexsort((-tf, dl, block))
        block, tf, dl = block[order], tf[order], dl[order]
    high = block * (int(tf.max(initial=0)) + 1) + tf
    above = np.append(-1, np.maximum.accumulate(high)[:-1])
    kept = high > np.maximum(above, block * (int(tf.max(initial=0)) + 1))
    offsets = np.append(0, np.cumsum(np.bincount(block[kept], minlength=n_blocks))).astype(np.int32)
    return [(offsets, tf[kept]), (offsets, dl[kept])]


def blocks(docs: DataFrame, partitions: int) -> DataFrame:
    """Blocks of ``docs`` (doc_no, text), whose numbers ascend within each partition: sorted by term and span, those of a term and 2 ** TOGETHER_BITS spans in one partition."""
    text = F.coalesce("text", F.lit(""))
    mine = docs.select("doc_no", F.when(plain(text), text).alias("text"), F.when(~plain(text), document_tokens(text)).alias("tokens"))
    rows = mine.mapInArrow(lambda batches: _pack(_split(batches)), _PACKED)
    return rows.repartition(partitions, "term", F.shiftright("span", TOGETHER_BITS)).sortWithinPartitions("term", "span").mapInArrow(_cut, BLOCKS)


def write(docs: DataFrame, path: str, n_bytes: int = 0) -> None:
    """Writes the blocks of ``docs``, each file sorted by term and span, with the terms' Bloom filters. The blocks of a term that many documents have go to several files, and there are more
    files where ``n_bytes``, of the stored texts, are many: a task's sort keeps its size."""
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PARTITION))
    writer = blocks(docs, partitions).write
    # packed bytes hardly shrink by a higher level
    writer = writer.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
    writer.option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.writer.version", "v2").parquet(path)


def small(df: DataFrame, keep) -> DataFrame:
    """The same rows as a local table if there are LITERALS at most, which joins then take along without a shuffle; else ``keep(df)``, which writes and reads them."""
    rows = df.limit(LITERALS + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= LITERALS else keep(df)


def few(df: DataFrame, column: str) -> list | None:
    """The distinct values of a column if there are LITERALS at most."""
    found = {r[0] for r in df.select(column).limit(LITERALS + 1).collect()}
    if len(found) > LITERALS // 2:
        found = {r[0] for r in df.select(column).distinct().limit(LITERALS + 1).collect()}
    return sorted(found) if len(found) <= LITERALS else None


def with_terms(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks of the terms of some phrases (terms): by a filter that reaches the scan if they are few, by a join otherwise."""
    terms = wanted.select(F.explode("terms").alias("term"))
    values = few(terms, "term")
    return postings.where(F.col("term").isin(values)) if values is not None else postings.join(terms.distinct(), "term", "left_semi")


def wanted_phrases(queries: DataFrame) -> DataFrame:
    """query_id, terms, times, need (distinct phrases of the query) of the phrases of ``queries`` (query_id, query). Queries with a phrase of no terms find nothing and have no rows."""
    phrases = queries.select("query_id", F.explode(query_phrases(F.col("query"))).alias("terms"))
    each = phrases.groupBy("query_id", "terms").agg(F.count("*").alias("times"))
    mine = Window.partitionBy("query_id")
    counted = each.select("*", F.count("*").over(mine).alias("need"), F.min(F.size("terms")).over(mine).alias("least"), F.max(F.size("terms")).over(mine).alias("most"))
    return counted.where("least > 0").drop("least")


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def saturated(tf: Column, dl: Column, avgdl: float) -> Column:
    """The part of BM25 that grows with a term's count and falls with a document's length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _hits(found: DataFrame, dead: DataFrame | None, positions: bool) -> DataFrame:
    """segment, term, doc_no, tf, dl (and positions) of each posting of some blocks, without documents that are dead (segment, doc_no)."""
    schema = "segment string, term string, doc_no long, tf int, dl int" + ", positions array<int>" * positions
    each = found.select("segment", "term", "span", "n", "packed").mapInArrow(lambda batches: _each(batches, positions), schema)
    return each if dead is None else each.join(dead, ["segment", "doc_no"], "left_anti")


def phrase_counts(hits: DataFrame, phrases: DataFrame) -> DataFrame:
    """terms, segment, doc_no, dl, tf of the documents of ``hits`` that hold a phrase of ``phrases`` (terms).

    A phrase of several terms occurs where its terms' positions, each less its place in the phrase, meet: their lists are intersected within a row.
    """
    parts = phrases.select("terms", F.posexplode("terms").alias("nth", "term"))
    shifted = F.transform("positions", lambda p: p - F.col("nth"))
    lists = hits.join(parts, "term").groupBy("terms", "segment", "doc_no", "dl").agg(F.collect_list(shifted).alias("lists"))
    starts = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)
    return lists.where(F.size("lists") == F.size("terms")).select("terms", "segment", "doc_no", "dl", F.size(starts).alias("tf")).where("tf > 0")


def scored(tf: DataFrame, wanted: DataFrame, n: int, avgdl: float) -> DataFrame:
    """query_id, segment, doc_no, score of documents with all phrases of a query. tf: terms, segment, doc_no, dl, tf; wanted: with column df."""
    weight = idf(F.lit(float(n)), F.col("df")) * saturated(F.col("tf"), F.col("dl"), avgdl) * F.col("times")
    total = tf.join(wanted, "terms").groupBy("query_id", "segment", "doc_no").agg(F.sum(weight).alias("total"), F.count("*").alias("had"), F.first("need").alias("need"))
    return total.where("had = need").select("query_id", "segment", "doc_no", rank_to_score(-F.col("total")).alias("score"))


def frequencies(found: DataFrame, dead: DataFrame | None) -> DataFrame:
    """term, df of some blocks: their counts, less the dead documents of those that have any. Other blocks' lists are not read."""
    df = found.groupBy("term").agg(F.sum("n").alias("df"))
    if dead is None:
        return df
    spans = dead.select("segment", F.shiftright("doc_no", SPAN_BITS).alias("span")).distinct()
    hit = _hits(found.join(spans, ["segment", "span"], "left_semi"), None, False).select("segment", "term", "doc_no").join(dead, ["segment", "doc_no"], "left_semi")
    gone = hit.groupBy("term").agg(F.count("*").alias("gone"))
    return df.join(gone, "term", "left").select("term", (F.col("df") - F.coalesce("gone", F.lit(0))).alias("df")).where("df > 0")


def best(scores: DataFrame, limit: int) -> DataFrame:
    """Of each query, the best ``limit`` documents of each file's numbers, in which the order of numbers is that of ids."""
    own = Window.partitionBy("query_id", "segment", F.shiftright("doc_no", 33)).orderBy(F.desc("score"), "doc_no")
    return scores.withColumn("place", F.row_number().over(own)).where(F.col("place") <= limit).drop("place")


def full_scores(postings: DataFrame, dead: DataFrame | None, wanted: DataFrame, n: int, avgdl: float, keep) -> DataFrame:
    """query_id, segment, doc_no, score of every document that holds all phrases of a query. ``keep`` writes a table and reads it again."""
    found = with_terms(postings, wanted)
    single, several = wanted.where("size(terms) = 1"), wanted.where("size(terms) > 1")
    counts = frequencies(found, dead).select(F.array("term").alias("terms"), "df")
    tf = _hits(found, dead, False).select(F.array("term").alias("terms"), "segment", "doc_no", "dl", "tf")
    if not several.isEmpty():
        # how many documents hold a phrase is known once its positions have met
        phrases = keep(phrase_counts(_hits(with_terms(found, several), dead, True), several.select("terms").distinct()))
        counts = counts.join(single, "terms", "left_semi").unionByName(phrases.groupBy("terms").agg(F.count("*").alias("df")))
        tf = tf.join(single.select("terms").distinct(), "terms", "left_semi").unionByName(phrases)
    return scored(tf, small(wanted.join(counts, "terms"), keep), n, avgdl)


def pruned_scores(postings: DataFrame, dead: DataFrame | None, wanted: DataFrame, n: int, avgdl: float, limit: int, keep) -> tuple[DataFrame, DataFrame]:
    """Scores of the documents that can be among the best ``limit`` of a query without phrases of several terms, and how many spans were looked at.

    From the blocks' largest scores follows a bound for each span that holds all terms of a query. The spans with the highest bounds are scored; the ``limit``-th best score
    found there is a threshold, and only spans whose bound reaches it are scored as well.

    The second table has, for each query, spans (that hold all its terms), first, more and skipped.
    """
    found = with_terms(postings, wanted)
    # several blocks of a span come from batches that met at its middle
    tops = found.select("segment", "term", "span", "n", "tops").mapInArrow(lambda batches: _highest(batches, avgdl), "segment string, term string, span long, n int, top double")
    meta = keep(tops.groupBy("segment", "term", "span").agg(F.sum("n").alias("n"), F.max("top").alias("top")))
    counts = (frequencies(meta, None) if dead is None else frequencies(found, dead)).select(F.array("term").alias("terms"), "df")
    wanted = small(wanted.join(counts, "terms"), keep)
    part = idf(F.lit(float(n)), F.col("df")) * F.col("top") * F.col("times")
    bounds = meta.withColumn("terms", F.array("term")).join(wanted, "terms").groupBy("query_id", "segment", "span").agg(F.sum(part).alias("bound"), F.count("*").alias("had"), F.first("need").alias("need"))
    bounds = bounds.where("had = need").select("query_id", "segment", "span", rank_to_score(-F.col("bound")).alias("bound"))
    turn = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "span")
    bounds = keep(bounds.withColumn("turn", F.row_number().over(turn)))
    # the blocks' bounds are sums in another order than the scores: a little slack keeps equal ones
    ahead = max(4, int(FIRST * limit))

    def evaluate(chosen: DataFrame) -> DataFrame:
        spans = few(chosen, "span")
        some = found if spans is None else found.where(F.col("span").isin(spans))
        some = some.join(chosen.select("segment", "span").distinct(), ["segment", "span"], "left_semi")
        hits = _hits(some, dead, False).select(F.array("term").alias("terms"), "segment", "doc_no", "dl", "tf")
        scores = scored(hits, wanted, n, avgdl)
        # a span may have been scored for another query only
        span = F.shiftright("doc_no", SPAN_BITS)
        return scores.withColumn("span", span).join(chosen.select("query_id", "segment", "span"), ["query_id", "segment", "span"], "left_semi").drop("span")

    first = keep(evaluate(bounds.where(F.col("turn") <= ahead)))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"))
    edge = first.withColumn("place", F.row_number().over(place)).where(F.col("place") == limit).select("query_id", (F.col("score") - 1e-9).alias("edge"))
    rest = keep(bounds.where(F.col("turn") > ahead).join(edge, "query_id", "left").where("edge is null or bound >= edge").select("query_id", "segment", "span"))
    counted = bounds.groupBy("query_id").agg(F.count("*").alias("spans"), F.sum(F.when(F.col("turn") <= ahead, 1).otherwise(0)).alias("first"))
    counted = counted.join(rest.groupBy("query_id").agg(F.count("*").alias("more")), "query_id", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    counted = counted.withColumn("skipped", F.col("spans") - F.col("first") - F.col("more"))
    return (first if rest.isEmpty() else first.unionByName(evaluate(rest))), counted
