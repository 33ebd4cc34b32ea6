"""The registered queries of this subpackage: thin, each one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment
from .common import table
from .hilbert_knn import neighbours
from .image_copies import edited, image_copies, rendered
from .mixing import mix
from .ngram_lm import cross_entropy_difference
from .packing import pack
from .quality import held_out, score, teaching, train
from .rlz_dedup import remove_spans
from .segment_sampling import sample_segmentations
from .simhash import hexadecimal, simhash_groups
from .spelling import spelling_variants
from .suffix_dedup import remove_repeats
from .wordpiece_counts import piece_counts


#: An edited image has the id of the vector it was drawn from plus this.
EDITED = 1 << 40
#: One vector in so many, by hash, also comes as an edited image.
EDITED_ONE_IN = 16


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images and no copies: each embedding is drawn as one, and for some, an edited copy comes to the table (edit: its kind; null: as drawn)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    drawn = vectors.select("id", rendered("embedding").alias("image"))
    lot = F.pmod(F.xxhash64("id"), F.lit(4 * EDITED_ONE_IN))
    some = vectors.select("id", "embedding", lot.cast("int").alias("kind")).where("kind < 4")
    copies = some.select((F.col("id") + EDITED).alias("id"), edited(rendered("embedding"), "kind").alias("image"))
    got = image_copies(drawn.unionByName(copies))
    vec_id = F.when(F.col("id") >= EDITED, F.col("id") - EDITED).otherwise(F.col("id"))
    kind = F.when(F.col("id") >= EDITED, F.pmod(F.xxhash64(vec_id), F.lit(4 * EDITED_ONE_IN))).cast("int")
    return got.select("id", "n_features", "class_id", vec_id.alias("vec_id"), kind.alias("edit"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, train(docs, teaching(table(spark, sf_dir, "labels"))))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts(table(spark, sf_dir, "documents"))


def op8_hilbert_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op9_segment_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(table(spark, sf_dir, "documents"), ["doc_id"])


def op10_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_spans(table(spark, sf_dir, "documents"), digest=True)
    return got.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spelling_variants(table(spark, sf_dir, "documents"), wear=31)
    return got.select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a member of one source, null among them."""
    taken, sources, _ = mix(table(spark, sf_dir, "documents"), F.array("source"))
    own = taken.select("doc_id", "size", F.element_at("sources", 1).alias("source"), "taken")
    found = own.join(sources.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_image_copies": op1_image_copies,
    "op2_quality": op2_quality,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash": op4_simhash,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_hilbert_knn": op8_hilbert_knn,
    "op9_segment_sampling": op9_segment_sampling,
    "op10_rlz_dedup": op10_rlz_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_token_alignment": op12_token_alignment,
    "op13_source_mixing": op13_source_mixing,
}

#: The table of the checksum's bytes, from its polynomial (fixed value).
_CRC = "WITH RECURSIVE crc(b, k, v) AS (SELECT b, 0, b::UBIGINT FROM range(256) r(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM crc WHERE k < 8)"

#: DuckDB SQL of those that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    # a window's hash is put together from those of 2, 4, ... 32 bytes
    "op5_suffix_dedup": r"""WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS l FROM documents),
b AS (SELECT doc_id, unnest(l) AS c, unnest(range(len(l))) AS i FROM d),
h2 AS (SELECT *, md5(c || lead(c, 1) OVER (PARTITION BY doc_id ORDER BY i)) AS x2 FROM b),
h4 AS (SELECT *, md5(x2 || lead(x2, 2) OVER (PARTITION BY doc_id ORDER BY i)) AS x4 FROM h2),
h8 AS (SELECT *, md5(x4 || lead(x4, 4) OVER (PARTITION BY doc_id ORDER BY i)) AS x8 FROM h4),
h16 AS (SELECT *, md5(x8 || lead(x8, 8) OVER (PARTITION BY doc_id ORDER BY i)) AS x16 FROM h8),
h32 AS (SELECT *, md5(x16 || lead(x16, 16) OVER (PARTITION BY doc_id ORDER BY i)) AS x32 FROM h16),
w AS (SELECT doc_id, i, c, md5(x32 || lead(x16, 32) OVER (PARTITION BY doc_id ORDER BY i) || lead(x2, 48) OVER (PARTITION BY doc_id ORDER BY i)) AS h FROM h32),
f AS (SELECT h, min(doc_id) AS least FROM w WHERE h IS NOT NULL GROUP BY h),
g AS (SELECT doc_id, i, c, max(CASE WHEN least < doc_id THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) IS NOT NULL AS gone FROM w LEFT JOIN f USING (h)),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(c, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op10_rlz_dedup": r"""WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') IF x <> ''] AS l FROM documents),
p AS (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM d),
w AS (SELECT doc_id, i, l[i] AS word, CASE WHEN i + 49 <= len(l) THEN md5(array_to_string(l[i:i + 49], ' ')) END AS h FROM p),
f AS (SELECT h, min(doc_id) AS least FROM w WHERE h IS NOT NULL GROUP BY h),
g AS (SELECT doc_id, i, word, max(CASE WHEN least < doc_id THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) IS NOT NULL AS gone FROM w LEFT JOIN f USING (h)),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    # the checksum folds a run's bytes over that of the doc_id; near words meet in the patterns they share
    "op11_spelling_variants": _CRC
    + r""",
t AS (SELECT list(v ORDER BY b) AS v FROM crc WHERE k = 8),
x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM x WHERE length(run) >= 7 GROUP BY ALL),
k AS (SELECT *, unhex('00') || encode(doc_id || ':' || run) AS raw FROM l),
i AS (SELECT *, [('0x' || h)::INT FOR h IN regexp_extract_all(hex(raw), '..')] AS bytes FROM k),
h AS (SELECT doc_id, run, c, xor(list_reduce([4294967295::UBIGINT] || bytes[2:]::UBIGINT[], lambda a, b: xor(a >> 8, t.v[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) AS h FROM i, t),
o AS (SELECT c, CASE WHEN doc_id IS NOT NULL AND h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
p AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
d AS (SELECT word, n, left(word, i) || '*' || substr(word, i + 2) AS wild, left(word, i) || substr(word, i + 2) AS less FROM p),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b USING (wild) WHERE a.word <> b.word
 UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.less UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.less),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(other := other, n := n), struct_pack(a := -n, b := hex(encode(other)))) AS top FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 10 * w.n THEN top.other END AS form, CASE WHEN top.n >= 10 * w.n THEN top.n END AS form_n FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.next IS NULL""",
    # sources that stop are found in the order of size by weight; documents are taken in the order of a digest
    "op13_source_mixing": r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY hex(encode(source)) NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level, row_number() OVER (ORDER BY source_size / weight, k) AS turn
 FROM w WINDOW before AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, turn) AS level FROM o WHERE NOT weight * level > cap),
t AS (SELECT source, source_size, CASE WHEN weight * l.level < cap THEN weight * l.level ELSE cap END AS target FROM w, l),
q AS (SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS full_times, round(target)::BIGINT % greatest(source_size, 1) AS rest FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, p.source, size, source_size, target, (full_times * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source""",
}
