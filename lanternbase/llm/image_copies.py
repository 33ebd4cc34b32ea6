"""Copies of images by local descriptors: cropped, edited, turned or resized ones share enough of them in one geometry.

Corners are found on several scales of a gray image, all that stand out in their surroundings; each gets the direction of its
patch's intensity centroid and 256 binary brightness tests turned by it. Descriptors meet by eight Hamming tables of 32 bits: two that are
equal in one, and differ in ``WORD_BITS`` or fewer of the 64 bits of another part. Image pairs of which
``SHARED`` features meet are candidates, and those of which one meets the first of a large bucket. All features of both are then matched (``DIFFERENT_BITS`` or fewer), the matches vote for turn, scale and shift, and
``CONSENSUS`` distinct features that agree, ``AGREE`` of those matched, and ``WHOLE`` of the smaller image's, make a link; linked images form a class.

Byte-identical images are one before all that. Classes need no pair of images that are connected already: small buckets of a table give all
pairs, each larger one its pairs with one image first; after these are judged, it gives the pairs between different classes that differ in ``DIFFERENT_BITS`` of the whole descriptors at most. Buckets
above ``BUCKET`` entries are dealt out as pairs of blocks for that, so that no task holds a hot bucket and no pair of classes is left out.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import only, stash, width
from .components import components

SCALES, RADIUS, APART = (1.0, 1.5, 2.25), 13, 2
#: Corner response (gray levels to the fourth) above the noise of rounding to 256 levels.
RESPONSE = 4.0
BITS, SEGMENT = 256, 32
TABLES, WORDS = BITS // SEGMENT, BITS // 64
DIFFERENT_BITS, SHARED, CONSENSUS, SMALL, BUCKET = 40, 2, 8, 16, 4096
#: Share of the matched features that must agree: with many features, some agree by chance.
AGREE = 0.2
#: Share of the features of the smaller image that must agree. Where corners repeat, one motif gives several features, so that unrelated images agree in 8 now and then, but
#: in less than a sixth of all. Images that overlap in a smaller part must agree in more than ``PART`` features, and in ``COVERED`` of the features in that part.
WHOLE, PART, COVERED = 0.22, 16, 0.3
#: Cells of the votes: turn (a twelfth of a circle), logarithm of the scale, and place as a share of the left side's extent.
CELLS = (np.pi / 6, 0.5, 0.25)
#: places: x, y, scale, angle of each feature, as 32-bit floats; bits: the descriptors.
FEATURES = "id long, n_features int, places binary, bits binary"
#: Bits of the word of a feature that the table's segment is no part of, in which features of a bucket may differ: the tables give chance
#: meetings in proportion to the square of the images, and this leaves out most.
WORD_BITS = 16
#: Kind 0: features n1 of image a and n2 of image b meet; kind 2: they do, and one is the first of a large bucket. Kind 1: feature n1 of image a, with this
#: word, is in bucket b, a large one.
MEETING = "kind int, a long, n1 int, b long, n2 int, word long"


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """Gray image of a binary PGM (P5, up to 255); None for anything else."""
    if not data or data[:2] != b"P5":
        return None
    fields, at = [], 2
    while len(fields) < 3 and at < len(data):
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(data[at:end]))
        at = end
    if len(fields) < 3 or not 0 < fields[2] < 256 or fields[0] * fields[1] == 0 or len(data) < at + 1 + fields[0] * fields[1]:
        return None
    return np.frombuffer(data, np.uint8, fields[0] * fields[1], at + 1).reshape(fields[1], fields[0]).astype(np.float32)


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + np.clip(np.round(image), 0, 255).astype(np.uint8).tobytes()


def resized(image: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear, smaller by ``factor``."""
    h, w = (max(1, int(n / factor)) for n in image.shape)
    y, x = np.minimum((np.arange(h) + 0.5) * factor - 0.5, image.shape[0] - 1), np.minimum((np.arange(w) + 0.5) * factor - 0.5, image.shape[1] - 1)
    y0, x0 = np.maximum(y.astype(int), 0), np.maximum(x.astype(int), 0)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def _box(image: np.ndarray, r: int) -> np.ndarray:
    padded = np.pad(image, r + 1, mode="edge")[:-1, :-1]
    total = padded.cumsum(axis=0).cumsum(axis=1)
    n = 2 * r + 1
    return (total[n:, n:] - total[:-n, n:] - total[n:, :-n] + total[:-n, :-n]) / (n * n)


_rng = np.random.default_rng(64)
_tests = np.clip(_rng.normal(0, RADIUS / 2, (BITS, 4)), -RADIUS + 1, RADIUS - 1)
_grid = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1)), axis=-1).reshape(-1, 2)
_disc = _grid[(_grid**2).sum(axis=1) <= RADIUS**2]
#: Corners that are described together.
TOGETHER = 4096


def features(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) of x, y, scale, angle in the image's pixels, and (n, 4) words of the descriptors: every corner of each scale."""
    places, descriptors = [np.zeros((0, 4))], [np.zeros((0, WORDS), np.uint64)]
    for scale in SCALES:
        small = image.astype(np.float64) if scale == 1 else resized(image.astype(np.float64), scale)
        edge = RADIUS + 2
        if min(small.shape) <= 2 * edge:
            break
        smooth = _box(small, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[edge:-edge, edge:-edge]
        # the least row, then column, of equal neighbours is the corner
        near = range(-APART, APART + 1)
        around = np.max([response[edge + dy : response.shape[0] - edge + dy, edge + dx : response.shape[1] - edge + dx] for dy in near for dx in near if (dy, dx) != (0, 0)], axis=0)
        before = np.max([response[edge + dy : response.shape[0] - edge + dy, edge + dx : response.shape[1] - edge + dx] for dy in near for dx in near if (dy, dx) < (0, 0)], axis=0)
        ys, xs = np.nonzero((inner >= around) & (inner > before) & (inner > RESPONSE))
        for i in range(0, len(xs), TOGETHER):
            y, x = ys[i : i + TOGETHER] + edge, xs[i : i + TOGETHER] + edge
            patch = smooth[y[:, None] + _disc[:, 1], x[:, None] + _disc[:, 0]]
            patch = patch - patch.mean(axis=1, keepdims=True)
            angle = np.arctan2((patch * _disc[:, 1]).sum(axis=1), (patch * _disc[:, 0]).sum(axis=1))
            c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]

            def look(px, py, c=c, s=s, x=x, y=y, smooth=smooth):
                u, v = np.rint(c * px - s * py).astype(int) + x[:, None], np.rint(s * px + c * py).astype(int) + y[:, None]
                return smooth[np.clip(v, 0, smooth.shape[0] - 1), np.clip(u, 0, smooth.shape[1] - 1)]

            bits = look(_tests[:, 0], _tests[:, 1]) < look(_tests[:, 2], _tests[:, 3]) - 1e-9
            descriptors.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
            places.append(np.stack([(x + 0.5) * scale, (y + 0.5) * scale, np.full(len(x), scale), angle], axis=1))
    return np.concatenate(places), np.concatenate(descriptors)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, images in ((batch.column(0)[i : i + 500].to_pylist(), batch.column(1)[i : i + 500].to_pylist()) for i in range(0, len(batch), 500)):
            out: list[tuple] = []
            for image_id, data in zip(ids, images, strict=True):
                image = read_pgm(data)
                if image is not None:
                    place, bits = features(image)
                    if len(bits):
                        out.append((image_id, len(bits), place.astype(np.float32).tobytes(), bits.tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=["id", "n_features", "places", "bits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, id, n, word of rows (id, bits): an entry for each table of each feature."""
    for batch in batches:
        for image_id, bits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            segment = np.frombuffer(bits.as_buffer(), np.uint32).reshape(-1, TABLES).astype(np.int64)
            key = (segment + (np.arange(TABLES, dtype=np.int64) << SEGMENT)).reshape(-1)
            word = np.frombuffer(bits.as_buffer(), np.int64).reshape(-1, WORDS)[:, (np.arange(TABLES) * SEGMENT // 64 + WORDS // 2) % WORDS].reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), image_id)), pa.array(np.repeat(np.arange(len(segment), dtype=np.int32), TABLES)), pa.array(word)], names=["key", "id", "n", "word"])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return begin, np.diff(np.append(begin, len(key)))


def _all_pairs(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs within runs, some at a time."""
    for n in np.unique(size[size > 1]).tolist():
        one, two = np.triu_indices(n, 1)
        some = begin[size == n]
        step = max(1, (1 << 20) // len(one))
        for i in range(0, len(some), step):
            yield (some[i : i + step, None] + one).reshape(-1), (some[i : i + step, None] + two).reshape(-1)


def _meeting(kind: int, a, n1, b, n2, word) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(n1.astype(np.int32)), pa.array(b), pa.array(n2.astype(np.int32)), pa.array(word)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "a", "n1", "b", "n2", "word"])


def _pairs(image: np.ndarray, n: np.ndarray, word: np.ndarray, i: np.ndarray, j: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    ok = (image[i] != image[j]) & (np.bitwise_count((word[i] ^ word[j]).view(np.uint64)) <= WORD_BITS)
    i, j = i[ok], j[ok]
    swap = image[i] > image[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    return _meeting(kind, image[i], n[i], image[j], n[j], np.zeros(len(i), np.int64))


def _meet(small: int):
    """Streams rows (key, id, n, word) sorted by key and id: see ``MEETING``. The first entry of a large bucket is held to all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        hub = None  # key, image, feature and word of the first entry of a large bucket that is not at its end
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(held[0]):
                continue
            key = held[0]
            n = 0
            if hub is not None:
                n = int(np.searchsorted(key, hub[0], "right"))
                some = [c[:n] for c in held]
                yield from _hub(hub, some)
                if n < len(key):
                    hub = None
            stop = len(key) if batch is None else max(n, int(np.searchsorted(key, key[-1])))
            whole, held = [c[n:stop] for c in held], [c[stop:] for c in held]
            begin, size = _runs(whole[0])
            few = size <= small
            for i, j in _all_pairs(begin[few], size[few]):
                yield _pairs(*whole[1:], i, j)
            for s, m in zip(begin[~few].tolist(), size[~few].tolist(), strict=True):
                yield from _hub(tuple(int(c[s]) for c in whole), [c[s : s + m] for c in whole])
            if len(held[0]) > small and (hub is None or held[0][0] != hub[0]):
                hub = tuple(int(c[0]) for c in held)
            if hub is not None and len(held[0]):
                yield from _hub(hub, held)
                held = [c[:0] for c in held]

    def _hub(hub: tuple, some: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, image, n, word = some
        if len(key):
            every = np.arange(len(key))
            yield _pairs(*(np.append(c, x) for c, x in zip(some[1:], hub[1:], strict=True)), every, np.full(len(key), len(key)), 2)
            yield _meeting(1, image, n, key, np.zeros(len(key)), word)

    return run


def _between(bits: int):
    """Pairs of one bucket and different classes that differ in at most ``bits`` bits, of rows (key, id, n, root, side, descriptor) sorted by key.

    Equal sides meet if they are 2 only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [np.zeros(0, np.int64)] * 5, np.zeros((0, WORDS), np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns[:5], strict=True)]
                texts = np.concatenate([texts, np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, WORDS)])
            if not len(held[0]):
                continue
            stop = len(held[0]) if batch is None else int(np.searchsorted(held[0], held[0][-1]))
            (key, image, n, root, side), held = [c[:stop] for c in held], [c[stop:] for c in held]
            descriptor, texts = texts[:stop], texts[stop:]
            for s, m in zip(*(x.tolist() for x in _runs(key)), strict=True):
                r, d, w = (c[s : s + m] for c in (root, side, descriptor))
                if (r == r[0]).all():
                    continue
                for i in range(0, m, 512):
                    y, x = np.nonzero(r[i : i + 512, None] != r[None, i:])
                    y, x = y + i, x + i
                    ok = (x > y) & ((d[y] == 2) | (d[y] != d[x]))
                    y, x = y[ok], x[ok]
                    ok = np.bitwise_count(w[y] ^ w[x]).sum(axis=1, dtype=np.int64) <= bits
                    yield _pairs(image, n, np.zeros(len(image), np.int64), s + y[ok], s + x[ok])

    return run


def _distinct(group: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """How many different ``n`` each group has."""
    both = np.unique(group * (int(n.max(initial=0)) + 1) + n)
    return np.bincount(both // (int(n.max(initial=0)) + 1), minlength=groups)


def _inside(one: np.ndarray, two: np.ndarray, factor: complex, shift: complex) -> int:
    """How many features (x, y, scale, angle) of one image the similarity lays between the other's, on scales that are looked at there."""
    scale = one[:, 2] * abs(factor)
    spot = factor * (one[:, 0] + 1j * one[:, 1]) + shift
    low, high = two[:, :2].min(axis=0) - 2, two[:, :2].max(axis=0) + 2
    inside = (spot.real >= low[0]) & (spot.real <= high[0]) & (spot.imag >= low[1]) & (spot.imag <= high[1])
    return int((inside & (scale > SCALES[0] / 1.2) & (scale < SCALES[-1] * 1.2)).sum())


def _covered(found: int, places: tuple[np.ndarray, np.ndarray], factor: complex, shift: complex) -> bool:
    """Whether ``found`` agreeing features are enough of those that the images should share under the similarity."""
    one, two = places
    if found >= WHOLE * min(len(one), len(two)):
        return True
    return found > PART and found >= COVERED * min(_inside(one, two, factor, shift), _inside(two, one, 1 / factor, -shift / factor))


def consensus(left: np.ndarray, right: np.ndarray, least: int = 1, places: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """Matched features (m, 5: number, x, y, scale, angle) that agree in one similarity: a count of distinct ones on both sides; 0 if under ``least``.

    Each match votes for turn, scale and the place of the left side's middle, in the two nearest cells of each. From every cell
    with ``least`` votes a similarity is fitted, most votes first, until one has as many matches near it, and enough of all features, if ``places`` gives those of both images.
    """
    if len(left) < least:
        return 0
    turn, ratio = np.mod(right[:, 4] - left[:, 4], 2 * np.pi), np.log(right[:, 3] / left[:, 3])
    z, w = left[:, 1] + 1j * left[:, 2], right[:, 1] + 1j * right[:, 2]
    middle = z.mean()
    extent = max(20.0, float(np.abs(z - middle).max()) * 2)
    votes = []
    for scale in (0, 1):
        r = np.floor(ratio / CELLS[1] - 0.5) + scale
        cell = CELLS[2] * extent * np.exp((r + 0.5) * CELLS[1])
        spot = w + np.exp(ratio + 1j * turn) * (middle - z)
        for t, x, y in itertools.product((0, 1), repeat=3):
            votes.append(np.stack([np.mod(np.floor(turn / CELLS[0] - 0.5) + t, round(2 * np.pi / CELLS[0])), r, np.floor(spot.real / cell - 0.5) + x, np.floor(spot.imag / cell - 0.5) + y]))
    key = np.concatenate(votes, axis=1).astype(np.int64)
    key = ((key[0] * 1000003 + key[1]) * 1000003 + key[2]) * 1000003 + key[3]
    match = np.tile(np.arange(len(left)), 16)
    order = np.argsort(key, kind="stable")
    key, match = key[order], match[order]
    begin, size = _runs(key)
    some = np.flatnonzero(size >= least)
    if not len(some):
        return 0
    match = np.concatenate([match[begin[s] : begin[s] + size[s]] for s in some])
    group = np.repeat(np.arange(len(some)), size[some])
    count = np.minimum(*(_distinct(group, side[match, 0].astype(np.int64), len(some)) for side in (left, right)))
    upto = np.concatenate([[0], np.cumsum(size[some])])
    for g in np.argsort(-count, kind="stable"):
        if count[g] < least:
            break
        inside = match[upto[g] : upto[g + 1]]
        about = np.exp(1j * turn[inside]).mean()
        factor = np.exp(np.median(ratio[inside])) * about / max(1e-9, abs(about))
        spot = w[inside] - factor * (z[inside] - middle)
        shift = np.median(spot.real) + 1j * np.median(spot.imag) - factor * middle
        for slack in (0.2, 0.1, 0.05):
            r = abs(factor)
            near = np.abs(factor * z + shift - w) < 3.0 * max(1.0, r) + slack * r * np.abs(z - middle)
            near &= (np.cos(turn - np.angle(factor)) > 0.8) & (np.abs(ratio - np.log(r)) < 0.6)
            found = min(len(np.unique(left[near, 0])), len(np.unique(right[near, 0])))
            if found < least:
                break
            zm, wm = z[near].mean(), w[near].mean()
            spread = (np.abs(z[near] - zm) ** 2).sum()
            if spread > 1e-9:
                factor = (np.conj(z[near] - zm) * (w[near] - wm)).sum() / spread
                shift = wm - factor * zm
            if abs(factor) < 1e-3:
                break
        else:
            if places is None or _covered(found, places, factor, shift):
                return found
    return 0


def matched(one: np.ndarray, two: np.ndarray, bits: int = DIFFERENT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of descriptors (n, words) that differ in at most ``bits`` bits."""
    found = []
    step = max(1, (1 << 20) // max(1, len(two)))
    for i in range(0, len(one), step):
        far = np.bitwise_count(one[i : i + step, None] ^ two[None]).sum(axis=2, dtype=np.int64)
        y, x = np.nonzero(far <= bits)
        found.append((y + i, x))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def linked(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], bits: int = DIFFERENT_BITS, least: int = CONSENSUS) -> bool:
    """Whether two images, given by places and descriptors, are copies."""
    i, j = matched(one[1], two[1], bits)
    met = min(len(np.unique(i)), len(np.unique(j)))
    needed = max(least, int(np.ceil(AGREE * met)))
    return met >= least and consensus(np.hstack([i[:, None], one[0][i]]), np.hstack([j[:, None], two[0][j]]), needed, (one[0], two[0])) >= needed


def _judge(bits: int, least: int):
    """The pairs (a, b, places and bits of a, of b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                sides = [(np.frombuffer(batch.column(c)[i].as_buffer(), np.float32).reshape(-1, 4).astype(float), np.frombuffer(batch.column(c + 1)[i].as_buffer(), np.uint64).reshape(-1, WORDS)) for c in (2, 4)]
                ok[i] = linked(*sides, bits, least)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    return run


def image_copies(images: DataFrame, bits: int = DIFFERENT_BITS, shared: int = SHARED, least: int = CONSENSUS, small: int = SMALL, bucket: int = BUCKET) -> DataFrame:
    """id, n_features, class_id (smallest id of the class) of every row of ``images`` (id, image).

    image is a binary PGM. What can't be read, null or empty has no features and is a class by its bytes. Byte-identical images are in one class.
    Of equal corner responses next to each other the upper, then left one is the corner. A large image has features in proportion to its area, and the work on
    a pair is in proportion to their product, a part of the matches at a time. Rows without an id are left out; repeated rows count once; an id with several
    images is in the class of each. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = images.sparkSession
    rows = only(images, "id", "image").where("id is not null").withColumn("same", F.md5(F.coalesce("image", F.lit("").cast("binary"))))
    ids = stash(rows.select("id", "same").distinct())
    first = rows.groupBy("same").agg(F.min_by("image", "id").alias("image"), F.min("id").alias("least"))
    # an image goes by a number of its bytes: an id may have several images
    first = first.select("same", "least", F.conv(F.substring("same", 2, 15), 16, 10).cast("long").alias("id"), "image")
    n = width(spark)
    found = stash(first.select("id", "image").repartition(4 * n, "id").mapInArrow(_describe, FEATURES))
    entries = found.select("id", "bits").mapInArrow(_entries, "key long, id long, n int, word long")
    met = stash(entries.repartition(2 * n, "key").sortWithinPartitions("key", "id").mapInArrow(_meet(small), MEETING))

    def judged(pairs: DataFrame) -> DataFrame:
        side = lambda c: found.select(F.col("id").alias(c), F.col("places").alias(f"places_{c}"), F.col("bits").alias(f"bits_{c}"))
        few = pairs.groupBy("a", "b").agg(F.size(F.collect_set("n1")).alias("n1"), F.size(F.collect_set("n2")).alias("n2"), F.max("kind").alias("kind")).where((F.least("n1", "n2") >= shared) | (F.col("kind") == 2))
        both = stash(few.select("a", "b")).join(side("a"), "a").join(side("b"), "b").select("a", "b", "places_a", "bits_a", "places_b", "bits_b")
        return stash(both.repartition(4 * n).mapInArrow(_judge(bits, least), "a long, b long"))

    links = judged(met.where("kind <> 1"))
    large = met.where("kind = 1").select(F.col("b").alias("key"), F.col("a").alias("id"), F.col("n1").alias("n"), "word")
    tree = stash(components(links).toDF("id", "root"))
    if not large.isEmpty():
        placed = stash(large.join(tree, "id", "left").select("key", "id", "n", "word", F.coalesce("root", "id").alias("root")))
        # a bucket within one class has no more to say
        mixed = placed.groupBy("key").agg(F.ceil(F.count("*") / F.lit(bucket)).cast("int").alias("blocks"), F.min("root").alias("one"), F.max("root").alias("other")).where("one < other").select("key", "blocks")
        mine = F.pmod(F.xxhash64("id", "n"), F.col("blocks")).cast("int")
        whole = found.select("id", "bits")
        placed = placed.join(mixed, "key").join(whole, "id").withColumn("descriptor", F.substring("bits", F.col("n") * F.lit(BITS // 8) + 1, F.lit(BITS // 8)))
        dealt = placed.select("key", "id", "n", "root", "blocks", "descriptor", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
        side = F.when(F.col("mine") == F.col("at"), 2).otherwise((F.col("mine") > F.col("at")).cast("int")).alias("side")
        dealt = dealt.select(F.xxhash64("key", F.least("mine", "at"), F.greatest("mine", "at")).alias("key"), "id", "n", "root", side, "descriptor")
        rest = dealt.repartition(2 * n, "key").sortWithinPartitions("key").mapInArrow(_between(bits), MEETING)
        tree = stash(components(links.union(judged(rest))).toDF("id", "root"))
    counts = found.select("id", "n_features")
    info = first.select("same", "least", "id").join(tree, "id", "left").join(counts, "id", "left")
    info = stash(info.select("same", "least", F.coalesce("root", "id").alias("root"), F.coalesce("n_features", F.lit(0)).alias("n_features")))
    classes = info.groupBy("root").agg(F.min("least").alias("class_id"))
    return ids.join(info.join(classes, "root"), "same").select("id", "n_features", "class_id")


_side = np.arange(72) / 72
_drawn: dict[int, np.ndarray] = {}


def _waves(n: int) -> np.ndarray:
    """The plane waves of vectors with ``n`` components."""
    if n not in _drawn:
        rng = np.random.default_rng(72)
        turn, phase = np.array([(rng.uniform(1.0, 9.0) * np.exp(2j * np.pi * rng.random()), 2 * np.pi * rng.random()) for _ in range(n)]).T
        _drawn.clear()
        _drawn[n] = np.cos(2 * np.pi * (turn.real[:, None, None] * _side[None, None, :] + turn.imag[:, None, None] * _side[None, :, None]) + phase.real[:, None, None]).reshape(n, -1)
    return _drawn[n]


@F.pandas_udf(BinaryType())
def rendered(vectors):
    """A vector as a gray PGM of 72 by 72: a sum of plane waves, one for each component. Near vectors give near images; none gives null."""

    def draw(v):
        if v is None or not len(v):
            return None
        x = np.nan_to_num(np.asarray(v, np.float64), posinf=0.0, neginf=0.0)
        image = x @ _waves(len(x))
        return write_pgm(128 + 45 * image.reshape(72, 72) / (image.std() or 1.0))

    return vectors.map(draw)


@F.pandas_udf(BinaryType())
def edited(images, kinds):
    """PGM images turned by a quarter (kind 0), with noise (1), turned by 20 degrees (2) or cropped to the middle four fifths of each side (3)."""

    def edit(data, kind):
        image = read_pgm(data)
        if image is None:
            return None
        h, w = image.shape
        if kind == 0:
            image = np.rot90(image)
        elif kind == 1:
            image = image + np.random.default_rng(zlib.crc32(data)).normal(0, 10, image.shape)
        elif kind == 2:
            y, x = np.mgrid[:h, :w] - np.array([h - 1, w - 1])[:, None, None] / 2
            c, s = np.cos(np.pi / 9), np.sin(np.pi / 9)
            u, v = (np.clip(t + (n - 1) / 2, 0, max(0.0, n - 1.001)) for t, n in ((c * x - s * y, w), (s * x + c * y, h)))
            x0, y0 = u.astype(int), v.astype(int)
            x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
            image = (image[y0, x0] * (1 - u + x0) + image[y0, x1] * (u - x0)) * (1 - v + y0) + (image[y1, x0] * (1 - u + x0) + image[y1, x1] * (u - x0)) * (v - y0)
        else:
            image = image[h // 10 : h - h // 10, w // 10 : w - w // 10]
        return write_pgm(image)

    return pd.Series([edit(data, kind) for data, kind in zip(images, kinds, strict=True)], dtype=object)
