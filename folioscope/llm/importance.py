"""Importance resampling towards a target: n-gram buckets by prefix checksums, Gumbel top-k.

A document is normalised to its words joined by one separator and scanned once,
storing the running CRC after each word. With ``crc(AB) = shift(crc(A), |B|) ^
crc(B)`` the checksum of any n-gram is that of the prefix ending with it, with
the shifted checksum of the prefix before it cancelled. The shift by a number
of bytes is linear over GF(2): a product of operators for powers of two, applied
to all n-grams of a chunk at once.

A document's features are kept as counts of at most ``buckets`` buckets. Bucket
gains compare the two corpora; a document's weight is the sum of its gains; with
Gumbel noise of a hash of its id the highest scores are a weighted draw without
replacement.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.shared import stored, table
from folioscope.llm.words import LETTER_DIGIT, LOWER, release, slices

N = 1
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
CHUNK = 1 << 20  # bytes of a text that are scanned at once
_TABLE = bytes(LOWER[i] if LETTER_DIGIT[i] else 0x20 for i in range(256))
_SPACE = 0x20
_U32 = np.uint32
_ONES = _U32(0xFFFFFFFF)


# ---------------------------------------------------------------- checksums
@lru_cache(maxsize=1)
def _byte_step() -> np.ndarray:
    """The CRC register after one zero byte, by its low byte."""
    c = np.arange(256, dtype=_U32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ _U32(0xEDB88320), c >> 1)
    return c


def _through(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24])


@lru_cache(maxsize=64)
def _shift_tables(k: int) -> np.ndarray:
    """The operator that shifts a checksum by 2**k bytes, by each byte of the checksum."""
    if k == 0:
        part = np.arange(256, dtype=_U32)
        step = _byte_step()
        return np.stack([step[c & 255] ^ (c >> 8) for c in (part << _U32(s) for s in (0, 8, 16, 24))])
    half = _shift_tables(k - 1)
    return np.stack([_through(half, row) for row in half])


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Checksums moved ``n_bytes`` further from the end."""
    out, left, k = crc.astype(_U32), n_bytes.astype(np.int64), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _through(_shift_tables(k), out[odd])
        left, k = left >> 1, k + 1
    return out


def _spaced(crc: np.ndarray) -> np.ndarray:
    """Checksums after one more separator."""
    register = crc ^ _ONES
    return (_byte_step()[(register ^ _U32(_SPACE)) & 255] ^ (register >> 8)) ^ _ONES


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, chunk by chunk; a chunk ends at a separator."""
    first = 0
    while first < len(text):
        size = CHUNK
        while True:
            part = text[first : first + size].translate(_TABLE)
            if first + size >= len(text):
                break
            end = part.rfind(b" ") + 1
            if end:
                part = part[:end]
                break
            size *= 2
        first += len(part)
        words = part.split()
        if words:
            yield words


def ngram_crcs(text: bytes, n: int = N) -> Iterator[tuple[int, np.ndarray]]:
    """(words of a chunk, CRCs of all runs of 1 to ``n`` words ending in it) of one text."""
    running = 0
    before = np.zeros(0, _U32)  # checksums of the prefixes before the last words
    width = np.zeros(0, np.int64)  # and their bytes to the end of the chunk before
    for words in _parts(text):
        after = np.fromiter(accumulate(words, lambda c, w: zlib.crc32(w, zlib.crc32(b" ", c)), initial=running), _U32, len(words) + 1)
        running = int(after[-1])
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.concatenate([before, _spaced(after[:-1])])
        end = np.cumsum(length)
        # Bytes from the first word's separator; words of the chunk before lie left of 0.
        begin = np.concatenate([-width, end - length + 1])
        old = len(before)
        found = []
        for k in range(n):
            first = old - k  # the run of k + 1 words that ends with the chunk's first word
            skip = max(0, -first)
            last = max(0, first + len(words))
            s, b = start[first + skip : last], begin[first + skip : last]
            found.append(after[1 + skip :] ^ shifted(s, end[skip:] - b))
        yield len(words), np.concatenate(found)
        keep = max(len(start) - (n - 1), 0)
        before, width = start[keep:], end[-1] - begin[keep:]


def bucket_counts(text: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words of a text and the counts of its features by bucket."""
    words, total = 0, np.zeros(buckets, np.int64)
    for count, crcs in ngram_crcs(text, n):
        words += count
        total += np.bincount((crcs % _U32(buckets)).astype(np.int64), minlength=buckets)
    return words, total


# ---------------------------------------------------------------- the operator
FEATURES = "n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"


def features(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, buckets and counts of each row, and a tie-breaker ``row``.

    ``row`` is new at each computation, so the frame is to be stored before it is sorted.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = uuid.uuid4().hex, 0
        for batch in slices(batches, "text"):
            ids, counts, ends, sizes = [], [], [0], []
            for text in pc.fill_null(batch.column("text"), "").cast(pa.large_binary()):
                words, total = bucket_counts(text.as_py(), n, buckets)
                held = np.flatnonzero(total)
                ids.append(held)
                counts.append(total[held])
                ends.append(ends[-1] + len(held))
                sizes.append((words, int(total.sum())))
            offsets = pa.array(ends, pa.int32())
            names = pa.array([f"{task}-{seen + i:012d}" for i in range(batch.num_rows)])
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([w for w, _ in sizes], pa.int64()), pa.array([f for _, f in sizes], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(counts))), names,
            ], ["doc_id", "n_words", "n_features", "buckets", "counts", "row"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, {FEATURES}, row string")


def bucket_totals(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows; a task passes on one row for each bucket it saw."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    part = rows.select("buckets", "counts").mapInArrow(summed, "bucket int, n bigint")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: how much likelier it is in the target, in thousandths of a nat."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(
        target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    whole = W.partitionBy()  # over the buckets, a parameter's number of rows
    both = both.withColumns({"ss": F.sum("s").over(whole), "tt": F.sum("t").over(whole)})
    ratio = F.expr(f"((t + 1D) * (ss + {buckets}D)) / ((s + 1D) * (tt + {buckets}D))")
    return both.select("bucket", F.floor(1000.0 * F.log(ratio)).cast("bigint").alias("gain"))


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` with ``weight`` in place of its bucket counts; ``gain`` has one number a bucket."""
    kept = [c for c in rows.columns if c not in ("buckets", "counts")]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = gain[batch.column("buckets").flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("buckets")).to_numpy())])
            total = np.concatenate([[0], np.cumsum(value)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())], [*kept, "weight"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(weighed, f"{schema}, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths: a null id has the noise of the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def ranked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3... by falling score for the drawn share, null below it.

    The rows are sorted by ranges and stored; a row's rank is its place in its
    range plus the rows of the ranges before, so no task sees more than a range.
    ``row`` splits ranges even among equal scores and ids.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("row")]
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "importance-sorted")
    placed = placed.withColumn("range", F.shiftright("place", 33))
    ranges = placed.groupBy("range").agg(F.count("*").alias("size"))
    # One row a range, so one for each shuffle partition at most.
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        "range", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"),
        F.expr(f"({percent} * sum(size) over ()) div 100").alias("drawn"),
    )
    place = F.col("place") - F.shiftleft(F.col("range"), 33) + F.col("base") + 1
    met = placed.join(F.broadcast(ranges), "range")
    return met.withColumn("rank", F.when(place <= F.col("drawn"), place)).select(*rows.columns, "rank")


def _learned(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """Stored features of ``docs`` and the gain of every bucket."""
    rows = stored(features(docs, n, buckets), "importance-features")
    ids = target.select(F.lit(0).alias("doc_id"), "text")
    learned = gains(bucket_totals(rows, buckets), bucket_totals(features(ids, n, buckets), buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for bucket, value in learned.collect():
        gain[bucket] = value
    return rows, gain


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT,
              min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    ``rank`` numbers the drawn documents from 1; documents of fewer than
    ``min_words`` words are scored but never drawn. Null and empty texts have no
    features and weight 0. Equal scores go to the smaller id (null last), then to
    fewer features; rows still equal are interchangeable, each with a rank of its
    own. A long text is scanned chunk by chunk, and a document's counts hold
    ``buckets`` entries at most. An empty table gives no rows, an empty target
    gains from counts of 0; other columns are ignored.
    """
    rows, gain = _learned(docs, target, n, buckets)
    scored = weights(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    long = ranked(scored.filter(F.col("n_words") >= min_words), percent)
    short = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint"))
    return long.unionByName(short).drop("row")


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose ids were drawn, with their columns.

    Ids should be unique: of rows that share a drawn id all stay. A drawn null id
    meets the rows with a null id.
    """
    ids = resampled(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 in SQL: the byte table by its rule, then one step a byte of every different word.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (
  SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark),
w AS (
  SELECT side, r, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM d),
u AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM w),
crc AS (
  SELECT word, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, len(h), 2), lambda x: ('0x' || h[x:x+1])::BIGINT)),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM u, steps),
f AS (SELECT side, r, bucket, count(*) AS n FROM w JOIN crc USING (word) GROUP BY ALL),
s AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
a AS (SELECT range AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t
      FROM range(10000) LEFT JOIN s ON s.bucket = range),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
  FROM a),
x AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN g USING (bucket) WHERE side = 'd' GROUP BY r),
y AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         ('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT AS h
  FROM d LEFT JOIN x USING (r) WHERE side = 'd'),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM y),
o AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn
  FROM z)
SELECT doc_id, n_features, weight, score,
       CAST(CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS BIGINT) AS rank
FROM o
"""
