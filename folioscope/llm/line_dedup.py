"""Line deduplication: sorted line hashes, first occurrences, compressed keep bitmaps.

Lines become rows of (hash, id, position) and are range-partitioned by all
three, so a line in a third of all documents covers many partitions. One streaming pass over a sorted partition
finds the first document of each hash. Only the first hash of a partition can
have begun in an earlier one: the passes leave one summary row per partition,
and a second pass reads the resolved winner of that one hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    line = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    ascii_only = F.octet_length(line) == F.char_length(line)
    return F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _starts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hash halves and the ids of a sorted batch, and where a new hash begins."""
    h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
    ids = batch.column("id").to_numpy()
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return h1, h2, ids, new


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, first hash, last hash, first id of the last hash) of one sorted partition."""
    first = last = winner = part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, new = _starts(batch)
        part = batch.column("part")[0].as_py()
        if first is None:
            first = (int(h1[0]), int(h2[0]))
        at = np.flatnonzero(new)[-1]
        if at > 0 or last != (int(h1[0]), int(h2[0])):
            winner = int(ids[at])
        last = (int(h1[-1]), int(h2[-1]))
    if first is not None:
        yield pa.RecordBatch.from_pydict({
            "part": [part], "f1": [first[0]], "f2": [first[1]], "l1": [last[0]], "l2": [last[1]], "winner": [winner],
        }, schema=pa.schema([("part", pa.int32()), *[(c, pa.int64()) for c in ("f1", "f2", "l1", "l2", "winner")]]))


def _dropped(begun: dict[int, int]):
    """Rows whose id is not the first of their hash; ``begun``: id that won a partition's first hash before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, winner = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, ids, new = _starts(batch)
            wins = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
            head = (int(h1[0]), int(h2[0]))
            if last is None:
                winner = begun.get(batch.column("part")[0].as_py())
            elif last != head:
                winner = None
            if winner is not None:
                more = np.flatnonzero(new)
                wins[: more[1] if len(more) > 1 else len(wins)] = winner
            last, winner = (int(h1[-1]), int(h2[-1])), int(wins[-1])
            out = batch.filter(pa.array(ids != wins)).select(["doc_id", "row", "pos"])
            if out.num_rows:
                yield out

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, pos) of every line that goes; ``row`` is a hash of the text."""
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    ).select("doc_id", "row", "pos", line_key(F.col("line")).alias("k")).filter(F.length("k") >= min_chars)
    ordered = lines.select(
        "doc_id", "row", "pos",
        F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), F.col("k")).alias("h2"),
        # a document without an id is never the first
        F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("bigint").alias("id"),
    )
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "id", "row", "pos"]
    ordered = ordered.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("part", F.spark_partition_id()))
    # One row per partition: the bound is the number of partitions, not of lines.
    ends = ordered.mapInArrow(_summary, "part int, f1 bigint, f2 bigint, l1 bigint, l2 bigint, winner bigint").collect()
    begun, last, winner = {}, None, None
    for e in sorted(ends):
        if last == (e.f1, e.f2):
            begun[e.part] = winner
        if last != (e.l1, e.l2):
            winner = e.winner
        last = (e.l1, e.l2)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(_dropped(begun), f"doc_id {kind}, row bigint, pos int")


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions that go to a compressed bitmap of the lines that stay (a 0 bit goes)."""
    for batch in batches:
        maps = []
        for gone in batch.column("gone"):
            at = gone.values.to_numpy()
            bits = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)
            bits[at] = 0
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "row")), pa.array(maps, pa.binary())], ["doc_id", "row", "keep"]
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, keep) for documents that lose a line; all others keep every line.

    ``keep`` is a zlib-compressed bitmap, one bit per line up to the last line
    that goes. Null or empty texts are one empty line and lose nothing. Rows of
    one id are one document: none of them loses a line to another. Null ids come
    last, so they never are the first document. Of equal lines in one document
    all stay or all go. A long text is as many line hashes as lines. An empty
    table gives no rows.
    """
    gone = dropped_lines(docs, min_chars).groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return gone.mapInArrow(_bitmaps, f"doc_id {kind}, row bigint, keep binary")


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps as arrays of flags."""
    for batch in batches:
        flags = [
            np.unpackbits(np.frombuffer(zlib.decompress(m.as_py()), np.uint8), bitorder="little").astype(bool)
            for m in batch.column("keep")
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "row")), pa.array(flags, pa.list_(pa.bool_()))],
            ["_ld_id", "_ld_row", "_ld_flags"],
        )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with columns lines (array) and kept (array) after the bitmaps."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    flags = bitmaps.mapInArrow(_flags, f"_ld_id {kind}, _ld_row bigint, _ld_flags array<boolean>")
    met = docs.withColumn("_ld_text_row", F.xxhash64("text")).join(
        flags, F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_text_row") == F.col("_ld_row")), "left"
    )
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("_ld_flags").isNull(), lines).otherwise(
        F.filter(lines, lambda line, i: F.coalesce(F.get(F.col("_ld_flags"), i), F.lit(True)))
    )
    return met.withColumns({"_ld_lines": lines, "_ld_kept": kept}).select(
        *docs.columns, F.col("_ld_lines").alias("lines"), F.col("_ld_kept").alias("kept")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, rid, i AS pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, rid, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls
              FROM documents))),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k),
j AS (SELECT l.*, coalesce(f.first <> l.doc_id, false) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid
"""
