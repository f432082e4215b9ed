"""Benchmark decontamination with an FM-index per training shard.

The benchmark is the query set. It is taken in blocks of bounded size; a block
is sent to all tasks, and all blocks pass over the documents one after the other
inside one stage, without a shuffle. A shard is a run of documents of bounded
size inside a task. An occurrence of a window holds only words of the benchmark,
so the shard's index covers the runs of such words that are at least as long as
the shortest window; all other words separate runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.fm_index import FMIndex
from folioscope.llm.shared import table
from folioscope.llm.words import LETTER_DIGIT, LOWER, Words, slices

WINDOW = 10
# Characters of benchmark text sent to the tasks at once.
BLOCK_CHARS = 8_000_000
# Bytes of document text in one index.
SHARD_BYTES = 1 << 20
TEXT_FIELD = "`_dc_text` string"


class Phrases:
    """All different windows of one block of items, as rows of word numbers."""

    def __init__(self, items: pa.Table, window: int = WINDOW):
        words = Words(items.column("text").combine_chunks(), LETTER_DIGIT, LOWER)
        hashes = words.hashes()
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        number = number + 1
        first, _ = words.windows(hashes, window)
        long = np.zeros((len(first), window), np.int64)
        for k in range(window):
            long[:, k] = number[first + k]
        short_docs = np.flatnonzero((words.n_words > 0) & (words.n_words < window))
        short = np.zeros((len(short_docs), window), np.int64)
        for row, doc in enumerate(short_docs):
            n = words.n_words[doc]
            short[row, window - n :] = number[words.first[doc] : words.first[doc + 1]]
        rows = np.concatenate([long, short])
        owner = np.concatenate([words.doc[first], short_docs]).astype(np.int64)
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.lengths = (self.rows > 0).sum(axis=1)
        # Items by window: the owners of window w are owners[bounds[w]:bounds[w + 1]].
        pairs = np.unique(np.stack([which, owner], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.owners = pairs[:, 1]
        self.bounds = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.names = ["" if x is None else str(x) for x in items.column("item_id").to_pylist()]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] numbers for each i, behind each other."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(total[-1]) - np.repeat(total[:-1] - starts, counts)


def hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(hit per word, pairs of document and item) of one shard."""
    hit = np.zeros(len(words.start), bool)
    none = hit, np.zeros((0, 2), np.int64)
    if not len(phrases.rows) or not len(words.start):
        return none
    hashes = words.hashes()
    slot = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    number = np.where(phrases.vocabulary[slot] == hashes, slot + 1, 0)
    # Runs of known words inside a document, long enough for the shortest window.
    n = len(number)
    known = number > 0
    begin = known.copy()
    begin[1:] &= ~(known[:-1] & (words.doc[1:] == words.doc[:-1]))
    starts = np.flatnonzero(begin)
    end = known.copy()
    end[:-1] &= ~(known[1:] & (words.doc[1:] == words.doc[:-1]))
    lengths = np.flatnonzero(end) + 1 - starts
    long = lengths >= phrases.lengths.min()
    starts, lengths = starts[long], lengths[long]
    if not len(starts):
        return none
    # The sequence: a separator, then a run, for every run; word_at leads back.
    at = _spread(starts - 1, lengths + 1)
    separators = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = number[np.maximum(at, 0)]
    text[separators] = 0
    index = FMIndex(text, len(phrases.vocabulary))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none
    counts = (hi - lo)[found]
    window = np.repeat(found, counts)
    word = at[index.locate(_spread(lo[found], counts))]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + phrases.lengths[window], -1)
    hit = np.cumsum(cover)[:-1] > 0
    pairs = np.unique(words.doc[word] * len(phrases.rows) + window)
    doc, window = pairs // len(phrases.rows), pairs % len(phrases.rows)
    owned = np.diff(phrases.bounds)[window]
    pairs = np.stack([np.repeat(doc, owned), phrases.owners[_spread(phrases.bounds[window], owned)]], axis=1)
    return hit, np.unique(pairs, axis=0)


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to about ``size`` bytes of text."""
    held, held_bytes = [], 0
    for batch in slices(batches, "_dc_text", size):
        held.append(batch)
        held_bytes += pc.sum(pc.binary_length(batch.column("_dc_text"))).as_py() or 0
        if held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, held_bytes = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _find(block, shard_bytes: int, first: bool, last: bool, with_text: bool, remove: bool):
    """Adds a block's spans and items to each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value
        for batch in _shards(batches, shard_bytes):
            words = Words(batch.column("_dc_text"), LETTER_DIGIT, LOWER)
            hit, pairs = hits(words, phrases)
            spans = [[] for _ in range(batch.num_rows)] if first else batch.column("_dc_hits").to_pylist()
            items = [[] for _ in range(batch.num_rows)] if first else batch.column("_dc_items").to_pylist()
            for w in np.flatnonzero(hit):
                spans[words.doc[w]].append(int(w - words.first[words.doc[w]]))
            for doc, item in pairs:
                items[doc].append(phrases.names[item])
            out = {"_dc_hits", "_dc_items"} | ({"_dc_text"} if last and not with_text else set())
            keep = [c for c in batch.schema.names if c not in out]
            columns = {c: batch.column(c) for c in keep}
            columns["_dc_hits"] = pa.array([sorted(set(x)) for x in spans], pa.list_(pa.int64()))
            columns["_dc_items"] = pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))
            if last:
                columns["_dc_n"] = pa.array(words.n_words, pa.int64())
                cuts = [_merged(words, d, x) for d, x in enumerate(columns["_dc_hits"].to_pylist())]
                columns["_dc_spans"] = pa.array(cuts, pa.list_(pa.list_(pa.int64())))
                if remove:
                    columns["_dc_text"] = _removed(batch.column("_dc_text"), cuts)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _merged(words: Words, doc: int, hit: list[int]) -> list[list[int]]:
    """Byte spans of neighbouring hit words, merged, blanks between them included."""
    if not hit:
        return []
    hit = np.array(hit)
    new = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
    first, last = hit[new], hit[np.concatenate([new[1:], [True]])]
    base, at = words.first[doc], words.at[doc]
    return np.stack([words.start[base + first] - at, words.end[base + last] - at], axis=1).tolist()


def blocks(benchmark: DataFrame, size: int = BLOCK_CHARS) -> Iterator[pa.Table]:
    """Items in blocks of about ``size`` characters: the stated query set, part by part."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // size) or 1
    for k in range(n):
        yield items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow()


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
         shard_bytes: int = SHARD_BYTES, with_text: bool = True, remove: bool = False) -> DataFrame:
    """``docs``, with or without their text, with n_words, hit_words (word numbers), items and spans (bytes to remove).

    With ``remove`` the spans are cut out of the text. Words are runs of letters,
    digits and non-ASCII characters after A-Z is lower-cased. Null or empty texts
    have no words, no hits and no items; a long text is a shard of its own, read
    whole. Windows that overlap are one span, so no order of equals matters.
    Items without words never occur; an item without an id is named by an empty
    string, and items of equal names count once. Repeated documents each get
    their row. Empty tables give no rows or no hits. Columns of ``docs`` stay;
    those of the four names above are replaced.
    """
    spark = docs.sparkSession
    own = ["n_words", "hit_words", "items", "spans"]
    kept = [c for c in docs.columns if c not in own and c != "text"]
    out = docs.select(*kept, F.col("text").alias("_dc_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema]
    parts = list(blocks(benchmark, block_chars))
    for k, part in enumerate(parts):
        block = spark.sparkContext.broadcast(Phrases(part, window))
        last = k == len(parts) - 1
        kinds = [x for x in fields if with_text or not last or x != TEXT_FIELD]
        kinds += ["_dc_hits array<bigint>", "_dc_items array<string>"]
        kinds += ["_dc_n bigint", "_dc_spans array<array<bigint>>"] if last else []
        out = out.mapInArrow(_find(block, shard_bytes, k == 0, last, with_text, remove), ", ".join(kinds))
    given = [c for c in docs.columns if c in kept or (c == "text" and with_text)]
    return out.select(
        *[F.col("_dc_text").alias(c) if c == "text" else F.col(c) for c in given],
        F.col("_dc_n").alias("n_words"), F.col("_dc_hits").alias("hit_words"),
        F.col("_dc_items").alias("items"), F.col("_dc_spans").alias("spans"),
    )


def _removed(texts: pa.Array, spans: list[list[list[int]]]) -> pa.Array:
    """Texts without their spans."""
    out = texts.to_pylist()
    for i, cuts in enumerate(spans):
        if cuts:
            raw, kept, at = out[i].encode(), [], 0
            for a, b in cuts:
                kept.append(raw[at:a])
                at = b
            out[i] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(out, pa.string())


def cleaned(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the spans found; ``n_chars``, where present, follows the text."""
    # Columns may bear the names find() adds, so they travel under others.
    given = [c for c in docs.columns if c != "text"]
    plain = docs.select("text", *[F.col(c).alias(f"_dc_{i}") for i, c in enumerate(given)])
    out = find(plain, benchmark, remove=True, **options).select(
        *["text" if c == "text" else F.col(f"_dc_{given.index(c)}").alias(c) for c in docs.columns]
    )
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM iw WHERE len(w) > 0)),
grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win))),
occ AS (SELECT rid, i, win.n, item_id FROM grams JOIN win ON grams.gram = win.gram AND grams.n = win.n),
hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM occ) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT rid, coalesce(CAST(item_id AS VARCHAR), '') AS name FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
