"""Token ids in binary shards with a minimal perfect hash index.

Documents are range-partitioned by id; each partition is one file of 16- or
32-bit little-endian ids, written by Spark's own file committer, so a lost task
leaves nothing behind. The file ends with its index: a minimal perfect hash from
a key to a slot, and per slot a fingerprint, the offset and the length. The keys
in order follow it for full scans. A keyed read hashes the key, looks at one
slot, compares the fingerprint and reads one range of ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.shared import cut, new_path, table
from folioscope.llm.words import U64, buffers, mixed, prefix, ranges, release, slices

END_ID = 2
SHARD_BYTES = 16 << 20  # of text in one file
BLOCK_IDS = 1 << 20  # ids written as one record
CACHE = 1_000_000  # different pre-tokens a worker remembers
LATE = 1 << 16  # pre-tokens that wait to be merged into those
SEPARATOR = "\0\0\0\0"  # Spark's text writer ends a record with it; four bytes keep ids aligned
MAGIC = 0x58444954


# ---------------------------------------------------------------- encoding
_ALL = np.arange(256)
_SPACE = ((_ALL >= 9) & (_ALL <= 13)) | (_ALL == 32)
_KIND = np.where(_SPACE, 0, 3)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND = _KIND.astype(np.int8)
# Bytes that need the library's own pre-tokenizer: apostrophes (contractions), control
# characters, and lead bytes other than those of the letters U+00C0..U+024F.
_ODD = np.zeros(256, bool)
_ODD[[39, *range(0, 9), *range(14, 32), 127, 0xC2, *range(0xCA, 256)]] = True


class Encoder:
    """Ids of whole text columns by the tokenizers library.

    The byte-level model encodes each pre-token by itself. Pre-tokens are found
    on the bytes of all texts at once, the library encodes each different one
    once, and ids are put together by lookup. Texts with characters outside
    ASCII and Latin letters go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.line = self._encode(["\n"])[0][0]
        self._forget()

    def _forget(self) -> None:
        self.known = self.late = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin)."""
        raw, at = buffers(column)
        strange = _ODD[raw]
        strange[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # signs between the letters
        total = np.concatenate([[0], np.cumsum(strange)])
        odd = total[at[1:]] > total[at[:-1]]
        if not odd.any():
            return self._simple(raw, at)
        flat, bounds = self._simple(*buffers(column.filter(pa.array(~odd))))
        whole = iter(self._encode([column[int(i)].as_py() for i in np.flatnonzero(odd)]))
        simple = iter(np.split(flat, bounds[1:-1]))
        parts = [np.array(next(whole), np.uint32) if strange_one else next(simple) for strange_one in odd]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _simple(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        kind = _KIND[raw]
        border = np.zeros(n + 1, bool)
        border[at] = True
        new = border[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        word = kind > 0
        # A blank before a run belongs to it; of other white space the last stands alone.
        attach = np.zeros(n, bool)
        attach[1:] = new[1:] & word[1:] & (raw[:-1] == 32) & ~border[1:-1]
        start = new & ~attach
        last = np.zeros(n, bool)
        last[:-1] = ~word[:-1] & word[1:] & ~border[1:-1]
        start |= last
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        h = ranges(prefix(raw), begin, end)
        unique, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        at_id, length = (x[inverse] for x in self._places(unique, raw, begin[one], end[one]))
        total = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - at_id, length)]
        return flat, total[np.searchsorted(begin, at)]

    def _places(self, unique: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` each pre-token's begin and how many they are; unknown ones are encoded first.

        New pre-tokens go to a small sorted table, which is merged into the large
        one when it is full, so a slice does not sort or copy all that are known.
        """
        if len(self.known[0]) > CACHE:
            self._forget()
        at, length = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        missing = np.arange(len(unique))
        for known, known_at, known_length in (self.known, self.late):
            slot = np.searchsorted(known, unique[missing])
            there = np.zeros(len(missing), bool)
            inside = slot < len(known)
            there[inside] = known[slot[inside]] == unique[missing[inside]]
            found, slot = missing[there], slot[there]
            at[found], length[found] = known_at[slot], known_length[slot]
            missing = missing[~there]
        if len(missing):
            ids, first, n = self._pretokens(raw, begin[missing], end[missing])
            at[missing], length[missing] = first + len(self.ids), n
            self.ids = np.concatenate([self.ids, ids])
            self.late = self._merged(self.late, (unique[missing], at[missing], n.astype(np.int32)))
            if len(self.late[0]) > LATE:
                self.known, self.late = self._merged(self.known, self.late), tuple(x[:0] for x in self.late)
        return at, length

    @staticmethod
    def _merged(large: tuple[np.ndarray, ...], small: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Two tables sorted by their first column, without common rows, as one."""
        place = np.searchsorted(large[0], small[0])
        return tuple(np.insert(x, place, y) for x, y in zip(large, small, strict=True))

    def _pretokens(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each pre-token's begin, how many); those with a letter, digit or sign go to the library in long lines."""
        blank = _KIND[raw[end - 1]] == 0
        plain, spaces = np.flatnonzero(~blank), np.flatnonzero(blank)
        length, parts = np.zeros(len(begin), np.int64), []
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            size = end[part] - begin[part] + 1
            start = np.cumsum(size) - size
            lines = raw[np.repeat(begin[part] - 1 - start, size) + np.arange(size.sum())]
            lines[start] = 10
            ids = np.array(self._encode([lines.tobytes().decode()])[0], np.uint32)
            cuts = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(cuts) != len(part) + 1 or cuts[0] != 0:
                raise RuntimeError("pre-tokens and lines don't agree")
            length[part] = np.diff(cuts) - 1
            parts.append(ids[ids != self.line])
        for i, ids in zip(spaces, self._encode([raw[begin[i] : end[i]].tobytes().decode() for i in spaces]), strict=True):
            length[i] = len(ids)
            parts.append(np.array(ids, np.uint32))
        order = np.concatenate([plain, spaces])
        at = np.zeros(len(begin), np.int64)
        at[order] = np.cumsum(length[order]) - length[order]
        return np.concatenate(parts), at, length


# ---------------------------------------------------------------- index
def key_hashes(ids: np.ndarray, null: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Hash of (id, how often the id came before); a null id is a key of its own."""
    base = mixed(ids.astype(np.int64).view(U64) + U64(0x51ED270B)) ^ (null.astype(U64) * U64(0xA5A5A5A5DEADBEEF))
    return mixed(base + turn.astype(U64) * U64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Levels of bits: a key that is alone at its bit stops there; its slot is the bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            ones = np.concatenate([[0], np.cumsum(bits)])
            self.before.append(ones + total)
            total += int(ones[-1])

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(hashes + U64(level + 1)) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left):
            if len(levels) > 200:
                raise ValueError("two keys have one hash")
            size = 2 * len(left) + 1
            place = cls.place(left, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
        return cls(levels)

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for some of the keys that are not in the set."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, bits in enumerate(self.levels):
            place = self.place(hashes[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = self.before[level][place[hit]]
            left = left[~hit]
        return out


def index_bytes(ids: np.ndarray, null: np.ndarray, offset: np.ndarray, length: np.ndarray, width: int) -> bytes:
    """Index and footer of a file whose documents come in the given order."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    turn = np.arange(len(ids)) - first
    hashes = key_hashes(ids, null, turn)
    table_ = PerfectHash.build(hashes)
    slot = table_.slot(hashes)
    prints, at, n = np.zeros(len(ids), np.uint32), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    prints[slot], at[slot], n[slot] = (hashes >> U64(32)).astype(np.uint32), offset, length
    sizes = np.array([len(b) for b in table_.levels], np.int64)
    levels = b"".join(np.packbits(b).tobytes() for b in table_.levels)
    body = b"".join([
        sizes.tobytes(), at.tobytes(), n.tobytes(), ids.astype(np.int64).tobytes(), turn.astype(np.int64).tobytes(),
        prints.tobytes(), np.packbits(null).tobytes(), levels,
    ])
    body += b"\0" * (-len(body) % 4)
    footer = np.array([len(body) + 5 * 8, len(ids), len(sizes), width, MAGIC], np.int64)
    return body + footer.tobytes()


class Shard:
    """A file's content: ``get`` reads one document by key, ``keys`` lists all in order."""

    def __init__(self, content: bytes | pa.Buffer):
        self.content = content = memoryview(content)[: -len(SEPARATOR)]  # the file's bytes are not copied
        size, n, n_levels, self.width, magic = np.frombuffer(content[-40:], np.int64)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = len(content) - int(size)

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(content, kind, int(count), at)
            at += out.nbytes
            return out

        sizes = take(np.int64, n_levels)
        self.at, self.n, self.ids, self.turn = (take(np.int64, n) for _ in range(4))
        self.prints = take(np.uint32, n)
        self.null = np.unpackbits(take(np.uint8, -(-n // 8)))[:n].astype(bool)
        levels = [np.unpackbits(take(np.uint8, -(-s // 8)))[:s].astype(bool) for s in sizes]
        self.table = PerfectHash(levels)

    def find(self, ids: np.ndarray, null: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where the fingerprint says that a key is not here."""
        hashes = key_hashes(ids, null, turn)
        slot = self.table.slot(hashes)
        slot[(slot >= 0) & (self.prints[slot] != (hashes >> U64(32)).astype(np.uint32))] = -1
        return slot

    def tokens(self, slot: int) -> np.ndarray:
        kind = np.uint16 if self.width == 2 else np.uint32
        return np.frombuffer(self.content, kind, int(self.n[slot]), int(self.at[slot]))

    def get(self, doc_id: int | None, turn: int = 0) -> np.ndarray | None:
        slot = self.find(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([turn]))[0]
        return None if slot < 0 else self.tokens(slot)


# ---------------------------------------------------------------- files
_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder per worker, so that its table serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _records(path: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        kind = np.uint16 if width == 2 else np.uint32
        ids, nulls, lengths, offsets = [], [], [], []
        held, held_ids, at = [], 0, 0

        def record(payload: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"payload": pa.array([payload], pa.binary())})

        for batch in slices(batches, "text"):
            flat, bounds = encoder.encode(batch.column("text"))
            closed = np.insert(flat, bounds[1:], END_ID).astype(kind)
            n = np.diff(bounds) + 1
            keys = batch.column("doc_id")
            nulls.append(keys.is_null().to_numpy(zero_copy_only=False))
            ids.append(keys.fill_null(0).to_numpy())
            offsets.append(at + width * (held_ids + np.concatenate([[0], np.cumsum(n)[:-1]])))
            lengths.append(n)
            held.append(closed)
            held_ids += len(closed)
            if held_ids >= BLOCK_IDS:
                payload = np.concatenate(held).tobytes()
                payload += b"\0" * (-len(payload) % 4)
                yield record(payload)
                at += len(payload) + len(SEPARATOR)
                held, held_ids = [], 0
        if held:
            payload = np.concatenate(held).tobytes()
            yield record(payload + b"\0" * (-len(payload) % 4))
        if ids:
            yield record(index_bytes(*map(np.concatenate, (ids, nulls, offsets, lengths)), width))

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, shard_bytes: int = SHARD_BYTES) -> None:
    """Files of all documents in ascending order of doc_id (nulls first), one per id range.

    A null text has the end id alone. Rows of one id lie together, ordered by
    text; the n-th of them has the key (id, n). Other columns are not written.
    An empty table writes no shard. A text may be as long as its file; rows of one
    id lie in one file, which is read whole, so an id with over 2 GB of ids can't
    be read back.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    width = 2 if vocabulary <= 1 << 16 else 4
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(
        int(shards), "doc_id"
    ).sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(_records(tokenizer, width), "payload binary")
    rows.select(F.col("payload").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document of every file, found by its key."""
    for batch in batches:
        for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
            content = content.as_buffer()
            if not content or not content.size:
                continue
            shard = Shard(content)
            slot = shard.find(shard.ids, shard.null, shard.turn)
            if (slot < 0).any():
                raise ValueError("a key is missing from its index")
            n = shard.n[slot]
            crc = [zlib.crc32(shard.tokens(s).astype("<u4")) for s in slot]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), int(name.as_py())), pa.int64()), pa.array(shard.ids, mask=shard.null),
                pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64()),
            ], ["shard", "doc_id", "inner", "n_tokens", "ids_crc32"])
    release()


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.regexp_extract("path", r"part-(\d+)", 1).alias("path"), "content"
    )
    rows = cut(files.mapInArrow(_scan, "shard bigint, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint"))
    # Starts of shards: sums over groups of a thousand shards, then inside each group.
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.expr("shard div 1000"))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n"))
    earlier = lambda *by: F.coalesce(F.sum("n").over(
        W.partitionBy(*by).orderBy("shard" if by else "group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("group", earlier().alias("base"))
    starts = sizes.withColumn("inside", earlier("group")).join(groups, "group").select(
        F.col("shard"), (F.col("base") + F.col("inside")).alias("first")
    )
    return rows.join(starts, "shard").select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, vocabulary: int = 50_257) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    path = new_path(spark, "token-ids")
    write_shards(docs, path, tokenizer or tokenizer_path(), vocabulary)
    return read_shards(spark, path)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark, table(spark, sf_dir, "documents"))
