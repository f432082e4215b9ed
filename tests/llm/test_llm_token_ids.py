import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscope.llm import token_ids as ti
from folioscope.llm.shared import tuned

STRANGE = ["a  b\n\n c \t\nd  ", "it's 'll we’ve", "", None, "  ", "\n", "x\n y", "日本 <|endoftext|>", "<|endoftext|> a",
           "÷×é É1a2 ...!! ?", "a\x00b", "ab\u0301c \u00e9\n\n\n  \u00e9", "1234 56", "  x", " a", "!\n", "\u00a0x\u2003y"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(ti.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(small, library):
    texts = STRANGE + [r.text for r in small.select("text").collect()]
    ids, bounds = ti.Encoder(ti.tokenizer_path()).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [library(t) for t in texts]


def by_hand(rows, library):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library(text) + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("frame", ["hard", "small", "clashing"])
def test_files_read_back(spark, request, library, frame, monkeypatch):
    docs = request.getfixturevalue(frame)
    monkeypatch.setattr(ti.write_shards, "__defaults__", (1 << 16,))
    got = ti.encode_documents(spark, docs).orderBy("start").collect()
    assert [tuple(r) for r in got] == by_hand([(r.doc_id, r.text) for r in docs.collect()], library)


def test_keyed_access(spark, small, library, tmp_path):
    path = str(tmp_path / "ids")
    ti.write_shards(small, path, ti.tokenizer_path(), 50_257, shard_bytes=100_000)
    shards = [ti.Shard(p.read_bytes()) for p in sorted((tmp_path / "ids").glob("part-*"))]
    for r in small.orderBy("doc_id").limit(40).collect():
        own = [s.get(r.doc_id) for s in shards if s.get(r.doc_id) is not None]
        assert len(own) == 1 and own[0].tolist() == [*library(r.text), 2]
    assert all(s.get(10**9) is None and s.get(None) is None for s in shards)


def test_perfect_hash():
    h = ti.mixed(np.arange(5000).astype(np.uint64))
    slots = ti.PerfectHash.build(h).slot(h)
    assert sorted(slots.tolist()) == list(range(5000))


def test_empty(spark, empty):
    assert ti.encode_documents(spark, empty).count() == 0


def test_encoder_hands_each_text_to_the_library_once(monkeypatch):
    """Texts that go to the library whole are not split into pre-tokens too; words stay right while tables fill and are merged."""
    monkeypatch.setattr(ti, "LATE", 16, raising=False)
    monkeypatch.setattr(ti, "CACHE", 120)
    encoder = ti.Encoder(ti.tokenizer_path())
    plain = ["  ".join(f"word{i}x Über{i % 7}\n\t{i * 37}!" for i in range(k, k + 9)) for k in range(0, 90, 3)]
    texts = [t for pair in zip(plain, [f"{t} don't  世界" for t in plain], strict=True) for t in pair] + [None, ""]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    handed, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda some: handed.extend(some) or encode(some))
    for k in range(0, len(texts), 4):
        ids, bounds = encoder.encode(pa.array(texts[k : k + 4], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want[k : k + 4]
    assert sum("don" in x for x in handed) == len(plain)


def test_files_are_read_one_at_a_time(spark, tmp_path):
    """A task that reads several long files holds one of them, not a batch of all, and does not copy it."""
    rows = [(i, "".join(f" w{i}x{k}" for k in range(60_000))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    path = str(tmp_path / "ids")
    tuned(spark)
    ti.write_shards(docs, path, ti.tokenizer_path(), 50_257, shard_bytes=400_000)

    def batch_sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64())})

    files = spark.read.format("binaryFile").load(path).select("content").coalesce(1)
    sizes = files.mapInArrow(batch_sizes, "bytes long").collect()
    longest = max(p.stat().st_size for p in (tmp_path / "ids").glob("part-*"))
    assert sum(r.bytes for r in sizes) > (4 << 20) + 2 * longest
    assert max(r.bytes for r in sizes) < (4 << 20) + 2 * longest
    one = max((p.read_bytes() for p in (tmp_path / "ids").glob("part-*")), key=len)
    assert ti.Shard(one).content.obj is one
