import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from folioscope.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda texts: [len(ids) for ids in model.encode([t or "" for t in texts])]


@pytest.fixture(scope="module")
def merger():
    return token_counts.Merger(PATH)


ODD = [
    "", None, " ", "a", "  a  b ", "\t\n x", "ﬁ ①", "</s><s> <unk>", "日本語\x00a", "<0x0A>", "a" * 3000, " " * 1000,
    " " * 300 + "the", "ab" * 2000, "▁▁▁ the▁the", "naïve café", "😀😀 👩‍👩‍👧", "﻿x", "é",
]
ALPHABETS = ["theinaro  ", "abcdefghijklmnopqrstuvwxyzABC0123456789   \n\t.,;:-_(){}<>/éüßñ日本語😀▁"]


def drawn(seed, n, longest):
    pick = random.Random(seed)
    return ["".join(pick.choice(pick.choice(ALPHABETS)) for _ in range(pick.randrange(longest))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [token_counts.CHUNK, 40])
def test_counts_are_the_library_s(merger, library, monkeypatch, chunk):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    texts = ODD + drawn(1, 800, 80) + drawn(2, 10, 3000)
    assert merger.counts(pa.array(texts)).tolist() == library(texts)


@pytest.mark.parametrize("long", [2, 10_000])
def test_queue_and_arrays_agree(merger, library, monkeypatch, long):
    monkeypatch.setattr(token_counts, "LONG", long)
    texts = drawn(3, 200, 60) + ["theinaro" * 40, "=" * 500]
    assert merger.counts(pa.array(texts)).tolist() == library(texts)


def test_equal_hashes_do_not_merge_pre_tokens(merger, library, monkeypatch):
    monkeypatch.setattr(token_counts, "ranges", lambda h, start, end: start * 0)
    texts = drawn(4, 50, 60)
    assert merger.counts(pa.array(texts)).tolist() == library(texts)


@pytest.mark.parametrize("frame", ["hard", "small", "clashing"])
def test_every_row(request, library, frame):
    docs = request.getfixturevalue(frame)
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, len((r.text or "").encode()), n, n > 4096) for r, n in zip(rows, library([r.text for r in rows]))]
    got = [tuple(r) for r in token_counts.token_counts(docs, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty(empty):
    assert token_counts.token_counts(empty, PATH).count() == 0
