import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from folioscope.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def crcs(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(words[i : i + m]).encode()) for m in range(1, n + 1) for i in range(len(words) - m + 1)]


@pytest.mark.parametrize("chunk", [importance.CHUNK, 1, 9, 40])
@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_cancelled_prefixes_are_the_ngrams_checksums(monkeypatch, chunk, n):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    pick = random.Random(n)
    pieces = ["The", "a", "x9", "é", "日本", "-", "..", "longer" * 5, "\n"]
    for size in [0, 1, 2, *range(3, 60, 7)]:
        text = " ".join(pick.choice(pieces) for _ in range(size))
        got = [int(c) for _, part in importance.ngram_crcs(text.encode(), n) for c in part]
        assert sorted(got) == sorted(crcs(text, n))


def by_hand(docs, target, n, buckets, percent, min_words):
    source = Counter(c % buckets for _, t in docs for c in crcs(t, n))
    goal = Counter(c % buckets for t in target for c in crcs(t, n))
    s, t = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = crcs(text, n)
        weight = sum(gain[c % buckets] for c in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(crcs(text, 1)), len(f), weight, score))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0], r[2]))
    drawn = percent * len(able) // 100
    return [(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < min_words]


@pytest.mark.parametrize("frame,n,buckets,percent,min_words", [
    ("small", 1, 10_000, 10, 20), ("small", 2, 500, 35, 50), ("hard", 1, 10_000, 50, 2), ("clashing", 3, 7, 100, 0)])
def test_every_row(spark, request, frame, n, buckets, percent, min_words):
    docs = request.getfixturevalue(frame)
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = by_hand(rows, [r.text for r in target.collect()], n, buckets, percent, min_words)
    out = importance.resampled(docs, target, n=n, buckets=buckets, percent=percent, min_words=min_words)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_equal_rows_get_ranks_of_their_own(spark):
    docs = spark.createDataFrame([(None, "same words here")] * 30 + [(1, "other words there")] * 10, "doc_id int, text string")
    target = spark.createDataFrame([("words",)], "text string")
    ranks = [r["rank"] for r in importance.resampled(docs.repartition(5), target, percent=80, min_words=1).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 33)) and len(ranks) == 40


def test_drawn_documents_keep_their_columns(spark, small):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    out = importance.drawn_documents(small, target)
    drawn = importance.resampled(small, target).filter("rank is not null")
    assert out.columns == small.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in drawn.collect()}


def test_empty(spark, empty, small):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert importance.resampled(empty, target).count() == 0
    assert importance.resampled(small, target.limit(0)).count() == small.count()
