import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


@pytest.mark.parametrize("frame", ["hard", "small", "clashing"])
def test_base_counts(request, model, frame):
    docs = request.getfixturevalue(frame)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = Counter((r.doc_id, *(r[n] for n in names)) for r in quality.score(docs, model).collect())
    assert got == Counter((r.doc_id, *by_hand(r.text)) for r in docs.collect())


def test_verdict_on_rows_not_trained_on(spark, model):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = quality.score(docs.filter(fold), model).join(labels, "doc_id").filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows) > 0


def test_same_model_again_and_no_labels(spark, small, empty, model):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    plain = quality.train(small, labels)
    assert all(r.kept != r.base_failed for r in quality.score(small, plain).collect())
    assert quality.score(empty, model).count() == 0
