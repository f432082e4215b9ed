import re

import numpy as np

from folioscope.llm import decontamination as dc
from folioscope.llm.fm_index import FMIndex

ITEMS = "item_id bigint, text string"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(docs, items):
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            n = min(10, len(p))
            windows = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names.add("" if item is None else str(item))
        out.append((doc, len(w), sorted(hit), sorted(names)))
    return sorted(out, key=repr)


def found(docs, items, **options):
    rows = dc.find(docs, items, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.hit_words, r["items"]) for r in rows), key=repr)


def test_against_brute_force(spark, hard, hard_rows):
    long = " ".join(f"w{i}" for i in range(14))
    items = [(1, long), (2, "Red red RED"), (3, None), (4, "!?"), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (None, "word1 tail1"),
             (1, "another text of item one with more than ten words in it all"), (6, "a a a a a a a a a a a a")]
    docs = [r[:2] for r in hard_rows] + [
        (30, "x " + long + " y"), (31, long[:40] + " " + long), (32, "red, red. Red red"), (33, "red red"),
        (34, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (35, "a " * 500), (36, "A-a,a a a a a a a a"),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, ITEMS)
    want = by_hand(docs, items)
    assert found(frame, bench) == want
    # several blocks of items, several shards
    assert found(frame.repartition(3), bench, block_chars=60, shard_bytes=200) == want


def test_removal_keeps_the_rest(spark):
    phrase = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before É. {phrase}! After", 5), (2, "clean", 5), (3, None, 5)],
                                 "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in dc.cleaned(docs, spark.createDataFrame([(1, phrase)], ITEMS)).collect()}
    assert out == {1: ("Before É. ! After", 17), 2: ("clean", 5), 3: (None, 5)}


def test_empty_tables_and_clashes(spark, hard, clashing, empty):
    none = spark.createDataFrame([], ITEMS)
    assert dc.find(empty, none).count() == 0
    assert all(not r.hit_words for r in dc.find(hard, none).collect())
    assert found(clashing, none) == found(hard, none)


def test_index_counts_and_places(spark):
    rng = np.random.default_rng(3)
    for symbols in (2, 5, 40):
        text = rng.integers(0, symbols + 1, 400)
        text[0] = 0
        index = FMIndex(text, symbols)
        for _ in range(60):
            n = int(rng.integers(1, 9))
            p = rng.integers(1, symbols + 1, n)
            lo, hi = index.search(p[None, :], np.array([n]))
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want
