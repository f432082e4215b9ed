import re
from collections import defaultdict

import pytest

from folioscope.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_filling(sizes):
    """Reshare the excess again and again until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= 2 * sizes[s]}
        if not full:
            out |= {s: weight[s] * share for s in open_}
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("frame", ["hard", "small", "clashing"])
def test_takes_reach_targets(request, frame):
    docs = request.getfixturevalue(frame)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    want = targets_by_filling(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=1)


def test_reruns_agree(small):
    assert sorted(mixing.mix(small).collect()) == sorted(mixing.mix(small).collect())


def test_documents_hold_the_words_taken(spark, small, hard):
    for docs in (small, hard):
        out = mixing.mixed_documents(docs)
        assert out.columns == docs.columns
        got, want = defaultdict(int), defaultdict(int)
        for r in out.collect():
            got[r.doc_id] += words(r.text)
            assert r.n_chars == len(r.text)
        for r in mixing.mix(docs).collect():
            want[r.doc_id] += r.taken
        # Rows of one id (null among them) share what the mix takes from them.
        assert {k: v for k, v in want.items() if v} == dict(got)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_take_their_own_shares(spark, doc_id):
    """Equal rows under a cut that falls inside one of them."""
    rows = [(doc_id, "one two three four", "s")] * 38 + [(doc_id, "five six", "s"), (doc_id, None, "s"), (1, "x " * 400, "t")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(3)
    out = mixing.mixed_documents(docs, weights=(3, 7)).collect()
    targets = targets_by_filling_of(mixing.mix(docs, weights=(3, 7)))
    for source, target in targets.items():
        assert sum(words(r.text) for r in out if r.source == source) == int(target)


def targets_by_filling_of(plan):
    return {r.source: r.target for r in plan.collect()}


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
