import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import jaccard_join as jj


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def by_hand(rows):
    """(class, links) of each row, all pairs of different sets compared."""
    sets = sorted({shingles(t) for _, t in rows} - {frozenset()}, key=sorted)
    place = {s: i for i, s in enumerate(sets)}
    links, up = [0] * len(sets), list(range(len(sets)))

    def top(i):
        return i if up[i] == i else top(up[i])

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            up[max(top(a), top(b))] = min(top(a), top(b))
    ids = {}
    for d, t in rows:
        if shingles(t) and d is not None:
            g = top(place[shingles(t)])
            ids[g] = min(ids.get(g, d), d)
    return sorted(
        ((d, d, 0) if not shingles(t) else (d, ids.get(top(place[shingles(t)])), links[place[shingles(t)]]) for d, t in rows),
        key=repr,
    )


def found(docs):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in jj.classes(docs).collect()), key=repr)


def near_copies(seed, n_groups, n_copies, changes):
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(80)]
        for _ in range(n_copies):
            text = list(base)
            for _ in range(rng.randrange(changes + 1)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_against_all_pairs(spark, hard_rows):
    rows = [r[:2] for r in hard_rows] + [(100 + i, t) for i, t in near_copies(5, 12, 5, 3)]
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string")) == by_hand(rows)


def test_large_group_in_blocks_and_levels(spark, monkeypatch):
    """Small limits force deeper paths, blocks of nodes and blocks of exact comparisons."""
    rows = near_copies(7, 2, 60, 3)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jj, "BLOCK", 16)
    monkeypatch.setattr(jj.candidate_edges, "__defaults__", (8, jj.DEPTH))
    want, got = by_hand(rows), found(docs)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert sum(r[2] for r in got) >= 0.99 * sum(r[2] for r in want)


def test_recall_of_candidates(spark):
    rows = near_copies(11, 150, 2, 2)
    pairs = {(a, b) for (a, ta), (b, tb) in itertools.combinations(rows, 2) if a // 2 == b // 2
             and 5 * len(shingles(ta) & shingles(tb)) >= 4 * len(shingles(ta) | shingles(tb))}
    got = {d: c for d, c, _ in found(spark.createDataFrame(rows, "doc_id bigint, text string"))}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs) > 50


def test_one_row_of_each_class_stays(spark, small, clashing, empty):
    kept = jj.representatives(small)
    want = {c for _, c, _ in by_hand([(r.doc_id, r.text) for r in small.collect()])}
    assert kept.columns == small.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert jj.representatives(empty).count() == 0
    rows = jj.representatives(clashing)
    assert rows.columns == clashing.columns
    # 2 and 3 are near 1, 8 repeats; two texts of the id 9 differ
    assert sorted((r.doc_id for r in rows.collect()), key=repr) == sorted(
        [1, 4, 5, 6, 7, 8, 9, 9, 10, None, None], key=repr
    )


def test_wordless_rows_that_share_an_id_stay(spark):
    lone = [(None, "..."), (None, "!?"), (None, None), (None, ""), (5, "--"), (5, "++"), (5, "--")]
    rows = lone + [(6, "some words that repeat"), (6, "some words that repeat")]
    kept = jj.representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted(lone + rows[-1:], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    frame = spark.createDataFrame(edges, "a bigint, b bigint").select(
        *[F.lpad(F.hex(c), 4, "0").cast("binary").alias(c) for c in ("a", "b")]
    )
    got = {int(r.member.decode(), 16): int(r.root.decode(), 16) for r in jj.components(frame).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {150: 100, 200: 100}


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_runs_reach_the_recall(depth):
    assert (1 - 0.8**depth) ** jj.n_runs(depth=depth) <= 1 - jj.RECALL
