import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from folioscope.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def by_hand(rows, min_docs, top):
    """The rule term by term, over every kept term of every group."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []

    def f(p, q):
        return floor(Fraction((p - q) ** 2, p + q))

    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 2), total + 2 * len(kept))) for t in kept}

        ps, q = {s: p(counts[lang, s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, f(ps[s][t], q[t])) for t in kept if counts[lang, s][t] and ps[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("frame,min_docs", [("small", 10), ("small", 1), ("hard", 1), ("hard", 2), ("clashing", 2), ("hard", 10)])
def test_every_row(request, frame, min_docs):
    docs = request.getfixturevalue(frame)
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    got = divergence.divergence(docs, min_docs=min_docs, top=4)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"),
                          ("value", "bigint"), ("rank", "int")]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, min_docs, 4)


def test_entries_pass_on_early(small, monkeypatch):
    want = sorted(tuple(r) for r in divergence.divergence(small).collect())
    monkeypatch.setattr(divergence, "HELD", 10)
    assert sorted(tuple(r) for r in divergence.divergence(small.repartition(7)).collect()) == want


@pytest.mark.parametrize("part", [1, 5, 64])
def test_long_texts_split_between_terms(monkeypatch, part):
    text = ("Some words, é日本 and-others\n" * 30 + "x" * 100).encode()
    want = Counter(t.encode() for t in TERM.findall(text.decode().translate(LOWER)))
    monkeypatch.setattr(divergence, "PART", part)
    assert divergence.document_terms(text) == want


def test_probability_is_exact(spark):
    n, total, terms = 2_999_999_999_999_999_999, 8_999_999_999_999_999_999, 3
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in (("n", n), ("total", total), ("terms", terms))])
    assert row.select(divergence.probability("n", "total", "terms")).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_empty(empty):
    assert divergence.divergence(empty).count() == 0
