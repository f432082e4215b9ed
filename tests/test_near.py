import random
import re

from pyspark.sql import functions as F

from folioscope.functions.graph import components, follow
from folioscope.functions.runs import signed
from folioscope.operators import near


def by_hand(nodes, linked):
    """Smallest member of each node's group under the links."""
    top = {n: n for n in nodes}
    while True:
        before = dict(top)
        for a in nodes:
            for b in nodes:
                if linked(a, b):
                    top[a] = top[b] = min(top[a], top[b])
        if top == before:
            return top


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(5, 5)]
    edges += [(300, 301 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    both = set(edges) | {(b, a) for a, b in edges}
    assert got == by_hand(nodes, lambda a, b: (a, b) in both)


def test_follow_long_chain(spark):
    chain = [(i, max(0, i - 1)) for i in range(100)] + [(500, 50), (501, 50)]
    assert {r.to for r in follow(spark.createDataFrame(chain, "node int, to int")).collect()} == {0}


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_near_texts_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(8):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(12, 60))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", "?!", "one", "One.", "one two"]
    rows = [(i, "g" + str(i % 2) if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, g string, text string")
    for n in (1, 5):
        out = near.near_texts(df, ["g"], "text", "id", words=n).collect()
        sets = {i: (g, runs(t, n)) for i, g, t in rows}

        def linked(a, b):
            (g, x), (h, y) = sets[a], sets[b]
            return g == h and x and y and 5 * len(x & y) >= 4 * len(x | y)

        want = by_hand(list(sets), linked)
        assert {r.id: r.class_id for r in out} == want
        for r in out:
            members = {frozenset(sets[i][1]) for i in want if want[i] == r.class_id and sets[i][0] == sets[r.id][0]}
            assert r.n_forms == len(members)


def test_a_large_group_of_near_copies_is_one_class(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [(i, "g", " ".join([*base[: i % 60], f"new{i}", *base[i % 60 + 1 :]])) for i in range(400)]
    out = near.near_texts(spark.createDataFrame(texts, "id int, g string, t string"), ["g"], "t", "id", words=1).collect()
    assert {r.class_id for r in out} == {0} and {r.n_forms for r in out} == {400}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_near_spellings_equal_brute_force(spark):
    rng = random.Random(3)
    labels = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(80)]
    labels += ["Étude", "etude", "ab-cd", "ab cd", "", None, "...", "x" * 200, "x" * 199 + "y"]
    rows = [(i, i % 3, t) for i, t in enumerate(labels)]
    out = near.near_spellings(spark.createDataFrame(rows, "id int, g int, t string"), ["g"], "t", "id").collect()
    key = {i: (g, " ".join(words(t))) for i, g, t in rows}
    want = by_hand(list(key), lambda a, b: key[a][0] == key[b][0] and key[a][1] and key[b][1] and distance(key[a][1], key[b][1]) <= 1)
    assert {r.id: r.class_id for r in out} == want


def test_empty(spark):
    none = spark.createDataFrame([], "id int, g int, t string")
    assert near.near_texts(none, ["g"], "t", "id").count() == 0
    assert near.near_spellings(none, ["g"], "t", "id").count() == 0


def test_digests_and_bands_equal_sparks_own_expressions(spark):
    """Sets are signed in one pass over Arrow batches; the values are those of the plain expressions."""
    rng = random.Random(4)
    some = [[rng.randrange(-(2**63), 2**63) for _ in range(n)] for n in (0, 1, 2, 7, 300, 0, 90_000)]
    some += [[5, -5, 0], [], [2**63 - 1, -(2**63)]]
    sets = spark.createDataFrame([(i, "é" if i % 2 else None, x) for i, x in enumerate(some)], "id int, g string, items array<bigint>")
    head = F.concat(F.to_json(F.struct("g")), F.lit(","))
    got = {r.id: (r.digest, r.bands) for r in sets.select("id", signed(head, F.col("items"), 5, 18).alias("s")).select("id", "s.*").collect()}
    hashed = sets.select("id", F.explode("items").alias("x"))
    halves = [e for i in range(45) for e in (f"cast(xxhash64(x, {i}) & 2147483647 as int)", f"cast(shiftrightunsigned(xxhash64(x, {i}), 33) as int)")]
    minima = hashed.groupBy("id").agg(*[F.min(F.expr(h)).alias(f"m{i}") for i, h in enumerate(halves)])
    bands = minima.select("id", F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{5 * b + r}") for r in range(5)]) for b in range(18)]).alias("bands"))
    digest = F.sha2(F.concat_ws(",", F.to_json(F.struct("g")), F.array_join(F.array_sort("items"), ",")), 256)
    want = sets.join(bands, "id", "left").select("id", F.when(F.size("items") > 0, digest).alias("digest"), F.coalesce("bands", F.array().cast("array<bigint>")).alias("bands"))
    assert got == {r.id: (r.digest, r.bands) for r in want.collect()}


def test_near_texts_miss_no_link_at_the_threshold(spark):
    """4,000 pairs of texts that share exactly four fifths of their words; bands alone miss a few."""
    pairs = [(2 * i + j, "g", " ".join([*(f"w{i}x{k}" for k in range(8)), f"own{i}x{j}"])) for i in range(4000) for j in (0, 1)]
    out = near.near_texts(spark.createDataFrame(pairs, "id int, g string, t string"), ["g"], "t", "id", words=1).collect()
    assert [(r.id, r.class_id, r.n_forms) for r in out if r.class_id != r.id - r.id % 2 or r.n_forms != 2] == []


def test_near_texts_find_links_inside_a_band_of_unlike_texts(spark, monkeypatch):
    """One band holds most texts here, so its two outermost forms stand for none of the others."""
    monkeypatch.setattr(near, "ROWS", 1)
    monkeypatch.setattr(near, "BANDS", 1)
    rng = random.Random(6)
    often = [f"often{i}" for i in range(12)]
    texts = []
    for i in range(40):
        base = rng.sample(often, 9) + [f"w{i}x{k}" for k in range(rng.randrange(1, 12))]
        texts += [" ".join(base), " ".join(base[1:]), " ".join([*base, f"more{i}"]), " ".join(base[rng.randrange(1, 5) :])]
    rows = [(i, ["g", "h", None][i % 3], t) for i, t in enumerate(texts)] + [(900, "g", None), (901, "g", "")]
    for similar in ((4, 5), (1, 2)):
        out = near.near_texts(spark.createDataFrame(rows, "id int, g string, t string"), ["g"], "t", "id", 1, similar).collect()
        sets = {i: (g, runs(t, 1)) for i, g, t in rows}

        def linked(a, b):
            (g, x), (h, y) = sets[a], sets[b]
            return g == h and x and y and similar[1] * len(x & y) >= similar[0] * len(x | y)

        assert {r.id: r.class_id for r in out} == by_hand(list(sets), linked)
