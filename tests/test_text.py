import random
import re
import sys
import unicodedata

import scanner
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import text as tx

ALL = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
SAMPLES = [
    "plain words here", "café-\nélan", "soft­\n  hyphen", "1914-\n1918", "B2-\nc", "x²-\ny",
    "a-\nb-\nc", "- -- — a b c", "tab\tand\x1csep\x1fx", "ﬁne ① ½", "", "end-", "end­ ",
    "〇 一 ٤٥ ०", "under_score _", "é ́a", "a\u0085b",
]


def test_digit_class_is_pythons(spark):
    df = spark.createDataFrame([(c,) for c in ALL if c.isdigit() or unicodedata.category(c) in ("Nd", "No", "Nl")], "c string")
    got = {r.c: r.ok for r in df.select("c", tx.is_digits(F.col("c")).alias("ok")).collect()}
    wrong = {c for c, ok in got.items() if ok != c.isdigit() and unicodedata.normalize("NFKC", c) == c}
    # Characters newer than one of the two Unicode tables may differ.
    assert wrong == set()


def test_stable_characters_are_fixed_points():
    pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", tx.UNSTABLE))
    stable = [c for c in ALL if not pattern.search(c)]
    assert {"é", "ß", "’", "—", "Ж", "λ"} <= set(stable) and not {"ﬁ", "ĳ", "²", "\u0301", "\u2011", "\xa0"} & set(stable)
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choices(stable, k=30))
        assert unicodedata.normalize("NFKC", text) == text


def test_samples_match_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    t = F.col("t")
    got = df.select(
        "t", tx.tokens(t), tx.count_tokens(t), tx.dehyphenate(t), tx.nfkc(t), tx.ends_in_hyphen(t), tx.starts_with_letter(t)
    ).collect()
    for s, toks, n, joined, plain, hangs, opens in got:
        assert toks == scanner.counted_units(s)
        assert n == len(scanner.counted_units(s))
        assert joined == scanner.rejoined(s)
        assert plain == unicodedata.normalize("NFKC", s)
        assert hangs == scanner.hangs(s)
        assert opens == scanner.opens_with_letter(s)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("abéß1٣ -­\n\t_.²Ⅷ "), max_size=40), min_size=30, max_size=60))
def test_random_texts_match_python(spark, texts):
    df = spark.createDataFrame([(s,) for s in texts], "t string")
    for s, n, joined in df.select("t", tx.count_tokens(F.col("t")), tx.dehyphenate(F.col("t"))).collect():
        assert n == len(scanner.counted_units(s))
        assert joined == scanner.rejoined(s)


def test_nfkc_lines_keeps_shape(spark):
    pages = [[["aﬁ", "b"], [], ["①"]], [["ascii"]], [], None, [["é", "Å", "aﬁ"]]]
    df = spark.createDataFrame([(p,) for p in pages], "p array<array<string>>").coalesce(1)
    got = [r[0] for r in df.select(tx.nfkc_lines(F.col("p"))).collect()]
    want = [None if p is None else [[unicodedata.normalize("NFKC", w) for w in ws] for ws in p] for p in pages]
    assert got == want


def test_caption_label(spark):
    df = spark.createDataFrame([("Map  12. The Rhine",), ("Map of 1. x",), ("On Map 3. x",)], "t string")
    got = [r[0] for r in df.select(tx.strip_caption_label(F.col("t"))).collect()]
    assert got == ["The Rhine", "Map of 1. x", "On Map 3. x"]


def test_label_keys(spark):
    df = spark.createDataFrame([("The  Terror!",), ("terror, The",), ("TERROR the terror",)], "t string")
    got = df.select(tx.label_key(F.col("t")), tx.label_near_key(F.col("t"))).collect()
    assert [r[0] for r in got] == ["the terror", "terror the", "terror the terror"]
    assert {r[1] for r in got} == {"terror the"}
