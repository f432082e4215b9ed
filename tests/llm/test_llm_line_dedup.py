import hashlib

from folioscope.llm import line_dedup


def by_hand(rows):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    first = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            place = 2**63 - 1 if doc is None else doc
            first[key(line)] = min(first.get(key(line), place), place)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        place = 2**63 - 1 if doc is None else doc
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == place]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(docs):
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()
    return sorted(
        ((r.doc_id, len(r["lines"]), len(r["lines"]) - len(r["kept"]),
          hashlib.sha256("\n".join(r["kept"]).encode()).hexdigest()) for r in got), key=repr,
    )


def test_hard_rows(spark, hard, hard_rows):
    lines = [
        (20, "A common line here\nown line twenty\n  a COMMON line here\t", None, None, None),
        (21, "a common line here\nshort\nshort", None, None, None), (22, "short\nA common line here", None, None, None),
        (22, "short\nA common line here", None, None, None), (None, "a common line here\nx", None, None, None),
    ]
    rows = hard_rows + lines
    docs = spark.createDataFrame(rows, hard.schema)
    assert digest(docs) == by_hand(rows)


def test_a_hot_line_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    rows = [(i, "the same long line\nline number %05d of it" % i) for i in range(400)]
    rows += [(i, "the same long line") for i in range(400, 600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert digest(docs) == by_hand(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_clashing_and_empty(clashing, empty):
    docs = clashing.drop("lines", "kept")
    assert digest(docs) == digest(docs.select("doc_id", "text"))
    assert line_dedup.keep_bitmaps(empty).count() == 0
