from pyspark.sql import functions as F

from folioscope.functions.ranking import explode_range
from folioscope.operators import measure, pages

# A 425-page source in 17 chunks; owned ranges, context pages, page counts.
OWNED = [
    (1, 43), (44, 65), (66, 85), (86, 111), (112, 135), (136, 158), (159, 173), (174, 196), (197, 219),
    (220, 246), (247, 271), (272, 296), (297, 317), (318, 340), (341, 368), (369, 390), (391, 425),
]
PAGE_COUNTS = [45, 26, 24, 30, 28, 27, 19, 27, 27, 31, 29, 29, 25, 27, 32, 26, 37]
# Words per chunk by three counting protocols.
PROTOCOL_WORDS = {
    "legacy": [19778, 10088, 9090, 11987, 10384, 10356, 6561, 10909, 10537, 12192, 11621, 11603, 9810, 10836, 12739, 10258, 15969],
    "native": [19854, 9970, 9171, 11993, 10328, 10573, 6627, 10908, 10469, 12190, 11628, 11947, 9816, 10837, 12633, 10405, 15997],
    "uniform": [19635, 9922, 9055, 11861, 10208, 10478, 6543, 10803, 10457, 12080, 11612, 11557, 9710, 10719, 12419, 10257, 15802],
}
CHUNKS = "source_id string, chunk_id string, packet_order int, owned_ranges array<array<int>>, context_ranges array<array<int>>"
SEGMENTS = (
    "source_id string, mapping_id string, mode string, range array<int>, label_style string, label_start string, "
    "prefix string, suffix string, in_scope boolean, accepts_locators boolean"
)


def book(spark):
    rows = []
    for i, (a, b) in enumerate(OWNED):
        before = [[a - 2, a - 1]] if a > 1 else []
        after = [[b + 1, b + 2]] if b < 425 else []
        rows.append(("book", f"CHUNK-{i + 1:03d}", i + 1, [[a, b]], before + after))
    return spark.createDataFrame(rows, CHUNKS)


def book_map(spark):
    return pages.expand_page_map(spark.createDataFrame(
        [("book", "main-text", "sequence", [1, 425], "arabic", "1", "", "", True, True)], SEGMENTS
    ))


def test_book_sidecars_and_inventory(spark):
    chunk_pages = pages.expand_chunks(book(spark))
    inventory = {r.chunk_id: r for r in pages.chunk_inventory(chunk_pages).collect()}
    for i, (a, b) in enumerate(OWNED):
        row = inventory[f"CHUNK-{i + 1:03d}"]
        assert row.page_count == PAGE_COUNTS[i] and row.owned_page_count == b - a + 1
    sidecar = pages.chunk_sidecar(book(spark))
    second = sidecar.filter("chunk_id = 'CHUNK-002'").orderBy("chunk_page").collect()
    assert [r.document_page for r in second] == list(range(42, 68))
    assert [r.chunk_page for r in second] == list(range(1, 27))
    assert [r.ownership for r in second] == ["context"] * 2 + ["owned"] * 22 + ["context"] * 2
    assert sidecar.count() == sum(PAGE_COUNTS)


def test_both_numberings_agree(spark, rows):
    a = pages.chunk_sidecar(book(spark)).select("chunk_id", F.col("document_page").alias("page"), "chunk_page")
    b = pages.number_chunk_pages(pages.expand_chunks(book(spark))).select("chunk_id", "page", "chunk_page")
    assert rows(a) == rows(b)


def test_sidecar_with_overlapping_ranges(spark):
    df = spark.createDataFrame([("s", "C", 1, [[5, 6], [1, 2]], [[2, 3]])], CHUNKS)
    got = [(r.chunk_page, r.document_page, r.ownership) for r in pages.chunk_sidecar(df).orderBy("chunk_page").collect()]
    assert got == [(1, 1, "owned"), (2, 2, "context"), (3, 2, "owned"), (4, 3, "context"), (5, 5, "owned"), (6, 6, "owned")]


def test_book_is_covered_once(spark):
    assert pages.coverage(pages.expand_chunks(book(spark)), book_map(spark)).count() == 0


def test_coverage_names_each_fault(spark, rows):
    chunks = spark.createDataFrame([("s", "A", 1, [[1, 3]], []), ("s", "B", 2, [[3, 4], [9, 9]], [])], CHUNKS)
    page_map = pages.expand_page_map(spark.createDataFrame(
        [("s", "m", "sequence", [1, 5], "arabic", "11", "p", "a", True, True)], SEGMENTS
    ))
    assert rows(pages.coverage(pages.expand_chunks(chunks), page_map)) == [
        ("s", 3, "duplicate", 2), ("s", 5, "gap", 0), ("s", 9, "out_of_range", 1)
    ]
    assert page_map.orderBy("page").first().label == "p11a"


def test_owner_by_range_equals_owner_by_page(spark, rows):
    owned = pages.owner_of(book_map(spark).select("source_id", "page"), book(spark), width=16)
    by_page = pages.expand_chunks(book(spark)).filter("ownership = 'owned'")
    assert rows(owned.select("page", "chunk_id")) == rows(by_page.select("page", "chunk_id"))


def test_flags_and_roles(spark):
    special = spark.createDataFrame([("book", p) for p in (3, 127, 129, 225, 345)], "source_id string, page int")
    flags = pages.page_flags(book_map(spark), book(spark), special)
    assert {r.page for r in flags.filter("is_start").collect()} == {a for a, _ in OWNED}
    assert flags.filter("is_special").count() == 5


def test_inspection_progress(spark):
    owned = spark.createDataFrame([("s", p) for p in range(1, 6)], "source_id string, page int")
    reads = spark.createDataFrame(
        [("s", 1, "reused"), ("s", 2, "reused"), ("s", 2, "new"), ("s", 3, "new"), ("s", 9, "new")],
        "source_id string, page int, kind string",
    )
    r = pages.inspection_progress(reads, owned).first()
    assert (r.n_owned, r.n_both, r.n_unread, r.n_not_owned, r.complete) == (5, 1, 2, 1, False)
    done = spark.createDataFrame([("s", p, "new" if p > 2 else "reused") for p in range(1, 6)], "source_id string, page int, kind string")
    assert pages.inspection_progress(done, owned).first().complete


def test_protocol_totals(spark):
    data = [("book", f"C{i}", p, n) for p, ns in PROTOCOL_WORDS.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(data, "source_id string, chunk_id string, protocol string, words bigint")
    wide = measure.compare_protocols(df, ["uniform", "legacy", "native"], "uniform")
    total = wide.agg(F.sum("legacy"), F.sum("native"), F.sum("uniform"), F.sum("legacy_minus_uniform")).first()
    assert tuple(total) == (194718, 195346, 193118, 1600)


def test_ranges_expand_in_blocks(spark, rows):
    df = spark.createDataFrame([("a", 1, 10), ("b", 7, 7), ("c", 5, 3)], "k string, lo int, hi int")
    got = rows(explode_range(df, ["k"], F.col("lo"), F.col("hi"), "n", block=4).select("k", "n"))
    assert got == sorted([("a", n) for n in range(1, 11)] + [("b", 7)], key=repr)
