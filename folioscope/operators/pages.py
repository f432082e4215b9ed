"""Page map expansion, chunk ownership and coverage of pages by chunks.

Frames: ``segments(source_id, mapping_id, mode, range, label_style, label_start,
prefix, suffix, in_scope, accepts_locators)``; ``chunks(source_id, chunk_id,
packet_order, owned_ranges, context_ranges)``; ``chunk_pages(source_id,
chunk_id, page, ownership)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.ranking import bucketed_position, explode_range, range_join
from folioscope.functions.sides import side_count, stack, tag


def expand_page_map(segments: DataFrame) -> DataFrame:
    """One row per page with its printed label.

    Only ``sequence`` segments with arabic labels are defined. Pages of any
    other segment keep a NULL label.
    """
    start, end = F.col("range")[0], F.col("range")[1]
    rows = explode_range(segments, ["source_id", "mapping_id"], start, end, "page")
    number = (F.col("label_start").cast("bigint") + F.col("page") - start).cast("string")
    known = (F.col("mode") == "sequence") & (F.col("label_style") == "arabic")
    return rows.select(
        "source_id", "mapping_id", "page",
        F.when(known, F.concat("prefix", number, "suffix")).alias("label"),
        "in_scope", "accepts_locators",
    )


def _tagged_ranges() -> Column:
    def part(col: str, ownership: str) -> Column:
        return F.transform(
            F.coalesce(F.col(col), F.expr("cast(array() as array<array<int>>)")),
            lambda r: F.struct(
                r[0].alias("lo"), r[1].alias("hi"), F.lit(ownership).alias("ownership")
            ),
        )

    return F.concat(part("owned_ranges", "owned"), part("context_ranges", "context"))


def expand_chunks(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_id, packet_order, page, ownership)."""
    ranges = chunks.select("source_id", "chunk_id", "packet_order", F.inline(_tagged_ranges()))
    rows = explode_range(ranges, ["source_id", "chunk_id"], F.col("lo"), F.col("hi"), "page")
    return rows.select("source_id", "chunk_id", "packet_order", "page", "ownership")


def chunk_sidecar(chunks: DataFrame) -> DataFrame:
    """Owned and context pages in page order, numbered 1..n inside the chunk.

    The number of a page follows from its own chunk's ranges: the pages below
    it in every range, plus one. So no page has to be sorted, however long a
    chunk is. A page held by two ranges of one chunk gets both numbers,
    context first.
    """
    rows = chunks.select("source_id", "chunk_id", _tagged_ranges().alias("_ranges")).select(
        "source_id", "chunk_id", "_ranges", F.inline("_ranges")
    )
    rows = explode_range(rows, ["source_id", "chunk_id"], F.col("lo"), F.col("hi"), "page")

    def pages_before(acc: Column, other: Column) -> Column:
        below = F.greatest(
            F.lit(0), F.least(F.col("page") - 1, other["hi"]) - other["lo"] + 1
        )
        tie = F.col("page").between(other["lo"], other["hi"]) & (
            (other["ownership"] < F.col("ownership"))
            | ((other["ownership"] == F.col("ownership")) & (other["lo"] < F.col("lo")))
        )
        return acc + below + tie.cast("bigint")

    return rows.select(
        "source_id", "chunk_id",
        F.aggregate("_ranges", F.lit(1).cast("bigint"), pages_before).alias("chunk_page"),
        F.col("page").alias("document_page"), "ownership",
    )


def number_chunk_pages(chunk_pages: DataFrame) -> DataFrame:
    """The same numbering from already expanded pages, bucketed by page number."""
    return bucketed_position(chunk_pages, ["source_id", "chunk_id"], "page", "chunk_page")


def chunk_inventory(chunk_pages: DataFrame) -> DataFrame:
    return chunk_pages.groupBy("source_id", "chunk_id").agg(
        F.count("*").alias("page_count"),
        F.count_if(F.col("ownership") == "owned").alias("owned_page_count"),
        F.count_if(F.col("ownership") == "context").alias("context_page_count"),
    )


def owner_of(pages: DataFrame, chunks: DataFrame, width: int = 1024) -> DataFrame:
    """The chunk owning each page, by range; pages without an owner keep NULL."""
    ranges = chunks.select("source_id", "chunk_id", F.explode("owned_ranges").alias("r")).select(
        "source_id", "chunk_id", F.col("r")[0].alias("lo"), F.col("r")[1].alias("hi")
    )
    return range_join(
        pages, ranges, ["source_id"], "page", "lo", "hi", width=width, how="left"
    ).drop("lo", "hi")


def coverage(chunk_pages: DataFrame, page_map: DataFrame) -> DataFrame:
    """Pages not owned exactly once: ``duplicate``, ``gap`` or ``out_of_range``."""
    owned = chunk_pages.filter(F.col("ownership") == "owned")
    keys = ["source_id", "page"]
    counts = stack([tag(owned, "owned", keys), tag(page_map.filter("in_scope"), "map", keys)])
    counts = counts.groupBy(*keys).agg(
        side_count("owned").alias("n_owned"), side_count("map").alias("n_map")
    )
    kind = (
        F.when((F.col("n_map") == 0), "out_of_range")
        .when(F.col("n_owned") == 0, "gap")
        .when(F.col("n_owned") > 1, "duplicate")
    )
    return counts.withColumn("kind", kind).filter("kind is not null").select(
        *keys, "kind", "n_owned"
    )


def chunk_starts(chunks: DataFrame) -> DataFrame:
    """First page of each chunk's first owned range."""
    return chunks.select("source_id", F.col("owned_ranges")[0][0].alias("page"))


def page_flags(pages: DataFrame, chunks: DataFrame, special: DataFrame) -> DataFrame:
    """``is_start`` and ``is_special`` per page."""
    marks = stack([
        tag(chunk_starts(chunks), "start", ["source_id", "page"]),
        tag(special, "special", ["source_id", "page"]),
    ]).groupBy("source_id", "page").agg(
        (side_count("start") > 0).alias("is_start"), (side_count("special") > 0).alias("is_special")
    )
    no = F.lit(False)
    return pages.join(marks, ["source_id", "page"], "left").withColumns({
        "is_start": F.coalesce("is_start", no), "is_special": F.coalesce("is_special", no),
    })


def page_role(is_special: Column) -> Column:
    # The two page roles of a measurement report.
    return F.when(is_special, "substantive_map_caption_only").otherwise("body_and_substantive_notes")


def inspection_progress(reads: DataFrame, owned: DataFrame) -> DataFrame:
    """Reused and newly read pages against all owned pages, per source.

    ``reads(source_id, page, kind)`` with kind ``reused`` or ``new``.
    """
    keys = ["source_id", "page"]
    tagged = stack([
        tag(owned, "owned", keys), reads.select(*keys, F.col("kind").alias("_side")),
    ])
    per_page = tagged.groupBy(*keys).agg(
        (side_count("owned") > 0).alias("owned"),
        (side_count("reused") > 0).alias("reused"),
        (side_count("new") > 0).alias("new"),
    )
    read = F.col("reused") | F.col("new")
    out = per_page.groupBy("source_id").agg(
        F.count_if("owned").alias("n_owned"),
        F.count_if("reused").alias("n_reused"),
        F.count_if("new").alias("n_new"),
        F.count_if(F.col("reused") & F.col("new")).alias("n_both"),
        F.count_if(F.col("owned") & ~read).alias("n_unread"),
        F.count_if(~F.col("owned") & read).alias("n_not_owned"),
    )
    return out.withColumn("complete", F.expr("n_both = 0 and n_unread = 0 and n_not_owned = 0"))
