"""Positioned words to cleaned pages, token counts, roll-ups and rates.

``layout_words(source_id, page, line_no, word_no, text, y_min, y_max,
line_y_min)`` is shuffled once, by (source_id, page). The line and the page
aggregation both reuse that partitioning, and everything after them moves one
small row per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions.numbers import ratio
from folioscope.operators.checks import check_rows
from folioscope.operators.pages import page_role

# Exclusion reasons and default geometry of the measured protocol.
MAP_INTERNALS = "map_internals_key_or_source_credit"
CHAPTER_DISPLAY = "chapter_display"
FURNITURE = "running_furniture"
NOTE_CALLOUT = "superscript_note_callout"
DISPLAY_Y = 170.0
FURNITURE_Y = 50.0
CALLOUT_HEIGHT = 8.0

_NO_CAPTIONS = "cast(array() as array<struct<y_lo:double,y_hi:double,prefix:string>>)"


def page_rules(flags: DataFrame, captions: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row for each page that needs any rule; ordinary pages have none.

    ``flags(source_id, page, is_start, is_special)``, ``captions(source_id,
    page, y_lo, y_hi, prefix)``, ``overrides(source_id, page, display_y)``.
    """
    keys = ["source_id", "page"]
    per_page = captions.groupBy(*keys).agg(
        F.collect_list(F.struct("y_lo", "y_hi", "prefix")).alias("captions")
    )
    return (
        flags.filter("is_start or is_special")
        .join(per_page, keys, "left")
        .join(overrides, keys, "left")
        .select(
            *keys, "is_start", "is_special",
            F.coalesce("captions", F.expr(_NO_CAPTIONS)).alias("captions"),
            F.coalesce("display_y", F.lit(DISPLAY_Y)).alias("display_y"),
        )
    )


def is_caption(captions: Column, y: Column, raw: Column) -> Column:
    """A line inside one of the open y intervals or starting with a prefix."""
    return F.exists(
        captions,
        lambda c: F.coalesce((y > c["y_lo"]) & (y < c["y_hi"]), F.lit(False))
        | F.coalesce(raw.startswith(c["prefix"]), F.lit(False)),
    )


def line_reason(
    is_special: Column, is_start: Column, y: Column, display_y: Column, caption: Column
) -> Column:
    """First matching exclusion rule, NULL for a kept line."""
    return (
        F.when(is_special, F.when(~caption, MAP_INTERNALS))
        .when(is_start & (y < display_y), CHAPTER_DISPLAY)
        .when(y < FURNITURE_Y, FURNITURE)
    )


def is_callout(text: Column, height: Column, is_special: Column) -> Column:
    return (height < CALLOUT_HEIGHT) & ~is_special & tx.is_digits(text)


def gather_pages(words: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per page with its lines of positioned words in order.

    Both aggregations use the one exchange by page, to ``parts`` tasks if given:
    a task sorts its words, so there should be as many as keep that in memory.
    """
    placed = words.repartition(*([parts] if parts else []), "source_id", "page")
    by_line = placed.groupBy("source_id", "page", "line_no").agg(
        F.first("line_y_min").alias("y"),
        F.sort_array(F.collect_list(F.struct(
            "word_no", F.coalesce("text", F.lit("")).alias("text"),
            (F.col("y_max") - F.col("y_min")).alias("height"),
        ))).alias("words"),
    )
    return by_line.groupBy("source_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "y", "words"))).alias("lines")
    )


def assemble_lines(words: DataFrame, rules: DataFrame, parts: int | None = None) -> DataFrame:
    """Pages with their lines as (line_no, reason, n_words, n_callouts, text).

    ``reason`` is NULL for a kept line, ``text`` is NULL for an excluded one.
    Rules meet whole pages, which are already placed by page; ``parts`` is that
    of ``gather_pages``.
    """
    no = F.lit(False)
    pages = gather_pages(words, parts).join(rules, ["source_id", "page"], "left").withColumns({
        "is_start": F.coalesce("is_start", no), "is_special": F.coalesce("is_special", no),
        "display_y": F.coalesce("display_y", F.lit(DISPLAY_Y)),
        "captions": F.coalesce("captions", F.expr(_NO_CAPTIONS)),
        "norm": tx.nfkc_lines(F.transform("lines", lambda line: F.transform(line["words"], lambda w: w["text"]))),
    })
    special = F.col("is_special")

    def judged(pair: Column) -> Column:
        line, norm = pair["lines"], pair["norm"]
        raw = F.array_join(F.transform(line["words"], lambda w: w["text"]), " ")
        reason = line_reason(
            special, F.col("is_start"), line["y"], F.col("display_y"),
            is_caption(F.col("captions"), line["y"], raw),
        )
        kept = F.filter(norm, lambda w, i: ~is_callout(w, F.get(line["words"], i)["height"], special))
        return F.struct(
            line["line_no"].alias("line_no"), reason.alias("reason"),
            F.size(line["words"]).alias("n_words"), kept.alias("kept"),
        )

    def settled(line: Column) -> Column:
        text = F.array_join(line["kept"], " ")
        excluded = line["reason"].isNotNull()
        return F.struct(
            line["line_no"].alias("line_no"), line["reason"].alias("reason"), line["n_words"].alias("n_words"),
            F.when(excluded, 0).otherwise(line["n_words"] - F.size(line["kept"])).alias("n_callouts"),
            F.when(excluded, None).when(special, tx.strip_caption_label(text)).otherwise(text).alias("text"),
        )

    lines = F.transform(F.transform(F.arrays_zip("lines", "norm"), judged), settled)
    return pages.select("source_id", "page", "is_start", "is_special", lines.alias("lines"))


def excluded_map(counts: dict[str, Column]) -> Column:
    """MAP of reason to count, without the reasons that did not occur."""
    pairs = [c for reason, n in counts.items() for c in (F.lit(reason), n.cast("bigint"))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Cleaned page text, token count and excluded counts by reason; no shuffle."""
    def total(of) -> Column:
        return F.aggregate("lines", F.lit(0).cast("bigint"), lambda acc, line: acc + of(line))

    def excluded(reason: str) -> Column:
        return total(lambda line: F.when(line["reason"] == reason, line["n_words"]).otherwise(0))

    kept = F.transform(F.filter("lines", lambda line: line["text"].isNotNull()), lambda line: line["text"])
    counts = excluded_map({
        MAP_INTERNALS: excluded(MAP_INTERNALS),
        CHAPTER_DISPLAY: excluded(CHAPTER_DISPLAY),
        FURNITURE: excluded(FURNITURE),
        NOTE_CALLOUT: total(lambda line: line["n_callouts"]),
    })
    cleaned = pages.withColumns({"text": tx.dehyphenate(F.array_join(kept, "\n")), "excluded": counts})
    return cleaned.select(
        "source_id", "page", "is_start", "is_special", "text",
        tx.count_tokens(F.col("text")).alias("words"),
        page_role(F.col("is_special")).alias("role"), "excluded",
    )


def page_edges(pages: DataFrame, text: str = "text") -> DataFrame:
    """Page text reduced to the two facts the page join needs."""
    return pages.withColumns({
        "_opens": tx.starts_with_letter(F.col(text)), "_hangs": tx.ends_in_hyphen(F.col(text)),
    }).drop(text)


def cross_page_joins(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take one word off a page whose first word began on the page before it.

    ``pages(source_id, page, is_start, is_special, words, _opens, _hangs)``,
    see ``page_edges``. A page that ends inside a word sends a note to the key
    (source_id, page + 1), where one aggregation meets it with that page. So the
    input is read once, and a long source is never ordered in one task.
    Returns (pages, joins).
    """
    keys = ["source_id", "page"]
    own = F.struct(*[c for c in pages.columns if c not in (*keys, "_hangs")])
    sent = F.when(F.col("_hangs") & ~F.col("is_special"), F.struct(
        (F.col("page") + 1).cast(pages.schema["page"].dataType).alias("page"),
        F.lit(None).alias("own"), F.lit(True).alias("carried"),
    ))
    kept = F.struct("page", own.alias("own"), F.lit(False).alias("carried"))
    merged = pages.select("source_id", F.inline(F.array_compact(F.array(kept, sent)))).groupBy(*keys).agg(
        F.first("own", ignorenulls=True).alias("own"), F.bool_or("carried").alias("_carried")
    ).filter("own is not null").select(*keys, "own.*", "_carried")
    marked = merged.withColumn(
        "_joined", F.col("_carried") & F.col("_opens") & ~F.col("is_start") & ~F.col("is_special")
    )
    joins = marked.filter("_joined").select(
        "source_id", (F.col("page") - 1).alias("starts_on_page"),
        F.col("page").alias("continues_on_page"), (F.col("page") - 1).alias("word_assigned_to_page"),
    )
    adjusted = marked.withColumn("words", F.col("words") - F.col("_joined").cast("bigint"))
    return adjusted.drop("_joined", "_carried", "_opens"), joins


def rollup_words(pages: DataFrame, chunk_pages: DataFrame) -> DataFrame:
    """Words per chunk, per source and in all; owned pages only.

    ``level`` is ``chunk``, ``source`` or ``all``.
    """
    owned = chunk_pages.filter(F.col("ownership") == "owned").select("source_id", "page", "chunk_id")
    joined = pages.select("source_id", "page", "words").join(owned, ["source_id", "page"])
    return rollup_owned(joined)


def rollup_owned(owned_words: DataFrame) -> DataFrame:
    """The roll-up of ``(source_id, chunk_id, words)`` rows of owned pages."""
    level = F.expr("element_at(array('chunk', 'source', 'all', 'all'), cast(grouping_id() + 1 as int))")
    return owned_words.rollup("source_id", "chunk_id").agg(
        level.alias("level"), F.count("*").alias("pages"),
        F.sum("words").cast("bigint").alias("words"),
    )


def measurement_checks(pages: DataFrame, chunk_pages: DataFrame) -> DataFrame:
    """Every page has words; the sum over chunks equals the sum over pages.

    A page counts once for each chunk that owns it, so both sums come from one
    pass over the pages.
    """
    owners = chunk_pages.filter(F.col("ownership") == "owned").groupBy("source_id", "page").agg(
        F.count("*").alias("n_owners")
    )
    joined = pages.select("source_id", "page", "words").join(owners, ["source_id", "page"], "left")
    chunk_words = F.col("words") * F.coalesce("n_owners", F.lit(0))
    sums = joined.groupBy("source_id").agg(
        F.min("words").alias("least"), F.sum("words").cast("bigint").alias("page_sum"),
        F.sum(chunk_words).cast("bigint").alias("chunk_sum"),
    )
    both = F.inline(F.array(
        F.struct(
            F.lit("page_words_positive").alias("check"), (F.col("least") > 0).alias("ok"),
            F.col("least").alias("detail"),
        ),
        F.struct(
            F.lit("chunk_sum_equals_page_sum").alias("check"),
            (F.col("chunk_sum") == F.col("page_sum")).alias("ok"),
            (F.col("chunk_sum") - F.col("page_sum")).alias("detail"),
        ),
    ))
    rows = sums.select("source_id", both)
    return check_rows(rows, F.col("check"), F.col("source_id"), F.col("ok"), F.col("detail"))


def compare_protocols(measures: DataFrame, protocols: list[str], base: str) -> DataFrame:
    """Counts per chunk side by side, with each protocol's distance from ``base``."""
    wide = measures.groupBy("source_id", "chunk_id").pivot("protocol", protocols).agg(
        F.sum("words").cast("bigint")
    )
    deltas = {
        f"{p}_minus_{base}": F.col(p) - F.col(base) for p in protocols if p != base
    }
    return wide.withColumns(deltas)


def density_rates(counts: DataFrame, by: list[str]) -> DataFrame:
    """Heading paths and locators per 1,000 words; rounded once, after summing.

    ``counts`` holds ``headings``, ``locators`` and ``words`` per measured unit.
    The word-weighted mean of unit rates equals the rate of the sums.
    """
    summed = counts.groupBy(*by).agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("headings", "locators", "words")]
    )
    return summed.withColumns({
        "headings_per_1000": ratio(F.col("headings") * 1000, F.col("words")),
        "locators_per_1000": ratio(F.col("locators") * 1000, F.col("words")),
    })
