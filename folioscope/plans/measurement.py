"""Job: positioned words of many sources to a measurement report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import checks, measure, pages
from folioscope.session import cut_lineage
from folioscope.sources.writers import write_checks, write_measurement


def measure_sources(
    words: DataFrame, segments: DataFrame, chunks: DataFrame, special: DataFrame,
    captions: DataFrame, overrides: DataFrame,
) -> dict[str, DataFrame]:
    """Pages, joins, chunk roll-up and check rows of every source.

    Counted pages are written to the checkpoint folder once, because the report,
    the roll-up and the checks all read them and the words are large.
    """
    page_map = pages.expand_page_map(segments)
    chunk_pages = pages.expand_chunks(chunks)
    flags = pages.page_flags(page_map, chunks, special)
    rules = measure.page_rules(flags, captions, overrides)
    cleaned = measure.assemble_pages(measure.assemble_lines(words, rules))
    edges = cut_lineage(measure.page_edges(cleaned))
    counted, joins = measure.cross_page_joins(edges)
    labels = page_map.select("source_id", "page", F.col("label").alias("page_label"))
    # Words of a page the map doesn't hold are counted nowhere, so each such page fails a check.
    unmapped = counted.join(labels, ["source_id", "page"], "left_anti")
    report = labels.join(counted, ["source_id", "page"], "left").withColumn(
        "words", F.coalesce("words", F.lit(0))
    )
    problems = pages.coverage(chunk_pages, page_map)
    return {
        "pages": report,
        "joins": joins,
        "rollup": measure.rollup_words(counted, chunk_pages),
        "checks": checks.all_checks([
            measure.measurement_checks(report, chunk_pages),
            checks.check_rows(
                unmapped, "page_not_mapped", F.concat_ws("/", "source_id", "page"), F.lit(False),
                F.concat(F.col("words").cast("string"), F.lit(" words")),
            ),
            checks.check_rows(
                problems, "page_owned_once", F.concat_ws("/", "source_id", "page"), F.lit(False), F.col("kind")
            ),
        ]),
    }


def write_report(result: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Totals, chunks, pages, joins and checks under ``path``."""
    chunk_rows = result["rollup"].filter("level = 'chunk'").drop("level")
    write_measurement(result["pages"], chunk_rows, result["joins"], path, fmt)
    write_checks(result["checks"], f"{path}/checks")
