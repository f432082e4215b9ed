"""Readers for documents, ledgers, page layouts and raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One line of a review ledger: a changed record and its field changes. Values
# stay VARIANT, so a missing value and a JSON null remain different.
LEDGER_SCHEMA = (
    "id string, before_file string, before_record_sha256 string, "
    "proposed_record_sha256 string, "
    "field_diffs array<struct<path:string, operation:string, before:variant, after:variant>>"
)


def split_documents(texts: DataFrame, json_text: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows with VARIANT ``doc``, rejected rows with ``reason``) of one JSON object a row."""
    parsed = texts.withColumn("doc", F.try_parse_json(json_text))
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    reason = F.when(F.col("doc").isNull(), "not valid JSON").otherwise("not a JSON object")
    return parsed.filter(is_object), parsed.filter(~is_object).withColumn("reason", reason).drop("doc", json_text)


def read_documents(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """One JSON object per file: (documents with VARIANT ``doc``, rejected files)."""
    raw = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")
    )
    return split_documents(raw)


def read_ledger(spark: SparkSession, path: str | list[str], schema: str = LEDGER_SCHEMA) -> DataFrame:
    """JSON lines with a fixed schema; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def parse_ledger(lines: DataFrame, json_text: str, schema: str = LEDGER_SCHEMA) -> DataFrame:
    """The same for lines that are rows already."""
    record = F.from_json(json_text, schema, {"mode": "FAILFAST"})
    return lines.select(record.alias("_r")).select("_r.*")


def ledger_changes(ledger: DataFrame) -> DataFrame:
    """One row per field change; values as canonical JSON, absent value as NULL."""
    return ledger.select(
        "id", "before_record_sha256", "proposed_record_sha256", F.explode("field_diffs").alias("d")
    ).select(
        "id", "before_record_sha256", "proposed_record_sha256",
        F.col("d.path").alias("pointer"), F.col("d.operation").alias("op"),
        F.to_json("d.before").alias("before"), F.to_json("d.after").alias("after"),
    )


WHOLE = 1 << 30  # bytes; longer files are hashed as streams


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of files read block by block; a task holds one block."""
    import hashlib

    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "bytes", "sha256"])


def read_files(spark: SparkSession, glob: str | list[str], whole: int = WHOLE) -> DataFrame:
    """Path, byte length and SHA-256 of files of any length.

    Files of up to ``whole`` bytes are read by Spark. The content of longer ones is
    never read into a row (the filter on the length reaches the reader): a task
    streams the file through the digest in blocks, so it needs no more memory for
    a long file. A digest can't be split, so one file is one task's work. Spark's
    readers pass over files of no bytes; those have no row.
    """
    files = spark.read.format("binaryFile").load(glob)
    short = files.filter(F.col("length") <= whole).select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    long = files.filter(F.col("length") > whole).select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("bytes"))
    # Deal files out one by one, as each may take long.
    streamed = long.repartition("path").mapInArrow(_stream_digests, "path string, bytes bigint, sha256 string")
    return short.unionByName(streamed.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")))


_WORD = T.StructType([
    T.StructField("_VALUE", T.StringType()),
    T.StructField("_yMin", T.DoubleType()),
    T.StructField("_yMax", T.DoubleType()),
])
_LINE = T.StructType([
    T.StructField("_yMin", T.DoubleType()), T.StructField("word", T.ArrayType(_WORD)),
])
_BLOCK = T.StructType([T.StructField("line", T.ArrayType(_LINE))])
_FLOW = T.StructType([T.StructField("block", T.ArrayType(_BLOCK))])
_PAGE = T.StructType([T.StructField("flow", T.ArrayType(_FLOW))])


def layout_from_pages(pages: DataFrame, lines: Column) -> DataFrame:
    """Flat words from one row per (source_id, page) holding an array of lines."""
    by_line = pages.select("source_id", "page", F.posexplode(lines).alias("line_no", "line"))
    by_word = by_line.select(
        "source_id", "page", "line_no", F.col("line._yMin").alias("line_y_min"),
        F.posexplode_outer("line.word").alias("word_no", "word"),
    )
    return by_word.select(
        "source_id", "page", "line_no", "word_no",
        F.coalesce("word._VALUE", F.lit("")).alias("text"),
        F.col("word._yMin").alias("y_min"), F.col("word._yMax").alias("y_max"), "line_y_min",
    ).filter(F.col("word_no").isNotNull())


def layout_from_xml(pages: DataFrame, xml: str) -> DataFrame:
    """Positioned words of pages (source_id, page, ``xml``), one <page> element each."""
    parsed = pages.select("source_id", "page", F.from_xml(F.col(xml), _PAGE).alias("p"))
    lines = F.flatten(F.transform(
        F.flatten(F.transform("p.flow", lambda f: f["block"])), lambda b: b["line"]
    ))
    return layout_from_pages(parsed, lines)


def read_layout(spark: SparkSession, path: str | list[str], row_tag: str = "page") -> DataFrame:
    """Positioned words of bounding-box XML, one file per source, pages in file order.

    Files are split: records end at the closing tag of a page, wherever a split
    of the file begins. A page's number is its place in its split plus the pages
    of the splits before, from one row a split; so many tasks read one file. The
    closing tag must not occur inside comments or CDATA.
    """
    end = f"</{row_tag}>"
    records = spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value",
    ).withColumn("_at", F.expr(f"regexp_instr(value, '<{row_tag}[ >]')")).filter("_at > 0")
    # The rows of a split are read in order by one task.
    splits = records.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    pages = records.join(splits, ["_file", "_block"]).select(
        F.regexp_extract("_file", r"([^/]+)\.[^./]+$", 1).alias("source_id"),
        (F.col("_row") - F.col("_first") + F.col("_base") + 1).cast("int").alias("page"),
        F.concat(F.expr("substring(value, _at)"), F.lit(end)).alias("xml"),
    )
    return layout_from_xml(pages, "xml")
