"""License scan: MinHash bands over overlapping windows, then exact containment.

A template of m words is looked for in windows of 2 m words, one every m / 2
words, so an occurrence lies whole in some window. Windows and templates are
sets of three-word shingles. A band is one of 32 minimum hashes; a window that
holds a whole template has a similarity of at least (m - 2) / (2 m - 2), which
is 1/4 for the shortest template: it shares a band with a probability over
0.9998, and over 0.9999999 from five words on. A window is compared exactly only
with templates it shares a band with.

A band can only be shared if the template's own minimum shingle lies in the
window. Bands are therefore worked out for windows around such shingles; all
other windows share none. Everything is one expression over a row: no shuffle,
no join, no Python. The templates are a fixed list inside the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import table

BANDS = 32
SHINGLE = 3
CONTAINMENT = 0.8

# Statements of common licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                 "and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
}


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles_of(words: Column) -> Column:
    """Hashes of all runs of three words, in order."""
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(
            *[F.get(words, i + k) for k in range(SHINGLE)]
        )),
    ).otherwise(F.array().cast("array<bigint>"))


def _hashed(shingles: Column, band: Column) -> Column:
    """(hash of a band, shingle) of the smallest; the shingle tells which one it was."""
    return F.array_min(F.transform(shingles, lambda x: F.struct(F.xxhash64(x, band).alias("h"), x.alias("x"))))


def prepared(spark: SparkSession, templates: dict[str, str]) -> list:
    """Per template its words, distinct shingles, and minimum shingle of each band."""
    if any(len(t.split()) < SHINGLE for t in templates.values()):
        raise ValueError(f"a template needs {SHINGLE} words")
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = rows.select("name", words_of(F.col("text")).alias("w"))
    rows = rows.select("name", F.size("w").alias("m"), F.array_distinct(shingles_of(F.col("w"))).alias("shingles"))
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))
    # One row per template of the fixed list.
    return rows.withColumn("minima", F.transform(bands, lambda b: _hashed(F.col("shingles"), b)["x"])).collect()


def _literal(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _match(shingles: Column, row) -> Column:
    """Best exact containment of a template in the retrieved windows; null if none."""
    window, stride = 2 * row.m - SHINGLE + 1, max(1, row.m // 2)
    minima, own = _literal(row.minima), _literal(row.shingles)
    anchors = sorted(set(row.minima))
    at = F.filter(
        F.transform(shingles, lambda x, i: F.when(x.isin(anchors), i)), lambda i: i.isNotNull()
    )
    # Windows, by number, that hold an anchor.
    numbers = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(
        F.greatest(F.lit(0), F.ceil((i - (window - 1)) / F.lit(stride))).cast("int"), F.floor(i / F.lit(stride)).cast("int")
    ))))
    found = F.transform(numbers, lambda k: F.slice(shingles, k * stride + 1, window))
    retrieved = F.filter(found, lambda w: F.exists(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: _hashed(w, b)["x"] == F.get(minima, b)
    ))
    return F.array_max(F.transform(retrieved, lambda w: F.size(F.array_intersect(own, w)) / F.lit(len(row.shingles))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_licenses, licenses, best: one row per row of ``docs``.

    ``licenses`` joins the names of templates of which some retrieved window
    holds at least ``containment`` of the shingles, in order of names; ``best``
    is the largest such share, 0 without one. Null, empty or short texts hold
    none. Repeated rows each get their row, null ids stay null, other columns
    are ignored, an empty table gives no rows. A long text is scanned whole. Templates
    of equal containment are all named.
    """
    rows = prepared(docs.sparkSession, templates)
    anchors = _literal(sorted({x for r in rows for x in r.minima}))
    split = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    hashed = split.select("doc_id", F.size("w").cast("bigint").alias("n_words"), shingles_of(F.col("w")).alias("s"))
    matches = F.array(*[
        F.struct(F.lit(r.name).alias("name"), _match(F.col("s"), r).alias("share")) for r in rows
    ])
    kept = F.when(
        F.arrays_overlap("s", anchors), F.filter(matches, lambda m: m["share"] >= containment)
    )
    out = hashed.select("doc_id", "n_words", kept.alias("m"))
    return out.select(
        "doc_id", "n_words", F.coalesce(F.array_size("m"), F.lit(0)).cast("bigint").alias("n_licenses"),
        F.coalesce(F.array_join("m.name", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.array_max("m.share"), F.lit(0.0)).alias("best"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_ROWS = ", ".join(f"('{n}', '{t}')" for n, t in TEMPLATES.items())
ORACLE = rf"""
WITH t AS (
  SELECT name, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {_ROWS}) v(name, text)),
ts AS (
  SELECT DISTINCT name, len(w) AS m, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT name, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
size AS (SELECT name, m, count(*) AS n FROM ts GROUP BY name, m),
d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w
  FROM documents),
p AS (
  SELECT rid, name, m, i - 1 AS pos, s
  FROM (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS s
        FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)) JOIN ts USING (s)),
win AS (
  SELECT rid, name, m, s,
         unnest(range(CAST(greatest(0, ceil((pos - (2 * m - 3)) / greatest(1, m // 2))) AS BIGINT),
                      CAST(pos // greatest(1, m // 2) AS BIGINT) + 1)) AS k
  FROM p),
share AS (
  SELECT rid, name, max(c / n) AS share
  FROM (SELECT rid, name, k, count(DISTINCT s) AS c FROM win GROUP BY rid, name, k) JOIN size USING (name)
  GROUP BY rid, name),
hit AS (
  SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(share) AS best
  FROM share WHERE share >= 0.8 GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses,
       coalesce(best, 0.0)::DOUBLE AS best
FROM d LEFT JOIN hit USING (rid)
"""
