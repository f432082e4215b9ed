"""Dataset documents exploded into entity tables that keep parent and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The arrays of a dataset document, the id field of their records,
# and the arrays nested inside a record with the id field of the nested records.
COLLECTIONS = {
    "subjects": "subject_id",
    "relationships": "relationship_id",
    "reader_tasks": "task_id",
    "exclusions": "exclusion_id",
    "uncertainties": "uncertainty_id",
}
NESTED = {
    ("subjects", "evidence"): "evidence_id",
    ("subjects", "required_access_facets"): "facet_id",
    ("subjects", "retained_source_distinctions"): "distinction_id",
    ("reader_tasks", "required_access_facets"): "facet_id",
}


def explode_entities(docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of (version, parent id, id, position, record) from ``docs(version, doc)``.

    Nested ids are unique only inside their parent, so every nested table
    carries ``parent_id`` as part of its key.
    """
    tables = {}
    for name, id_field in COLLECTIONS.items():
        rows = docs.select(
            "version",
            F.posexplode(F.try_variant_get("doc", f"$.{name}", "array<variant>")).alias("pos", "record"),
        )
        tables[name] = rows.select(
            "version",
            F.try_variant_get("record", f"$.{id_field}", "string").alias("id"),
            "pos", "record",
        )
    for (parent, child), id_field in NESTED.items():
        rows = tables[parent].select(
            "version", F.col("id").alias("parent_id"),
            F.posexplode(F.try_variant_get("record", f"$.{child}", "array<variant>")).alias("pos", "record"),
        )
        tables[f"{parent}.{child}"] = rows.select(
            "version", "parent_id",
            F.try_variant_get("record", f"$.{id_field}", "string").alias("id"),
            "pos", "record",
        )
    return tables


def explode_releases(docs: DataFrame) -> dict[str, DataFrame]:
    """Release descriptors ``docs(path, json)`` as tables of their parts.

    ``releases`` one row per descriptor; ``bindings`` artifacts by role and
    evidence without a role; ``archives`` and ``declared`` archive members. All
    but the first name their descriptor's path, since a release id may be absent.
    """
    doc = F.try_parse_json("json")
    text = lambda name: F.try_variant_get(doc, f"$.{name}", "string")
    releases = docs.select(
        "path", "json", text("release_id").alias("release_id"), text("schema_version").alias("schema_version"),
        text("methodology_commit").alias("revision"), text("artifact_freeze_commit").alias("freeze_commit"),
    )
    binding = "struct<path:string,sha256:string>"
    own = F.col("path").alias("descriptor")
    part = lambda name, kind: F.try_variant_get(doc, f"$.{name}", kind)
    roles = docs.select(
        own, text("release_id").alias("release_id"), F.explode(part("artifacts", f"map<string,{binding}>")).alias("role", "b")
    )
    evidence = docs.select(
        own, text("release_id").alias("release_id"), F.lit(None).cast("string").alias("role"),
        F.explode(part("evidence", f"array<{binding}>")).alias("b"),
    )
    bindings = roles.unionByName(evidence).select("descriptor", "release_id", "role", "b.path", "b.sha256")
    archives = docs.select(
        own, text("release_id").alias("release_id"),
        F.explode(part("checkpoints", "array<struct<path:string,sha256:string,members:map<string,string>>>")).alias("c"),
    )
    return {
        "releases": releases,
        "bindings": bindings,
        "archives": archives.select("descriptor", "release_id", F.col("c.path").alias("archive"), F.col("c.sha256").alias("sha256")),
        "declared": archives.select(
            "descriptor", "release_id", F.col("c.path").alias("archive"), F.explode("c.members").alias("name", "artifact_path")
        ),
    }
