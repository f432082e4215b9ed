"""Checks of what the artifacts of releases say, derived from their own texts.

``bindings(release_id, role, path, sha256)`` are the bound files of releases, a NULL
role being evidence; ``contents(path, json)`` the texts of files. Facts are taken
out of each text where it is read, so no text is gathered: one small row per
release and role meets the others of its release.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.skew import grown
from folioscope.operators import diff, identity
from folioscope.operators.checks import all_checks, check_rows, none_of
from folioscope.session import cut_lineage

# Fixed values of the release format: what a lock's lineage and a template's schema are
# called, and the stage and schema under which a state registers each role.
LINEAGE = "current_source_freeze"
TEMPLATE_SCHEMA = "subject-index-study-policy-template-v1"
REGISTERED = {
    "draft": ("benchmark_synthesis", "source-subject-benchmark-draft-v1"),
    "review": ("benchmark_review", "source-benchmark-review-v1"),
    "benchmark": ("benchmark_freeze", "source-subject-benchmark-v2"),
    "page_map": ("page_mapping", "page-map-v1"),
    "chunk_manifest": ("chunk_definition", "chunk-manifest-v1"),
    "source_policy": ("define_policy", "subject-index-evaluation-policy-v4"),
}
# Where the facts lie in the artifact of each role.
FACTS = {
    "study_lock": {
        "lineage": "$.release.lineage.kind", "release": "$.release.release_id", "semantic": "$.policy_semantic_sha256",
        "profile": "$.policy_profile", "mode": "$.audit_mode", "span": "$.source_scope.document_page_span",
        "overlay_path": "$.benchmark_access.overlay.path", "overlay_sha": "$.benchmark_access.overlay.sha256",
        "review_path": "$.benchmark_access.review.path", "review_sha": "$.benchmark_access.review.sha256",
    },
    "state": {"span": "$.source.document_page_span"},
    "benchmark": {"policy": "$.policy_sha256"},
    "source_policy": {"policy": "$.policy_sha256"},
    "policy_template": {
        "schema": "$.schema_version", "profile": "$.policy_semantic_content.policy_profile.id",
        "mode": "$.policy_semantic_content.audit_design.mode",
    },
}


def beside(file: Column, name: Column) -> Column:
    """A name relative to the folder of ``file``."""
    return F.concat(F.regexp_replace(file, "[^/]+$", ""), name)


def _fact(role: str, name: str) -> str:
    return f"{role}_{name}"


def release_facts(texts: DataFrame, wrappers: list[str]) -> DataFrame:
    """One row per release: paths and hashes of its roles and the facts of ``FACTS`` as JSON text.

    ``texts(release_id, role, path, sha256, json)``. A role a release lacks leaves NULLs.
    """
    # Each text is parsed once, and only those that are sealed or wrapped are spelled anew.
    texts = texts.filter("role is not null").withColumn("_doc", F.try_parse_json("json"))
    doc = F.col("_doc")
    columns = {}
    for role, facts in FACTS.items():
        for name, at in facts.items():
            value = F.to_json(F.try_variant_get(doc, at, "variant"))
            columns[_fact(role, name)] = F.when(F.col("role") == role, value)
    policy = F.col("role") == "source_policy"
    columns["source_policy_sealed"] = F.when(policy, identity.self_hash_ok(F.when(policy, F.col("json")), "policy_sha256"))
    template = F.col("role") == "policy_template"
    columns["policy_template_semantic"] = F.when(template, identity.semantic_sha(F.when(template, F.col("json")), wrappers))
    inner = F.map_keys(F.try_variant_get(doc, "$.policy_semantic_content", "map<string,variant>"))
    columns["policy_template_wrapped"] = F.when(template, F.arrays_overlap(inner, F.array(*[F.lit(w) for w in wrappers])))
    named = texts.select("release_id", "role", "path", "sha256", *[c.alias(n) for n, c in columns.items()])
    files = {}
    for role in (*REGISTERED, "study_lock", "state", "access_overlay", "access_review"):
        files[f"{role}_path"] = F.when(F.col("role") == role, F.col("path"))
        files[f"{role}_file"] = F.when(F.col("role") == role, F.col("sha256"))
    return named.groupBy("release_id").agg(
        *[F.max(n).alias(n) for n in columns], *[F.max(c).alias(n) for n, c in files.items()])


def scope_rows(texts: DataFrame) -> DataFrame:
    """(release_id, key, role, value): entries of the lock's scope, the source policy's and the template's."""
    doc = F.try_parse_json("json")
    at = F.when(F.col("role") == "policy_template", F.try_variant_get(doc, "$.policy_semantic_content.source_scope", "map<string,variant>")).otherwise(
        F.try_variant_get(doc, "$.source_scope", "map<string,variant>"))
    rows = texts.filter(F.col("role").isin("study_lock", "source_policy", "policy_template"))
    return rows.select("release_id", "role", F.explode(at).alias("key", "v")).select("release_id", "role", "key", F.to_json("v").alias("value"))


def proof_checks(releases: DataFrame, bindings: DataFrame, contents: DataFrame, wrappers: list[str]) -> DataFrame:
    """Check rows over the texts of ``releases(release_id, stated, scope, profile)``.

    ``stated`` is the id a descriptor states. Judged are the lock's lineage and
    release id, the access proof it selects (profile v10), the state's typed
    registrations, the source policy's seal and its tie to the benchmark, the
    scopes and spans, the study template, and the bindings and content of density
    measurements. What is missing is not passed.
    """
    scope = F.col("scope")
    # Four checks read the texts of roles; texts no fact is taken from stay where they are.
    told = F.when(F.col("role").isin(*FACTS), F.col("json")).alias("json")
    texts = cut_lineage(bindings.filter("role is not null").join(grown(contents), "path").select("release_id", "role", "path", "sha256", told))
    # Small rows that many checks read.
    facts = cut_lineage(releases.join(grown(release_facts(texts, wrappers)), "release_id", "left"))

    def same(a: str, b: str) -> Column:
        return F.col(a) == F.col(b)

    def bare(name: str) -> Column:
        """The string a fact holds; other facts have no such string."""
        return F.when(F.col(name).startswith('"'), F.get(F.from_json(F.concat(F.lit("["), F.col(name), F.lit("]")), "array<string>"), F.lit(0)))

    def is_text(name: str, value: Column) -> Column:
        return bare(name) == value

    def selected(name: str, role: str) -> Column:
        path = beside(F.col("study_lock_path"), bare(f"study_lock_{name}_path"))
        return (path == F.col(f"{role}_path")) & (bare(f"study_lock_{name}_sha") == F.col(f"{role}_file"))

    access = (F.col("profile") != "v10") | (selected("overlay", "access_overlay") & selected("review", "access_review"))
    one_row = [
        ("lineage", is_text("study_lock_lineage", F.lit(LINEAGE))),
        ("lock_release", is_text("study_lock_release", F.col("stated"))),
        ("access_selection", access),
        ("source_policy", F.col("source_policy_sealed") & same("source_policy_policy", "benchmark_policy")),
        ("state_span", same("state_span", "study_lock_span")),
        ("template_schema", is_text("policy_template_schema", F.lit(TEMPLATE_SCHEMA))),
        ("template_semantics", bare("study_lock_semantic") == F.col("policy_template_semantic")),
        ("template_wrappers", ~F.col("policy_template_wrapped")),
        ("template_profile", same("policy_template_profile", "study_lock_profile") & same("policy_template_mode", "study_lock_mode")),
    ]
    judged = facts.select("scope", F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok")) for name, ok in one_row])).alias("c"))
    rows = [check_rows(judged, F.col("c.check"), scope, F.col("c.ok"), F.lit(""))]

    # Scopes: every entry of the lock is in both policies with the same value.
    entries = scope_rows(texts).groupBy("release_id", "key").agg(*[
        F.max(F.when(F.col("role") == r, F.col("value"))).alias(r) for r in ("study_lock", "source_policy", "policy_template")
    ]).filter("study_lock is not null")
    agreed = entries.groupBy("release_id").agg(*[
        F.bool_and(F.coalesce(F.col("study_lock") == F.col(r), F.lit(False))).alias(r) for r in ("source_policy", "policy_template")])

    # Registrations: exactly one of a role's stage and schema, of its path and hash.
    parts = "array<struct<stage:string,schema_version:string,path:string,sha256:string>>"
    registered = texts.filter("role = 'state'").select(
        "release_id", F.col("path").alias("state_path"),
        F.explode(F.try_variant_get(F.try_parse_json("json"), "$.artifacts", parts)).alias("a"),
    ).select(F.col("release_id").alias("state"), "a.stage", "a.schema_version", beside(F.col("state_path"), F.col("a.path")).alias("path"), "a.sha256")
    want = facts.select(F.col("release_id").alias("state"), F.explode(F.array(*[
        F.struct(F.lit(stage).alias("stage"), F.lit(schema).alias("schema_version"),
                 F.col(f"{role}_path").alias("path"), F.col(f"{role}_file").alias("sha256"))
        for role, (stage, schema) in REGISTERED.items()])).alias("w")).select("state", "w.*")
    typed = identity.unique_registration(registered, want).groupBy(F.col("state").alias("release_id")).agg(
        F.bool_and(F.col("status") == "ok").alias("ok"),
        F.min(F.when(F.col("status") != "ok", F.concat_ws(": ", "status", "stage"))).alias("detail"))

    # Density: measurements the lock names, and what their corrections rest on, are bound.
    chunk = "array<struct<source_artifact:struct<path:string,sha256:string>>>"
    named = texts.filter("role = 'study_lock'").select(
        "release_id", F.col("path").alias("lock_path"),
        F.explode(F.try_variant_get(F.try_parse_json("json"), "$.density_basis.chunks", chunk)).alias("c"),
    ).select("release_id", beside(F.col("lock_path"), F.col("c.source_artifact.path")).alias("path"), F.col("c.source_artifact.sha256").alias("sha256")).distinct()
    named = cut_lineage(named)
    bound = bindings.select("release_id", "path", "sha256").distinct()
    unbound = named.join(grown(bound), ["release_id", "path", "sha256"], "left_anti").select("release_id", F.col("path").alias("detail"))
    measured = named.select("release_id", "path").distinct().join(grown(contents), "path")
    note = F.try_variant_get(F.try_parse_json("json"), "$.metadata_correction", "variant")
    text = lambda at: F.try_variant_get(F.col("note"), f"$.{at}", "string")
    corrected = measured.withColumn("note", note).filter("note is not null").withColumn(
        "original", text("original_measurement_path"))
    rests = corrected.select("release_id", F.col("path").alias("detail"), F.explode(F.array(
        F.struct(F.col("original").alias("path"), text("original_measurement_file_sha256").alias("sha256")),
        F.struct(text("scope_addendum_path").alias("path"), text("scope_addendum_file_sha256").alias("sha256")),
        F.struct(text("independent_source_scope_disposition.path").alias("path"), text("independent_source_scope_disposition.sha256").alias("sha256")),
    )).alias("r")).select("release_id", "detail", "r.path", "r.sha256")
    loose = rests.join(grown(bound), ["release_id", "path", "sha256"], "left_anti").select("release_id", "detail")
    # And a correction changes metadata only.
    keys = ["release_id", "document"]
    after = corrected.select("release_id", F.col("path").alias("document"), "json")
    before = corrected.select("release_id", F.col("path").alias("document"), F.col("original").alias("path")).join(grown(contents), "path").select(*keys, "json")
    revised = diff.metadata_only(
        diff.flatten_json(before, keys, "json"), diff.flatten_json(after, keys, "json"), keys,
        ["/metadata_correction"], ["/protocol/source_role_note"],
    ).filter("not metadata_only").select("release_id", F.col("document").alias("detail"))
    has = named.select("release_id", F.lit(True).alias("_has")).distinct()
    met = releases
    for per_release in (agreed, typed, has):
        met = met.join(grown(cut_lineage(per_release)), "release_id", "left")
    asked = [
        ("source_policy_scope", "source_policy", F.lit("")), ("policy_template_scope", "policy_template", F.lit("")),
        ("typed_registrations", "ok", F.col("detail")), ("density_basis", "_has", F.lit("no measurement named")),
    ]
    found = met.select("scope", F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(ok).alias("ok"), detail.alias("detail")) for name, ok, detail in asked])).alias("c"))
    rows.append(check_rows(found, F.col("c.check"), scope, F.col("c.ok"), F.col("c.detail")))
    rows.append(none_of(releases, {"density_bindings": unbound, "correction_bindings": loose, "metadata_only": revised}))
    return all_checks(rows)


# ---------------------------------------------------------------- pinned releases
# The field that holds each artifact's own canonical digest.
OWN_HASH = {
    "policy": "policy_sha256", "page_map": "page_map_sha256", "chunk_manifest": "chunk_manifest_sha256", "benchmark": "benchmark_sha256",
}


def pinned_values(contents: DataFrame, pinned: DataFrame) -> DataFrame:
    """(path, pointer, want, have, ok) for values files must hold: ``pinned(path, pointer, value)`` as JSON text."""
    texts = contents.join(grown(pinned.select("path").distinct()), "path", "left_semi")
    leaves = diff.flatten_json(texts, ["path"], "json").select("path", "pointer", F.col("value").alias("have"))
    met = pinned.select("path", "pointer", F.col("value").alias("want")).join(leaves, ["path", "pointer"], "left")
    return met.withColumn("ok", F.coalesce(F.col("want") == F.col("have"), F.lit(False)))


def audit_pinned(
    descriptors: DataFrame, contents: DataFrame, files: DataFrame, pinned: DataFrame, states: DataFrame, manifests: DataFrame
) -> DataFrame:
    """Check rows for releases whose facts were fixed when they were made.

    ``descriptors(path, json)`` name artifacts with their file and canonical
    digests; ``pinned(descriptor, path, pointer, value)`` what descriptors and
    artifacts must say; ``files(path, sha256)``; ``states`` and
    ``manifests(descriptor, artifact_id, path, sha256)`` register files. A
    descriptor's own seal, every artifact's bytes, the canonical digests that the
    descriptor, the artifact and a recount must agree on, the counts of the
    benchmark, the pinned values, and each manifest entry against the bytes and
    the state's entry of the same id are judged, each in check rows of its own.
    """
    doc = F.try_parse_json("json")
    kind = "map<string,struct<path:string,file_sha256:string,canonical_sha256:string>>"
    artifacts = descriptors.select(F.col("path").alias("descriptor"), F.explode(F.try_variant_get(doc, "$.artifacts", kind)).alias("name", "a")).select(
        "descriptor", "name", "a.path", "a.file_sha256", "a.canonical_sha256").filter("path is not null")
    held = files.groupBy("path").agg(F.max("sha256").alias("have"), F.min("sha256").alias("have_too"))
    one = F.col("have") == F.col("have_too")
    where = F.concat_ws("|", "descriptor", "name")
    rows = [check_rows(descriptors, "self_hash", F.col("path"), identity.self_hash_ok(F.col("json"), "release_sha256"), F.lit(""))]
    rows.append(check_rows(artifacts.join(held, "path", "left"), "artifact_bytes", where, one & (F.col("have") == F.col("file_sha256")), F.col("path")))
    own = F.create_map(*[F.lit(x) for pair in OWN_HASH.items() for x in pair])
    sealed = artifacts.withColumn("field", own[F.col("name")]).filter("field is not null").join(contents, "path", "left")
    says = F.coalesce(*[F.when(F.col("field") == f, identity.json_field(F.col("json"), f)) for f in OWN_HASH.values()])
    recount = F.coalesce(*[F.when(F.col("field") == f, identity.self_hash_ok(F.col("json"), f)) for f in OWN_HASH.values()])
    rows.append(check_rows(sealed, "artifact_canonical", where, recount & (says == F.col("canonical_sha256")), F.col("path")))
    counted = artifacts.filter("name = 'benchmark'").join(contents, "path", "left").select(
        "descriptor", *[F.size(F.try_variant_get(doc, f"$.{e}", "array<variant>")).alias(e) for e in ("subjects", "relationships", "reader_tasks")])
    stated = descriptors.select(F.col("path").alias("descriptor"), *[
        F.try_variant_get(doc, f"$.counts.{e}", "int").alias(f"want_{e}") for e in ("subjects", "relationships", "reader_tasks")])
    equal = F.lit(True)
    for e in ("subjects", "relationships", "reader_tasks"):
        equal = equal & (F.col(e) == F.col(f"want_{e}"))
    rows.append(check_rows(stated.join(counted, "descriptor", "left"), "benchmark_counts", F.col("descriptor"), equal, F.lit("")))
    values = pinned_values(contents.unionByName(descriptors.select("path", "json")), pinned.select("path", "pointer", "value").distinct())
    judged = pinned.join(values.select("path", "pointer", F.col("want").alias("value"), "have", "ok"), ["path", "pointer", "value"], "left")
    rows.append(check_rows(judged, "pinned", F.concat_ws("|", "descriptor", "path", "pointer"), F.col("ok"), F.col("have")))
    entries = manifests.join(held, "path", "left").join(
        states.groupBy("descriptor", "artifact_id").agg(
            F.max("sha256").alias("state_sha"), F.count("*").alias("n_state")), ["descriptor", "artifact_id"], "left")
    repeats = manifests.groupBy("descriptor", F.col("path")).agg(F.count("*").alias("n_path"))
    ok = one & (F.col("have") == F.col("sha256")) & (F.col("state_sha") == F.col("sha256")) & (F.col("n_state") == 1) & (F.col("n_path") == 1)
    rows.append(check_rows(
        entries.join(repeats, ["descriptor", "path"]), "registered", F.concat_ws("|", "descriptor", "artifact_id"), ok, F.col("path")))
    return all_checks(rows)
