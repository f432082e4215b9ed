"""Digests, manifests and registrations.

Frames: ``bindings(release_id, role, path, sha256[, bytes])``, ``files(path,
sha256[, bytes])``, ``members(archive, name, sha256)``, ``declared(archive,
name, artifact_path)``, ``registrations(state, artifact_id, stage, path,
sha256, schema_version)``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.canonical import canonical_sha, drop_fields, json_field
from folioscope.functions.sides import side_count, side_value, stack, tag
from folioscope.functions.skew import grown, hot_join
from folioscope.session import cut_lineage

# Profiles by schema version, and the roles a release must bind.
PROFILES = {
    "subject-index-successor-release-v1": "v8",
    "subject-index-successor-release-v2": "v9",
    "subject-index-successor-release-v3": "v10",
}
BASE_ROLES = [
    "state", "draft", "review", "benchmark", "study_lock", "page_map", "chunk_manifest",
    "source_policy", "policy_template",
]
ACCESS_ROLES = ["access_overlay", "access_review"]
FREEZE_ROLES = ["state", "draft", "review", "benchmark"]
RELEASE_FIELDS = [
    "schema_version", "release_id", "methodology_commit", "artifact_freeze_commit", "artifacts",
    "evidence", "checkpoints", "release_sha256",
]
SHA256_SHAPE = "^[a-f0-9]{64}$"
COMMIT_SHAPE = "^[a-f0-9]{40}$"


def field_set_ok(json_text: Column, fields: Iterable[str]) -> Column:
    """The object has exactly these top-level fields."""
    wanted = F.array(*[F.lit(f) for f in sorted(fields)])
    return F.coalesce(F.array_sort(F.json_object_keys(json_text)) == wanted, F.lit(False))


def self_hash_ok(json_text: Column, field: str) -> Column:
    """The digest of the document without ``field`` equals the value of ``field``."""
    return F.coalesce(
        F.sha2(drop_fields(json_text, [field]), 256) == json_field(json_text, field), F.lit(False)
    )


def semantic_sha(json_text: Column, wrappers: Iterable[str]) -> Column:
    """Digest after removing identity and wrapper fields."""
    return F.sha2(drop_fields(json_text, wrappers), 256)


def audit_manifest(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """Per path: ``ok``, ``missing``, ``mismatch`` or ``undeclared``.

    Bindings that agree are one row per (path, sha256); two different hashes
    bound to one path are both judged.
    """
    has_bytes = "bytes" in bindings.columns and "bytes" in files.columns
    values = ["sha256", "bytes"] if has_bytes else ["sha256"]
    declared = bindings.groupBy("path", "sha256").agg(
        *([F.max("bytes").alias("bytes")] if has_bytes else []), F.count("*").alias("n_bindings")
    )
    bound_paths = declared.select("path", F.lit(True).alias("bound")).distinct()
    found = files.groupBy("path").agg(*[F.max(v).alias(f"file_{v}") for v in values])
    same = F.col("file_sha256") == F.col("sha256")
    if has_bytes:
        same = same & F.col("file_bytes").eqNullSafe(F.col("bytes"))
    judged = declared.join(found, "path", "left").select(
        "path", "n_bindings",
        F.when(F.col("file_sha256").isNull(), "missing").when(same, "ok").otherwise("mismatch").alias("status"),
    )
    undeclared = found.join(bound_paths, "path", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("n_bindings"), F.lit("undeclared").alias("status")
    )
    return judged.unionByName(undeclared)


def safe_path(path: Column) -> Column:
    """A relative POSIX path: no backslash, no empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    return (path != "") & ~path.contains("\\") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def binding_shape(bindings: DataFrame) -> DataFrame:
    return bindings.withColumns({
        "sha_ok": F.coalesce(F.col("sha256").rlike(SHA256_SHAPE), F.lit(False)),
        "path_ok": F.coalesce(safe_path(F.col("path")), F.lit(False)),
    })


def commit_shape(commit: Column) -> Column:
    return F.coalesce(commit.rlike(COMMIT_SHAPE), F.lit(False))


def binding_dupes(bindings: DataFrame, descriptors: DataFrame | None = None) -> DataFrame:
    """Paths a release binds twice, and descriptors that bind themselves.

    ``descriptors(release_id, path)`` names each release's own file.
    """
    dupes = bindings.groupBy("release_id", "path").agg(F.count("*").alias("n"))
    out = dupes.filter("n > 1").select("release_id", "path", F.lit("duplicate_path").alias("problem"), "n")
    if descriptors is None:
        return out
    own = dupes.join(grown(descriptors.select("release_id", "path").distinct()), ["release_id", "path"])
    return out.unionByName(
        own.select("release_id", "path", F.lit("binds_itself").alias("problem"), "n")
    )


def role_table() -> dict[str, list[str]]:
    """Roles per profile: nine base roles for every profile, two more for v10."""
    return {p: BASE_ROLES + (ACCESS_ROLES if p == "v10" else []) for p in PROFILES.values()}


def role_check(bindings: DataFrame, roles: dict[str, list[str]], releases: DataFrame | None = None) -> DataFrame:
    """Roles a release misses, binds beyond its profile's roles, or repeats.

    ``bindings(release_id, profile, role)``. Required roles are written beside
    each release from the small policy table, without a join on the profile,
    which has very few values. ``releases(release_id, profile)`` names the
    releases that must bind roles; without it a release that binds none is not seen.
    """
    keys = ["release_id", "role"]
    table = F.create_map(*[
        x for p, names in roles.items() for x in (F.lit(p), F.array(*[F.lit(r) for r in names]))
    ])
    known = bindings if releases is None else releases
    required = known.select("release_id", "profile").distinct().select(
        "release_id", F.explode(table[F.col("profile")]).alias("role")
    )
    counts = stack([tag(required, "required", keys), tag(bindings, "bound", keys)])
    counts = counts.groupBy(*keys).agg(
        side_count("required").alias("r"), side_count("bound").alias("b")
    )
    problem = (
        F.when(F.col("b") == 0, "missing").when(F.col("r") == 0, "extra").when(F.col("b") > 1, "repeated")
    )
    return counts.withColumn("problem", problem).filter("problem is not null").select(*keys, "problem")


def select_profile(releases: DataFrame, profiles: dict[str, tuple[str, str]]) -> DataFrame:
    """Profile by schema version; its pinned revision must be the release's own.

    ``profiles`` gives (profile, pinned revision) per schema version.
    """
    def lookup(i: int) -> Column:
        pairs = [x for version, row in profiles.items() for x in (F.lit(version), F.lit(row[i]))]
        return F.create_map(*pairs)[F.col("schema_version")]

    status = (
        F.when(lookup(0).isNull(), "unknown_version")
        .when(lookup(1) == F.col("revision"), "ok").otherwise("pin_differs")
    )
    return releases.withColumns({"profile": lookup(0), "status": status})


def unique_registration(registrations: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected (state, stage, schema_version) is registered exactly once, as stated.

    Aggregated before the join, so a registration repeated without end is one row.
    """
    keys = ["state", "stage", "schema_version"]
    found = registrations.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("path").alias("reg_path"), F.max("sha256").alias("reg_sha")
    )
    out = expected.join(grown(found), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = (
        F.when(F.col("n") != 1, "not_exactly_one")
        .when(
            F.col("reg_path").eqNullSafe(F.col("path")) & F.col("reg_sha").eqNullSafe(F.col("sha256")),
            "ok",
        )
        .otherwise("path_or_hash_differs")
    )
    return out.withColumn("status", status).drop("reg_path", "reg_sha")


def audit_bundle(members: DataFrame, declared: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per (archive, name): ``ok``, ``undeclared``, ``absent``, ``duplicate``,
    ``unbound``, ``conflict`` (its path is bound to several digests) or
    ``differs``. Every problem of every archive is reported.
    """
    keys = ["archive", "name"]
    artifacts = stack([
        bindings.select(F.col("path").alias("artifact_path"), "sha256", F.lit("bound").alias("_side")),
        tag(declared, "declared", ["artifact_path"]),
    ]).groupBy("artifact_path").agg(
        side_value("bound", "sha256").alias("want_sha"), side_count("declared").alias("_n"),
        (F.min(F.when(F.col("_side") == "bound", F.col("sha256"))) != side_value("bound", "sha256")).alias("several"),
    )
    want = hot_join(grown(declared), artifacts, ["artifact_path"], "_n", "left")
    both = stack([
        members.select(*keys, F.col("sha256").alias("have"), F.lit("member").alias("_side")),
        want.select(*keys, F.col("want_sha").alias("want"), "several", F.lit("declared").alias("_side")),
    ])
    per_name = both.groupBy(*keys).agg(
        side_count("member").alias("n_members"), side_count("declared").alias("n_declared"),
        F.min("have").alias("have"), F.max("have").alias("have_max"), F.max("want").alias("want"),
        F.bool_or(F.coalesce("several", F.lit(False))).alias("several"),
    )
    status = (
        F.when(F.col("n_declared") == 0, "undeclared")
        .when(F.col("n_members") == 0, "absent")
        .when(F.col("n_members") > 1, "duplicate")
        .when(F.col("want").isNull(), "unbound")
        .when(F.col("several"), "conflict")
        .when(F.col("have") == F.col("want"), "ok")
        .otherwise("differs")
    )
    return per_name.withColumn("status", status).select(*keys, "n_members", "status")


def bundle_roles(declared: DataFrame, bindings: DataFrame, required: list[str]) -> DataFrame:
    """How many of the required roles' artifacts each archive holds.

    The bound paths are checkpointed, so that the join of a path in very many
    archives can be split.
    """
    role_paths = cut_lineage(bindings.filter(F.col("role").isin(required)).select(
        F.col("path").alias("artifact_path"), "role"
    ).distinct())
    held = declared.join(grown(role_paths), "artifact_path", "left")
    return held.groupBy("archive").agg(
        F.count_distinct("role").alias("n_required_roles"),
        (F.count_distinct("role") == len(required)).alias("complete"),
    )


def population_sha(
    df: DataFrame, by: list[str], sha: str, position: str | None = None,
    levels: tuple[int, ...] = (6, 4, 2),
) -> DataFrame:
    """One digest per population of record digests; equal populations, equal digests.

    Equal records are counted first, so copies cost one row. The distinct
    entries are then hashed as a tree over hex prefixes of the record digest:
    each task joins the entries of one prefix only, never a whole population.
    With ``position`` the record order is part of the digest.
    """
    entry = F.col(sha)
    if position is not None:
        entry = F.sha2(F.concat_ws(":", F.col(position).cast("string"), entry), 256)
    nodes = (
        df.withColumn("_h", entry).groupBy(*by, "_h").agg(F.count("*").alias("_n"))
        .select(*by, F.col("_h").alias("_p"), F.concat_ws(":", "_h", F.col("_n").cast("string")).alias("_d"), "_n")
    )
    for width in (*levels, 0):
        nodes = nodes.groupBy(*by, F.substring("_p", 1, width).alias("_p")).agg(
            F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), ","), 256).alias("_d"),
            F.sum("_n").alias("_n"),
        )
    return nodes.select(*by, F.col("_n").alias("n_records"), F.col("_d").alias("population_sha"))


LANES = 4  # a digest of 64 hex digits is four whole numbers of 64 bits


def multiset_sums(sha: str, n: str | None = None, prefix: str = "_s") -> list[Column]:
    """Aggregates ``prefix0``..: sums of the four parts of record digests, ``n`` times each."""
    def lane(i: int) -> Column:
        part = F.conv(F.substring(sha, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")
        return part if n is None else part * F.col(n).cast("decimal(18,0)")

    zero = F.lit(0).cast("decimal(38,0)")
    return [F.coalesce(F.sum(lane(i).cast("decimal(38,0)")), zero).alias(f"{prefix}{i}") for i in range(LANES)]


def multiset_sha(n: str, prefix: str = "_s") -> Column:
    """The digest of a population from its number of records and its sums."""
    return F.sha2(F.concat_ws(":", F.col(n).cast("string"), *[F.col(f"{prefix}{i}").cast("string") for i in range(LANES)]), 256)


def multiset_state(df: DataFrame, by: list[str], sha: str) -> DataFrame:
    """(*by, n_records, _s0.._s3): what identifies a population of record digests and can be updated.

    The sums do not depend on order, and those of two disjoint parts add up, so a
    task's records are one row before they move. A record without a digest
    counts as a record of digest 0. ``population_digest`` turns a state into text.
    """
    known = df.withColumn(sha, F.coalesce(sha, F.lit("0" * 64)))
    return known.groupBy(*by).agg(F.count("*").alias("n_records"), *multiset_sums(sha))


def update_state(state: DataFrame, added: DataFrame, removed: DataFrame, by: list[str], sha: str) -> DataFrame:
    """The state after records came and went, without reading the population again.

    Groups left without records go.
    """
    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*by, *[(F.lit(sign) * F.col(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns if c not in by])

    parts = stack([state, multiset_state(added, by, sha), signed(multiset_state(removed, by, sha), -1)])
    columns = ["n_records", *[f"_s{i}" for i in range(LANES)]]
    kinds = {c: state.schema[c].dataType for c in columns}
    return parts.groupBy(*by).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in columns]).filter("n_records <> 0")


def population_digest(state: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n_records, population_sha) of states; equal exactly for equal multisets of digests."""
    return state.select(*by, "n_records", multiset_sha("n_records").alias("population_sha"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per path: ``unchanged``, ``changed``, ``gone`` or ``new`` since the snapshot.

    Presence is counted, so a path without a digest is still there; with a
    digest missing on a side, or held twice, it is ``unknown``.
    """
    both = stack([tag(before, "before", ["path"], ["sha256"]), tag(after, "after", ["path"], ["sha256"])])
    sides = both.groupBy("path").agg(
        side_value("before", "sha256").alias("b"), side_value("after", "sha256").alias("a"),
        side_count("before").alias("_n_before"), side_count("after").alias("_n_after"),
    )
    status = (
        F.when(F.col("_n_after") == 0, "gone").when(F.col("_n_before") == 0, "new")
        .when(F.expr("_n_before > 1 or _n_after > 1 or a is null or b is null"), "unknown")
        .when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    )
    return sides.select("path", status.alias("status"))


def common_bindings(candidates: DataFrame, by: list[str], shared: list[str], own: str) -> DataFrame:
    """Candidates share one value of every shared field and keep their own wrapper.

    A value missing anywhere is not common.
    """
    def one_value(c: str) -> Column:
        return (F.min(c).eqNullSafe(F.max(c))) & (F.count(c) == F.count("*"))

    return candidates.groupBy(*by).agg(
        F.count("*").alias("n_candidates"),
        *[one_value(c).alias(f"{c}_common") for c in shared],
        (F.count_distinct(own) == F.count("*")).alias("own_wrappers"),
    )


def expect(actual: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Actual against expected constants; NULL equals NULL."""
    both = stack([tag(actual, "actual", keys, [value]), tag(expected, "expected", keys, [value])])
    sides = both.groupBy(*keys).agg(
        side_value("expected", value).alias("expected"), side_value("actual", value).alias("actual")
    )
    return sides.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def scope_binding(artifacts: DataFrame, parents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Children whose scope hashes differ from their parent's, or whose parent is absent."""
    renamed = parents.select(key, F.lit(True).alias("_found"), *[F.col(f).alias(f"_parent_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_parent_{f}"))
    joined = artifacts.join(renamed, key, "left")
    return joined.withColumn(
        "scope_ok", F.coalesce(F.col("_found"), F.lit(False)) & same
    ).drop("_found", *[f"_parent_{f}" for f in fields])
