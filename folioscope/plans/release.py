"""Job: audit every release descriptor against files, archives and registrations.

All failures are reported; a release passes only if each of its checks does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.skew import grown
from folioscope.operators import coverage, diff, identity
from folioscope.operators.checks import all_checks, check_rows, none_of
from folioscope.plans.proof import proof_checks
from folioscope.session import cut_lineage
from folioscope.sources.entities import explode_releases


# What a correction of a density measurement may add with all under it, and replace.
DROPPED, RESTORED = ["/metadata_correction"], ["/protocol/source_role_note"]


def semantic_checks(profiled: DataFrame, facts: dict[str, DataFrame], wrappers: list[str]) -> list[DataFrame]:
    """Check rows over what the artifacts of a release say; ``facts`` name releases by the id they state.

    ``overlays``, ``reviews``, ``deltas`` and ``reviewed`` are those of
    ``independence`` (``overlay_id`` is the release id), asked of v10 releases;
    ``policies(release_id, template, lock_sha)`` holds policy texts and the
    lock's digest; ``scoped`` and ``locks(release_id, ...)`` hold the same scope
    fields; ``original`` and ``corrected(release_id, document, pointer, value)``
    the leaves of corrected density measurements; ``changes(release_id, id,
    action, fields)`` and ``approved(release_id, id, action, field)`` the
    benchmark's. A release without an overlay, a policy or a scope fails.
    """
    scope = F.col("scope")
    named = profiled.select(F.col("release_id").alias("_path"), F.col("stated").alias("release_id"), "scope", "profile")

    def each(judged: DataFrame, check: str, of: DataFrame = named) -> DataFrame:
        """One row per release: it is judged, and never unfavourably."""
        ok = judged.groupBy("release_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
        return check_rows(of.join(grown(ok), "release_id", "left"), check, scope, F.col("ok"), F.lit(""))

    def none(problems: DataFrame, detail: str, check: str) -> DataFrame:
        found = problems.groupBy("release_id").agg(F.count("*").alias("n"), F.min(detail).alias("first"))
        joined = named.join(grown(found), "release_id", "left")
        return check_rows(joined, check, scope, F.col("n").isNull(), F.col("first"))

    access = coverage.independence(facts["overlays"], facts["reviews"], facts["deltas"], facts["reviewed"])
    policies = facts["policies"].withColumn("ok", identity.semantic_sha(F.col("template"), wrappers) == F.col("lock_sha"))
    fields = [c for c in facts["locks"].columns if c != "release_id"]
    scoped = identity.scope_binding(facts["scoped"], facts["locks"], "release_id", fields)
    revised = diff.metadata_only(
        facts["original"], facts["corrected"], ["release_id", "document"], DROPPED, RESTORED
    ).filter("not metadata_only")
    loose = diff.unapproved(facts["changes"], facts["approved"], ["release_id", "id"])
    return [
        each(access.withColumnRenamed("overlay_id", "release_id"), "access_review", named.filter("profile = 'v10'")),
        each(policies, "policy_semantics"),
        each(scoped.withColumnRenamed("scope_ok", "ok"), "scope_binding"),
        none(revised, "document", "metadata_only"),
        none(loose, "field", "approved_changes"),
    ]


def audit_releases(
    docs: DataFrame, files: DataFrame, members: DataFrame, profiles: dict[str, tuple[str, str]],
    registrations: DataFrame, expected: DataFrame, facts: dict[str, DataFrame] | None = None,
    wrappers: tuple[str, ...] = (), contents: DataFrame | None = None,
) -> DataFrame:
    """Check rows for ``docs(path, json)``.

    ``files(path, sha256)``, ``members(archive, name, sha256)``; ``profiles``
    gives (profile, pinned revision) per schema version;
    ``registrations(state, stage, schema_version, path, sha256)`` and
    ``expected`` with the same columns, ``state`` being the release id.
    ``facts`` and the policy's ``wrappers`` are those of ``semantic_checks``. With
    ``contents(path, json)``, the texts of the bound files, what they say is judged
    too (``proof_checks``); without both only the transport is judged.
    """
    # The key of a release is its descriptor's path, which is always there and keeps
    # two descriptors of one id apart; the id it states names its check rows.
    # The parts are read by many checks: each is taken out of the descriptors once, so
    # that no plan holds the making of all of them again and again.
    parts = {name: cut_lineage(part) for name, part in explode_releases(docs).items()}
    releases = parts["releases"].withColumns({
        "stated": F.col("release_id"), "release_id": F.col("path"), "scope": F.coalesce("release_id", "path"),
    })
    bindings, archives, declared = (
        parts[name].withColumn("release_id", F.col("descriptor")).drop("descriptor")
        for name in ("bindings", "archives", "declared")
    )
    profiled = identity.select_profile(releases, profiles)
    scope = F.col("scope")

    bound = bindings.select("release_id", "path", "sha256").unionByName(
        archives.select("release_id", F.col("archive").alias("path"), "sha256")
    )
    shape = identity.binding_shape(bound).filter("not (sha_ok and path_ok)").select(
        "release_id", F.col("path").alias("detail")
    ).unionByName(
        declared.filter(~F.coalesce(identity.safe_path(F.col("name")), F.lit(False))).select(
            "release_id", F.col("name").alias("detail")
        )
    )
    nameless = releases.filter("stated is null").select("release_id", F.lit("release_id").alias("detail"))
    dupes = identity.binding_dupes(bound.select("release_id", "path"), releases.select("release_id", "path")).select("release_id", F.concat_ws(": ", "problem", "path").alias("detail"))

    with_role = bindings.filter("role is not null").join(
        grown(profiled.select("release_id", "profile")), "release_id"
    )
    roles = identity.role_check(with_role, identity.role_table(), profiled).select(
        "release_id", F.concat_ws(": ", "problem", "role").alias("detail")
    )

    found = files.groupBy("path").agg(F.max("sha256").alias("_have"))
    bytes_differ = bound.join(grown(found), "path", "left").filter(
        F.col("_have").isNull() | (F.col("_have") != F.col("sha256"))
    ).select("release_id", F.col("path").alias("detail"))

    # An archive is judged for each release that declares it, against that release's
    # own bindings. Its members meet every such release.
    own = lambda *columns: F.concat_ws("|", "release_id", *columns)
    named = archives.select("release_id", "archive").distinct()
    own_members = members.join(grown(named), "archive").select(own("archive").alias("archive"), "name", "sha256")
    own_declared = declared.select(own("archive").alias("archive"), "name", own("artifact_path").alias("artifact_path"))
    own_bindings = bindings.select(own("path").alias("path"), "role", "sha256")
    owner = named.select(own("archive").alias("archive"), "release_id", F.col("archive").alias("given"))
    per_member = identity.audit_bundle(own_members, own_declared, own_bindings).filter("status <> 'ok'")
    empty = named.join(grown(declared), ["release_id", "archive"], "left_anti").select(
        "release_id", F.concat(F.lit("no members: "), "archive").alias("detail")
    )
    member_problems = per_member.join(grown(owner), "archive").select(
        "release_id", F.concat_ws(": ", "status", "name").alias("detail")
    ).unionByName(empty)
    held = identity.bundle_roles(own_declared, own_bindings, identity.FREEZE_ROLES)
    freeze = owner.join(grown(held), "archive", "left").filter(~F.coalesce("complete", F.lit(False))).select(
        "release_id", F.col("given").alias("detail")
    )
    stray = members.select("archive").distinct().join(grown(named.select("archive").distinct()), "archive", "left_anti")
    registered = identity.unique_registration(registrations, expected).filter("status <> 'ok'").join(
        grown(releases.select(F.col("stated").alias("state"), "release_id")), "state"
    ).select("release_id", F.concat_ws(": ", "status", "stage").alias("detail"))

    return all_checks([
        check_rows(
            releases, "field_set", scope, identity.field_set_ok(F.col("json"), identity.RELEASE_FIELDS), F.lit("")
        ),
        check_rows(profiled, "profile", scope, F.col("status") == "ok", F.col("status")),
        check_rows(
            releases, "self_hash", scope, identity.self_hash_ok(F.col("json"), "release_sha256"), F.lit("")
        ),
        check_rows(
            releases, "freeze_commit", scope, identity.commit_shape(F.col("freeze_commit")), F.col("freeze_commit")
        ),
        none_of(releases, {
            "binding_shape": shape, "distinct_paths": dupes, "roles": roles, "artifact_bytes": bytes_differ,
            "archive_members": member_problems, "archive_freeze_proof": freeze, "registrations": registered,
            "release_id": nameless,
        }),
        check_rows(stray, "archive_declared", F.col("archive"), F.lit(False), F.lit("no release declares it")),
        *(semantic_checks(profiled, facts, list(wrappers)) if facts is not None else []),
        *([proof_checks(profiled.select("release_id", "stated", "scope", "profile"), bindings, contents, list(wrappers))]
          if contents is not None else []),
    ])
