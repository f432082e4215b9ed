"""A valid release, then one change per test, re-sealed so only the meant check fails."""

import copy
import hashlib
import json

import pytest

from folioscope.operators import identity
from folioscope.plans.release import audit_releases

PROFILES = {
    "subject-index-successor-release-v1": ("v8", "p" * 40),
    "subject-index-successor-release-v3": ("v10", "c" * 40),
}
ROLES = identity.BASE_ROLES + identity.ACCESS_ROLES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(doc):
    return json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def seal(doc):
    body = {k: v for k, v in doc.items() if k != "release_sha256"}
    return {**body, "release_sha256": sha(canonical(body))}


def valid(rid):
    """A sealed release whose paths all begin with its own id."""
    artifacts = {r: {"path": f"{rid}/{r}.json", "sha256": sha(r)} for r in ROLES}
    members = {f"m/{r}.json": f"{rid}/{r}.json" for r in identity.FREEZE_ROLES}
    doc = {
        "schema_version": "subject-index-successor-release-v3", "release_id": rid, "methodology_commit": "c" * 40,
        "artifact_freeze_commit": "f" * 40, "artifacts": artifacts,
        "evidence": [{"path": f"{rid}/proof/é.json", "sha256": sha("proof")}],
        "checkpoints": [{"path": f"{rid}/a.zip", "sha256": sha("zip"), "members": members}],
    }
    files = {f"{rid}/{r}.json": sha(r) for r in ROLES}
    return {
        "rid": rid, "doc": doc,
        "files": {**files, f"{rid}/proof/é.json": sha("proof"), f"{rid}/a.zip": sha("zip")},
        "members": [(f"{rid}/a.zip", name, sha(name[2:-5])) for name in members],
        "registrations": [(rid, "benchmark_freeze", "v2", f"{rid}/benchmark.json", sha("benchmark"))],
    }


def drop_role(r):
    del r["doc"]["artifacts"]["access_review"]


def extra_field(r):
    r["doc"]["note"] = "x"


def wrong_pin(r):
    r["doc"]["methodology_commit"] = "p" * 40


def unknown_version(r):
    r["doc"]["schema_version"] = "subject-index-successor-release-v9"


def short_commit(r):
    r["doc"]["artifact_freeze_commit"] = "f" * 39


def duplicate_path(r):
    r["doc"]["evidence"].append(copy.deepcopy(r["doc"]["artifacts"]["draft"]))


def binds_itself(r):
    own = f"rel/{r['rid']}.json"
    r["doc"]["evidence"].append({"path": own, "sha256": sha("x")})
    r["files"][own] = sha("x")


def climbing_path(r):
    path = f"../{r['rid']}.json"
    r["doc"]["evidence"][0]["path"] = path
    r["files"][path] = sha("proof")


def changed_bytes(r):
    r["files"][f"{r['rid']}/draft.json"] = sha("other")


def missing_file(r):
    del r["files"][f"{r['rid']}/proof/é.json"]


def swapped_member(r):
    r["members"][0] = (*r["members"][0][:2], sha("other"))


def undeclared_member(r):
    r["members"].append((f"{r['rid']}/a.zip", "m/extra.json", sha("x")))


def repeated_member(r):
    r["members"].append(r["members"][0])


def incomplete_freeze(r):
    members = r["doc"]["checkpoints"][0]["members"]
    del members["m/review.json"]
    r["members"] = [m for m in r["members"] if m[1] != "m/review.json"]


def second_registration(r):
    r["registrations"].append(r["registrations"][0])


def no_roles(r):
    r["doc"]["artifacts"] = {}


def climbing_archive(r):
    path = f"../{r['rid']}.zip"
    r["doc"]["checkpoints"][0]["path"] = path
    r["files"][path] = sha("zip")
    r["members"] = [(path, *m[1:]) for m in r["members"]]


def climbing_member(r):
    members = r["doc"]["checkpoints"][0]["members"]
    members["../draft.json"] = f"{r['rid']}/draft.json"
    r["members"].append((f"{r['rid']}/a.zip", "../draft.json", sha("draft")))


def no_members(r):
    r["doc"]["checkpoints"][0]["members"] = {}
    r["members"] = []


def no_id(r):
    del r["doc"]["release_id"]
    r["doc"]["artifacts"]["draft"]["sha256"] = "0" * 63


CASES = [
    (no_roles, {"roles", "archive_members", "archive_freeze_proof"}), (climbing_archive, {"binding_shape"}),
    (climbing_member, {"binding_shape"}), (no_members, {"archive_members", "archive_freeze_proof"}),
    (no_id, {"field_set", "release_id", "binding_shape", "artifact_bytes", "archive_members"}),
    (drop_role, {"roles"}), (extra_field, {"field_set"}), (wrong_pin, {"profile"}), (short_commit, {"freeze_commit"}),
    (duplicate_path, {"distinct_paths"}), (binds_itself, {"distinct_paths"}), (climbing_path, {"binding_shape"}),
    (changed_bytes, {"artifact_bytes"}), (missing_file, {"artifact_bytes"}), (swapped_member, {"archive_members"}),
    (undeclared_member, {"archive_members"}), (repeated_member, {"archive_members"}),
    (incomplete_freeze, {"archive_freeze_proof"}), (second_registration, {"registrations"}),
    (unknown_version, {"profile", "roles"}),
]


def unsealed(r):
    r["doc"]["artifact_freeze_commit"] = "e" * 40


def changed(edit):
    release = valid(edit.__name__)
    edit(release)
    release["doc"] = seal(release["doc"])
    return release


@pytest.fixture(scope="module")
def failed(spark):
    """Failed checks per release; all releases are audited by one job."""
    good = valid("good")
    good["doc"] = seal(good["doc"])
    late = valid("unsealed")
    late["doc"] = seal(late["doc"])
    unsealed(late)
    releases = [good, late] + [changed(edit) for edit, _ in CASES]
    texts = [(f"rel/{r['rid']}.json", json.dumps(r["doc"], ensure_ascii=False, indent=1)) for r in releases]
    every = lambda part: [row for r in releases for row in (r[part].items() if part == "files" else r[part])]
    reg = "state string, stage string, schema_version string, path string, sha256 string"
    expected = [row for r in releases for row in valid(r["rid"])["registrations"]]
    checks = audit_releases(
        spark.createDataFrame(texts, "path string, json string"),
        spark.createDataFrame(every("files"), "path string, sha256 string"),
        spark.createDataFrame(every("members"), "archive string, name string, sha256 string"),
        PROFILES,
        spark.createDataFrame(every("registrations"), reg), spark.createDataFrame(expected, reg),
    )
    rows = checks.collect()
    # A release without an id is named by its descriptor.
    names = {x["rid"]: {x["rid"], f"rel/{x['rid']}.json"} for x in releases}
    assert all(sum(r.scope in names[x["rid"]] for r in rows) == 12 for x in releases)
    return {x["rid"]: {r.check for r in rows if r.scope in names[x["rid"]] and not r.ok} for x in releases}


def test_valid_release_passes(failed):
    assert failed["good"] == set()


@pytest.mark.parametrize("edit, checks", CASES)
def test_one_change_fails_its_own_check(failed, edit, checks):
    assert failed[edit.__name__] == checks


def test_shared_and_stray_archives(spark):
    """One archive path bound by two releases is judged for each; an archive nobody declares is reported."""
    a, b = valid("a"), valid("b")
    b["doc"]["checkpoints"] = copy.deepcopy(a["doc"]["checkpoints"])
    members = b["doc"]["checkpoints"][0]["members"]
    for name, path in members.items():
        members[name] = path.replace("a/", "b/", 1)
    b["doc"]["artifacts"]["draft"]["sha256"] = sha("other draft")
    b["files"]["b/draft.json"] = sha("other draft")
    texts = [(f"rel/{r['rid']}.json", canonical(seal(r["doc"]))) for r in (a, b)]
    reg = "state string, stage string, schema_version string, path string, sha256 string"
    files = {**a["files"], **b["files"]}
    rows = audit_releases(
        spark.createDataFrame(texts, "path string, json string"),
        spark.createDataFrame(list(files.items()), "path string, sha256 string"),
        spark.createDataFrame(a["members"] + [("z.zip", "x", sha("x"))], "archive string, name string, sha256 string"),
        PROFILES, spark.createDataFrame(a["registrations"] + b["registrations"], reg), spark.createDataFrame([], reg),
    ).filter("not ok").collect()
    in_archive = {m[2:-5] for m in members}
    want = {("z.zip", "archive_declared")} | ({("b", "archive_members")} if "draft" in in_archive else set())
    assert {(r.scope, r.check) for r in rows} == want


def test_unsealed_change_fails_the_self_hash(failed):
    assert failed["unsealed"] == {"self_hash"}


def test_semantic_checks(spark):
    """One release passes all; each other breaks one of the semantic checks, and one has no facts."""
    ids = ["fine", "self_reviewed", "unreviewed", "other_policy", "other_scope", "recounted", "unapproved", "unknown"]
    told = ids[:-1]
    releases = [valid(i) for i in ids]
    texts = [(f"rel/{r['rid']}.json", canonical(seal(r["doc"]))) for r in releases]
    every = [row for r in releases for row in r["files"].items()]
    reg = "state string, stage string, schema_version string, path string, sha256 string"
    frame = spark.createDataFrame
    leaf = "release_id string, document string, pointer string, value string"
    body = canonical({"audience": "x"})
    facts = {
        "overlays": frame([(i, "ann", False) for i in told], "overlay_id string, author_id string, candidate_seen boolean"),
        "reviews": frame([(i, "ann" if i == "self_reviewed" else "bob", False) for i in told],
                         "overlay_id string, reviewer_id string, candidate_seen boolean"),
        "deltas": frame([(i, "d1") for i in told], "overlay_id string, delta_id string"),
        "reviewed": frame([(i, "d1") for i in told if i != "unreviewed"], "overlay_id string, delta_id string"),
        "policies": frame([(i, canonical({"audience": "y" if i == "other_policy" else "x", "policy_id": i}), sha(body)) for i in told],
                          "release_id string, template string, lock_sha string"),
        "scoped": frame([(i, "s2" if i == "other_scope" else "s1") for i in told], "release_id string, source_sha string"),
        "locks": frame([(i, "s1") for i in told], "release_id string, source_sha string"),
        "original": frame([(i, "density", "/total", "100") for i in told], leaf),
        "corrected": frame(
            [(i, "density", "/total", "101" if i == "recounted" else "100") for i in told]
            + [(i, "density", "/metadata_correction/by", "ann") for i in told], leaf),
        "changes": frame([(i, "S1", "change", ["stance"] if i == "unapproved" else ["name"]) for i in told],
                         "release_id string, id string, action string, fields array<string>"),
        "approved": frame([(i, "S1", "change", "name") for i in told],
                          "release_id string, id string, action string, field string"),
    }
    none = frame([], reg)
    rows = audit_releases(
        frame(texts, "path string, json string"), frame(every, "path string, sha256 string"),
        frame([m for r in releases for m in r["members"]], "archive string, name string, sha256 string"),
        PROFILES, none, none, facts, ("policy_id",),
    ).collect()
    assert len(rows) == 17 * len(ids)
    assert {(r.scope, r.check) for r in rows if not r.ok} == {
        ("self_reviewed", "access_review"), ("unreviewed", "access_review"), ("other_policy", "policy_semantics"),
        ("other_scope", "scope_binding"), ("recounted", "metadata_only"), ("unapproved", "approved_changes"),
        ("unknown", "access_review"), ("unknown", "policy_semantics"), ("unknown", "scope_binding"),
    }


def test_release_audit_plan_stays_small(spark):
    """Checks share their inputs: the plan does not hold the making of descriptors and texts once a check."""
    from folioscope.plans import catalog

    plan = catalog.QUERIES["release_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") < 12 and plan.count("Exchange") < 20 and len(plan.splitlines()) < 200


def test_release_audit_broadcasts_nothing(spark, tmp_path):
    """Parts of releases are many times the size of the table they are made of, so no join may send one whole."""
    from folioscope.plans import catalog

    rows = [(k, f"Customer#{k}", k % 25, "BUILDING") for k in range(1, 42)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        got = catalog.QUERIES["release_audit"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    faults = {5: "lineage", 7: "source_policy", 11: "template_profile", 13: "typed_registrations", 17: "density_bindings", 19: "metadata_only",
              23: "state_span", 29: "access_selection", 31: "source_policy_scope", 37: "self_hash", 41: "artifact_bytes"}
    assert sorted(map(tuple, got)) == sorted((f"R{k}", fault) for k, *_ in rows for n, fault in faults.items() if k % n == 0)


def test_texts_of_releases_are_made_in_as_many_tasks_as_the_customers_need(spark, tmp_path, monkeypatch):
    """The customer file is one split at most sizes, and the texts made of a row are many times the row."""
    from folioscope.plans import q_release
    from folioscope.plans.registry import Tables

    rows = [(k, f"Customer#{k}", k % 25, "BUILDING") for k in range(1, 42)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(q_release, "ROWS_A_TASK", 10, raising=False)
    docs = q_release.customer_releases(Tables(spark, str(tmp_path)))[0]
    assert docs.rdd.getNumPartitions() == 5 and docs.count() == 42
