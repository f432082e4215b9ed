"""Releases whose artifacts are real texts; every change is rejected for its own reason."""

import copy
import hashlib
import json

import pytest

from folioscope.plans import proof
from folioscope.plans.release import audit_releases

WRAPPERS = ["policy_id", "policy_sha256", "schema_version"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def canonical(doc):
    return json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sealed(doc, field):
    return {**doc, field: sha(canonical({k: v for k, v in doc.items() if k != field}))}


def release(change):
    """Texts and bindings of a release after ``change`` was made to its documents, all hashes made anew."""
    scope = {"document_page_span": [1, 9], "source_sha256": "s"}
    template = {
        "schema_version": proof.TEMPLATE_SCHEMA,
        "policy_semantic_content": {"source_scope": dict(scope), "policy_profile": {"id": "p8"}, "audit_design": {"mode": "full"}, "weight": 1e-7},
    }
    d = {
        "source_policy": {"policy_id": "x", "source_scope": {**scope, "more": 1}},
        "policy_template": template, "draft": {"d": 1}, "review": {"r": 1}, "page_map": {"m": 1}, "chunk_manifest": {"c": 1},
        "access_overlay": {"o": 1}, "access_review": {"v": 1}, "benchmark": {"version": 3},
        "original": {"protocol": {"source_role_note": "n", "t": "a\nb"}, "total": 10},
        "measurement": {"protocol": {"source_role_note": "better", "t": "a\nb"}, "total": 10}, "addendum": {"a": 1}, "disposition": {"y": 1},
        "state": {"source": {"document_page_span": [1, 9]}},
        "study_lock": {
            "release": {"lineage": {"kind": proof.LINEAGE}, "release_id": "R"}, "source_scope": scope, "policy_profile": "p8", "audit_mode": "full",
        },
        "skip": set(), "rehash": {}, "registered": {},
    }
    d = copy.deepcopy(d)
    change(d)
    path = lambda n: f"rel/x/{n}.json"
    texts = {}

    def write(name):
        texts[name] = canonical(d[name])
        return sha(texts[name])

    d["source_policy"] = sealed(d["source_policy"], "policy_sha256") if "policy_sha256" not in d["source_policy"] else d["source_policy"]
    d["benchmark"].setdefault("policy_sha256", d["source_policy"]["policy_sha256"])
    original, addendum, disposition = (write(n) for n in ("original", "addendum", "disposition"))
    d["measurement"]["metadata_correction"] = {
        "original_measurement_path": path("original"), "original_measurement_file_sha256": original,
        "scope_addendum_path": path("addendum"), "scope_addendum_file_sha256": addendum,
        "independent_source_scope_disposition": {"path": path("disposition"), "sha256": disposition},
    }
    lock = d["study_lock"]
    lock.setdefault("density_basis", {"chunks": [{"source_artifact": {"path": "measurement.json", "sha256": write("measurement")}}]})
    write("measurement")
    lock.setdefault("policy_semantic_sha256", sha(canonical({k: v for k, v in d["policy_template"].items() if k not in WRAPPERS})))
    lock["benchmark_access"] = {n: {"path": f"access_{n}.json", "sha256": write(f"access_{n}")} for n in ("overlay", "review")}
    lock["benchmark_access"]["overlay"].update(d["rehash"])
    registered = [(r, *proof.REGISTERED[r]) for r in proof.REGISTERED]
    d["state"]["artifacts"] = [
        {"stage": stage, "schema_version": schema, "path": f"{role}.json", "sha256": write(role)} | d["registered"].get(role, {})
        for role, stage, schema in registered]
    for name in ("study_lock", "state", "policy_template"):
        write(name)
    roles = [*proof.REGISTERED, "study_lock", "state", "policy_template", "access_overlay", "access_review"]
    bound = [(n if n in roles else None, path(n), sha(t)) for n, t in texts.items() if n not in d["skip"]]
    return [(path(n), t) for n, t in texts.items()], bound


def put(*steps, value):
    def change(d):
        at = d
        for s in steps[:-1]:
            at = at[s]
        at[steps[-1]] = value

    return change


CASES = {
    "fine": (lambda d: None, set()),
    "lineage": (put("study_lock", "release", "lineage", "kind", value="other"), {"lineage"}),
    "release id": (put("study_lock", "release", "release_id", value="Q"), {"lock_release"}),
    "overlay hash": (put("rehash", value={"sha256": "0" * 64}), {"access_selection"}),
    "overlay path": (put("rehash", value={"path": "elsewhere.json"}), {"access_selection"}),
    "policy unsealed": (put("source_policy", "policy_sha256", value="0" * 64), {"source_policy"}),
    "benchmark policy": (put("benchmark", "policy_sha256", value="0" * 64), {"source_policy"}),
    "policy scope": (put("source_policy", "source_scope", "source_sha256", value="t"), {"source_policy_scope"}),
    "policy scope missing": (put("source_policy", "source_scope", value={"source_sha256": "s"}), {"source_policy_scope"}),
    "template scope": (put("policy_template", "policy_semantic_content", "source_scope", "source_sha256", value="t"), {"policy_template_scope"}),
    "state span": (put("state", "source", "document_page_span", value=[1, 8]), {"state_span"}),
    "template schema": (put("policy_template", "schema_version", value="v0"), {"template_schema"}),
    "template semantics": (put("study_lock", "policy_semantic_sha256", value="0" * 64), {"template_semantics"}),
    "template wrapper": (put("policy_template", "policy_semantic_content", "policy_id", value="x"), {"template_wrappers"}),
    "template mode": (put("study_lock", "audit_mode", value="part"), {"template_profile"}),
    "template profile": (put("study_lock", "policy_profile", value="p9"), {"template_profile"}),
    "registered hash": (put("registered", value={"draft": {"sha256": "0" * 64}}), {"typed_registrations"}),
    "registered stage": (put("registered", value={"page_map": {"stage": "other"}}), {"typed_registrations"}),
    "registered twice": (put("registered", value={"page_map": {"stage": "benchmark_review", "schema_version": "source-benchmark-review-v1"}}), {"typed_registrations"}),
    "density unbound": (put("skip", value={"measurement"}), {"density_bindings"}),
    "no density": (put("study_lock", "density_basis", value={"chunks": []}), {"density_basis"}),
    "addendum unbound": (put("skip", value={"addendum"}), {"correction_bindings"}),
    "recounted": (put("measurement", "total", value=11), {"metadata_only"}),
    "protocol text": (put("measurement", "protocol", "t", value="a\\nb"), {"metadata_only"}),
    "no template": (put("skip", value={"policy_template"}), {"template_schema", "template_semantics", "template_wrappers", "template_profile", "policy_template_scope"}),
}


@pytest.fixture(scope="module")
def failed(spark):
    releases, bindings, contents = [], [], []
    for name, (change, _) in CASES.items():
        texts, bound = release(change)
        own = lambda p: f"{name}/{p}"
        releases.append((name, "R", name, "v10"))
        # Corrections name paths of the repository, so they carry the release's own folder.
        moved = {p: t.replace('_path":"rel/', f'_path":"{name}/rel/').replace('disposition":{"path":"rel/', f'disposition":{{"path":"{name}/rel/') for p, t in texts}
        again = {p: (sha(t), sha(moved[p])) for p, t in texts}
        lock = next(p for p in moved if p.endswith("study_lock.json"))
        measured = next(p for p in moved if p.endswith("measurement.json"))
        moved[lock] = moved[lock].replace(*again[measured])
        contents += [(own(p), t) for p, t in moved.items()]
        bindings += [(name, role, own(p), sha(moved[p]) if h == again[p][0] else h) for role, p, h in bound]
    frame = spark.createDataFrame
    rows = proof.proof_checks(
        frame(releases, "release_id string, stated string, scope string, profile string"),
        frame(bindings, "release_id string, role string, path string, sha256 string"), frame(contents, "path string, json string"), WRAPPERS,
    ).collect()
    assert len(rows) == 16 * len(CASES)
    out = {name: set() for name in CASES}
    for r in rows:
        if not r.ok:
            out[r.scope].add(r.check)
    return out


@pytest.mark.parametrize("name", CASES)
def test_each_change_fails_its_own_check(failed, name):
    assert failed[name] == CASES[name][1]


def test_audit_takes_the_texts(spark):
    from test_release import PROFILES, seal, valid

    r = valid("R")
    frame = spark.createDataFrame
    none = frame([], "state string, stage string, schema_version string, path string, sha256 string")
    rows = audit_releases(
        frame([("rel.json", canonical(seal(r["doc"])))], "path string, json string"), frame(list(r["files"].items()), "path string, sha256 string"),
        frame(r["members"], "archive string, name string, sha256 string"), PROFILES, none, none, wrappers=tuple(WRAPPERS),
        contents=frame([(p, "{}") for p in r["files"]], "path string, json string")).collect()
    assert {x.check for x in rows if x.ok} >= {"archive_members", "self_hash"}
    assert {x.check for x in rows if not x.ok} >= {"lineage", "typed_registrations", "density_basis"}


def test_pinned_release(spark):
    frame = spark.createDataFrame
    benchmark = sealed({"subjects": [{}, {}], "relationships": [{}], "reader_tasks": [], "version": 3}, "benchmark_sha256")
    review = {"review_mode": "full", "completion": {"done": True}}

    def audit(change=lambda d: None):
        texts = {"b.json": canonical(benchmark), "r.json": canonical(review)}
        doc = {
            "version": 3, "counts": {"subjects": 2, "relationships": 1, "reader_tasks": 0},
            "artifacts": {"benchmark": {"path": "b.json", "file_sha256": sha(texts["b.json"]), "canonical_sha256": benchmark["benchmark_sha256"]},
                          "review_ledger": {"path": "r.json", "file_sha256": sha(texts["r.json"])}, "note": {"path": None}},
        }
        d = {"doc": doc, "texts": texts, "state": [("d", "1", "b.json", sha(texts["b.json"]))], "manifest": [("d", "1", "b.json", sha(texts["b.json"]))]}
        change(d)
        pinned = [("d", "d", "/version", "3"), ("d", "r.json", "/review_mode", '"full"'), ("d", "r.json", "/completion/done", "true"), ("d", "b.json", "/version", "3")]
        reg = "descriptor string, artifact_id string, path string, sha256 string"
        rows = proof.audit_pinned(
            frame([("d", canonical(sealed(d["doc"], "release_sha256")))], "path string, json string"), frame(list(d["texts"].items()), "path string, json string"),
            frame([(p, sha(t)) for p, t in d["texts"].items()], "path string, sha256 string"),
            frame(pinned, "descriptor string, path string, pointer string, value string"), frame(d["state"], reg), frame(d["manifest"], reg)).collect()
        return {r.check for r in rows if not r.ok}

    assert audit() == set()
    assert audit(put("doc", "version", value=4)) == {"pinned"}
    assert audit(put("doc", "counts", "subjects", value=3)) == {"benchmark_counts"}
    assert audit(put("doc", "artifacts", "benchmark", "canonical_sha256", value="0" * 64)) == {"artifact_canonical"}
    assert audit(put("texts", "r.json", value=canonical({**review, "review_mode": "part"}))) == {"artifact_bytes", "pinned"}
    assert audit(put("manifest", value=[("d", "1", "b.json", "0" * 64)])) == {"registered"}
    assert audit(put("state", value=[])) == {"registered"}
