"""Query: the release audit over releases made of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.sides import stack
from folioscope.operators import identity
from folioscope.plans import proof
from folioscope.plans.registry import Tables, query
from folioscope.plans.release import audit_releases
from folioscope.session import cut_lineage

PIN = "c" * 40
WRAPPERS = ("policy_id", "policy_sha256", "schema_version")
ROWS_A_TASK = 4_000  # customers whose texts one task makes; those of one are about 20 KB
PROFILES = {"subject-index-successor-release-v3": ("v10", PIN)}


def text(**fields: Column) -> Column:
    """A JSON object with sorted keys, so its text is canonical."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def sha(col: Column) -> Column:
    return F.sha2(col, 256)


def bound(path: Column, digest: Column) -> Column:
    return F.struct(path.alias("path"), digest.alias("sha256"))


def customer_releases(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(descriptors, contents, files, members): a release per customer, some with one fault each way."""
    key = F.col("c_custkey")
    s = lambda v: F.lit(v)
    every = lambda n: key % n == 0
    at = lambda name: F.concat(s("r/"), key, s(f"/{name}.json"))
    span = F.array(s(1), F.col("c_nationkey") + 1)
    scope = F.struct(span.alias("document_page_span"), F.col("c_name").alias("source"))
    df = t.customer.select("c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    # The table is small beside the texts made of it, so the size of its files says nothing about tasks.
    df = df.repartition(df.count() // ROWS_A_TASK + 1, *df.columns)
    # Each text may hold the digests of those before it.
    open_scope = F.struct(span.alias("document_page_span"), F.when(every(31), s("other")).otherwise(F.col("c_name")).alias("source"))
    df = df.withColumn("body", text(policy_id=s("p"), source_scope=open_scope))
    df = df.withColumn("policy", text(policy_id=s("p"), policy_sha256=F.when(every(7), sha(s("x"))).otherwise(sha(F.col("body"))), source_scope=open_scope))
    df = df.withColumn("benchmark", text(policy_sha256=sha(F.col("body"))))
    content = F.struct(
        F.struct(F.when(every(11), s("part")).otherwise(s("full")).alias("mode")).alias("audit_design"),
        F.struct(s("p8").alias("id")).alias("policy_profile"), scope.alias("source_scope"))
    df = df.withColumns({
        "template": text(policy_semantic_content=content, schema_version=s(proof.TEMPLATE_SCHEMA)),
        "semantic": text(policy_semantic_content=content),
        "original": text(total=key, protocol=F.struct(s("old").alias("source_role_note"))),
        "addendum": text(a=key), "disposition": text(d=key), "draft": text(n=F.col("c_name")), "review": text(n=F.col("c_mktsegment")),
        "page_map": text(m=key), "chunk_manifest": text(c=key), "access_overlay": text(o=key), "access_review": text(v=key),
    })
    correction = F.struct(
        bound(at("disposition"), sha(F.col("disposition"))).alias("independent_source_scope_disposition"),
        sha(F.col("original")).alias("original_measurement_file_sha256"), at("original").alias("original_measurement_path"),
        sha(F.col("addendum")).alias("scope_addendum_file_sha256"), at("addendum").alias("scope_addendum_path"))
    df = df.withColumn("measurement", text(
        metadata_correction=correction, protocol=F.struct(s("new").alias("source_role_note")), total=F.when(every(19), key + 1).otherwise(key)))
    access = F.struct(
        bound(F.when(every(29), s("elsewhere.json")).otherwise(s("access_overlay.json")), sha(F.col("access_overlay"))).alias("overlay"),
        bound(s("access_review.json"), sha(F.col("access_review"))).alias("review"))
    chunks = F.array(F.struct(bound(s("measurement.json"), sha(F.col("measurement"))).alias("source_artifact")))
    df = df.withColumn("study_lock", text(
        audit_mode=s("full"), benchmark_access=access, density_basis=F.struct(chunks.alias("chunks")), policy_profile=s("p8"),
        policy_semantic_sha256=sha(F.col("semantic")), source_scope=scope,
        release=F.struct(F.struct(F.when(every(5), s("draft")).otherwise(s(proof.LINEAGE)).alias("kind")).alias("lineage"),
                         F.concat(s("R"), key).alias("release_id"))))
    columns = {"source_policy": "policy"}
    registered = F.array(*[
        F.struct(s(f"{role}.json").alias("path"), s(schema).alias("schema_version"),
                 (F.when(every(13), sha(s("x"))).otherwise(sha(F.col("review"))) if role == "review" else sha(F.col(columns.get(role, role)))).alias("sha256"),
                 s(stage).alias("stage"))
        for role, (stage, schema) in proof.REGISTERED.items()])
    state_span = F.array(s(1), F.col("c_nationkey") + F.when(every(23), 2).otherwise(1))
    df = df.withColumn("state", text(artifacts=registered, source=F.struct(state_span.alias("document_page_span"))))
    columns |= {"policy_template": "template"}
    roles = [*identity.BASE_ROLES, *identity.ACCESS_ROLES]
    proofs = ["original", "addendum", "disposition", "measurement"]
    artifacts = F.create_map(*[x for r in sorted(roles) for x in (s(r), bound(at(r), sha(F.col(columns.get(r, r)))))])
    evidence = F.filter(
        F.array(*[bound(at(n), sha(F.col(n))) for n in proofs]), lambda b: ~(every(17) & b["path"].endswith("measurement.json")))
    members = F.create_map(*[x for r in sorted(identity.FREEZE_ROLES) for x in (s(f"m/{r}.json"), at(r))])
    archive = F.struct(members.alias("members"), F.concat(s("r/"), key, s("/a.zip")).alias("path"), sha(s("zip")).alias("sha256"))
    parts = {
        "artifact_freeze_commit": s("f" * 40), "artifacts": artifacts, "checkpoints": F.array(archive), "evidence": evidence,
        "methodology_commit": s(PIN), "release_id": F.concat(s("R"), key), "schema_version": s("subject-index-successor-release-v3"),
    }
    # The texts are made once; descriptors, contents, files and members read them.
    df = cut_lineage(df.withColumn("unsealed", text(**parts)))
    seal = F.when(every(37), sha(s("x"))).otherwise(sha(F.col("unsealed")))
    docs = df.select(F.concat(s("r/"), key, s("/release.json")).alias("path"), text(**parts, release_sha256=seal).alias("json"))
    named = F.explode(F.array(*[
        F.struct(at(n).alias("path"), F.col(columns.get(n, n)).alias("json"), s(n).alias("name")) for n in (*roles, *proofs)]))
    texts = df.select(key, named.alias("x")).select("c_custkey", "x.*")
    changed = F.when(every(41) & (F.col("name") == "page_map"), sha(s("x"))).otherwise(sha(F.col("json")))
    files = texts.select("path", changed.alias("sha256")).unionByName(
        df.select(F.concat(s("r/"), key, s("/a.zip")).alias("path"), sha(s("zip")).alias("sha256")))
    held = texts.filter(F.col("name").isin(identity.FREEZE_ROLES)).select(
        F.concat(s("r/"), key, s("/a.zip")).alias("archive"), F.concat(s("m/"), "name", s(".json")).alias("name"), sha(F.col("json")).alias("sha256"))
    return docs, texts.select("path", "json"), files, held


@query("""
WITH faults AS (SELECT * FROM (VALUES (5, 'lineage'), (7, 'source_policy'), (11, 'template_profile'), (13, 'typed_registrations'), (17, 'density_bindings'),
  (19, 'metadata_only'), (23, 'state_span'), (29, 'access_selection'), (31, 'source_policy_scope'), (37, 'self_hash'), (41, 'artifact_bytes')) v(n, fault))
SELECT 'R' || c_custkey AS scope, fault AS "check" FROM customer JOIN faults ON c_custkey % n = 0
""")
def release_audit(t: Tables) -> DataFrame:
    """Every check that fails, for a release per customer audited from its descriptor and texts."""
    docs, contents, files, members = customer_releases(t)
    none = stack([files.select(F.lit("").alias("state"), F.lit("").alias("stage"), F.lit("").alias("schema_version"), "path", "sha256")]).filter("false")
    rows = audit_releases(docs, files, members, PROFILES, none, none, wrappers=WRAPPERS, contents=contents)
    return rows.filter("not ok").select("scope", "check")
