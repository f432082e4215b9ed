"""Version diffs, patches and dependency closure.

Records are keyed rows; nested documents are compared as leaves
``(*keys, pointer, value)`` with the value as canonical JSON text, so a missing
field (no leaf) and a JSON null (leaf ``null``) stay different.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.sides import key_counts, side_count, side_value, stack, tag
from folioscope.functions.skew import grown
from folioscope.operators.coverage import closure, dangling, partition_check
from folioscope.operators.identity import LANES, multiset_sha, multiset_sums
from folioscope.session import cut_lineage


def diff_records(old: DataFrame, new: DataFrame, keys: list[str], sha: str) -> DataFrame:
    """``added``, ``removed``, ``updated`` or ``unchanged`` per key, by digest.

    A key one side holds twice is ``duplicate_key``; a record without a digest on
    either side of a pair is ``no_digest``, because its content is not known.
    """
    sides = stack([tag(old, "old", keys, [sha]), tag(new, "new", keys, [sha])]).groupBy(*keys).agg(
        side_value("old", sha).alias("old_sha"), side_value("new", sha).alias("new_sha"),
        side_count("old").alias("_n_old"), side_count("new").alias("_n_new"),
    )
    status = (
        F.when((F.col("_n_old") > 1) | (F.col("_n_new") > 1), "duplicate_key")
        .when(F.col("_n_old") == 0, "added").when(F.col("_n_new") == 0, "removed")
        .when(F.col("old_sha").isNull() | F.col("new_sha").isNull(), "no_digest")
        .when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("updated")
    )
    return sides.withColumn("status", status).drop("_n_old", "_n_new")


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Names of the fields that differ, for keys on both sides; NULL equals NULL.

    Both versions meet in one aggregation that carries each side's record once.
    A key that a side holds twice has no one record to compare: its only field
    is ``*duplicate_key``.
    """
    both = stack([tag(old, "old", keys, fields), tag(new, "new", keys, fields)])
    record = F.struct(*fields)
    sides = both.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == "old", record)).alias("o"),
        F.max(F.when(F.col("_side") == "new", record)).alias("n"),
        side_count("old").alias("_n_old"), side_count("new").alias("_n_new"),
    ).filter("_n_old > 0 and _n_new > 0")
    changed = F.array_compact(F.array(*[
        F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields
    ]))
    twice = (F.col("_n_old") > 1) | (F.col("_n_new") > 1)
    judged = F.when(twice, F.array(F.lit("*duplicate_key"))).otherwise(changed)
    return sides.select(*keys, judged.alias("fields")).filter(F.size("fields") > 0)


# Recursion ends with the documents, not at a number of rows or levels.
_UNBOUNDED = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"}
_LEAVES = """
WITH RECURSIVE _nodes ({keys}, pointer, place, v, opened) AS (
  SELECT {keys}, '', '', try_parse_json({text}), true FROM {{docs}}
  UNION ALL
  SELECT {keys}, concat(pointer, CASE WHEN pos IS NULL THEN '' ELSE concat('/', {step}) END),
         concat(place, CASE WHEN pos IS NULL THEN '' ELSE concat('/', coalesce({name}, cast(pos AS string))) END),
         CASE WHEN pos IS NULL THEN v ELSE value END, pos IS NOT NULL
  FROM _nodes, LATERAL variant_explode_outer({opened}) WHERE opened)
SELECT {keys}, pointer, place, to_json(v) AS value FROM _nodes WHERE NOT opened
"""
_ESCAPED = "replace(replace({}, '~', '~0'), '/', '~1')"


def flatten_json(
    df: DataFrame, keys: list[str], json_text: str, whole_arrays: bool = False, array_key: str | None = None
) -> DataFrame:
    """Leaves (*keys, pointer, value) of JSON documents, flattened to their end.

    A recursive query opens one level of every document a round; what can't be
    opened is a leaf. A document's leaves depend on that document alone, and
    nothing runs while the plan is built. Empty objects and arrays are leaves, and
    a text that is not JSON is one leaf without a value. ``whole_arrays`` keeps
    arrays as one leaf. With ``array_key``, elements that are objects with that
    field step by its value (``/items/id=7/name``) and others by position, so
    reordering changes no pointer; ``place`` then tells where the leaf lies.
    """
    spark = df.sparkSession
    for name, value in _UNBOUNDED.items():
        spark.conf.set(name, value)
    named = _ESCAPED.format("key")
    position = "cast(pos AS string)"
    if array_key:
        own = f"CASE WHEN key IS NULL THEN try_variant_get(value, '$.{array_key}', 'string') END"
        position = f"coalesce(concat('{array_key}=', {_ESCAPED.format(own)}), {position})"
    sql = _LEAVES.format(
        keys=", ".join(f"`{k}`" for k in keys), text=f"`{json_text}`", name=named, step=f"coalesce({named}, {position})",
        opened="CASE WHEN try_variant_get(v, '$', 'array<variant>') IS NULL THEN v END" if whole_arrays else "v",
    )
    leaves = spark.sql(sql, docs=df.select(*keys, json_text))
    return leaves if array_key else leaves.drop("place")


def flatten_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Leaves of typed flat records: one row per field, values as JSON text."""
    def leaf(f: str) -> Column:
        # A record of one field parsed as VARIANT keeps the JSON spelling of its value.
        boxed = F.parse_json(F.to_json(F.struct(F.col(f).alias("x"))))
        value = F.to_json(F.variant_get(boxed, "$.x", "variant"))
        return F.struct(F.lit(f"/{f}").alias("pointer"), F.coalesce(value, F.lit("null")).alias("value"))

    pairs = F.array(*[leaf(f) for f in fields])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.pointer", "p.value")


def diff_fields(old_leaves: DataFrame, new_leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Leaf changes as ``add``, ``remove`` or ``replace`` with before and after.

    A pointer that a side holds twice (elements of one key) is ``ambiguous``.
    """
    by = [*keys, "pointer"]
    sides = stack([tag(old_leaves, "old", by, ["value"]), tag(new_leaves, "new", by, ["value"])])
    sides = sides.groupBy(*by).agg(
        side_value("old", "value").alias("before"), side_value("new", "value").alias("after"),
        side_count("old").alias("_n_old"), side_count("new").alias("_n_new"),
    )
    op = (
        F.when((F.col("_n_old") > 1) | (F.col("_n_new") > 1), "ambiguous")
        .when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "remove")
        .when(F.col("before") != F.col("after"), "replace")
    )
    return sides.withColumn("op", op).filter("op is not null").select(*by, "op", "before", "after")


def apply_patch(base: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Whole-record replacements, additions and removals in one aggregation.

    ``patch`` has the columns of ``base`` and ``action`` (``put`` or ``remove``).
    """
    return compose(base, patch.withColumn("seq", F.lit(1)), keys)


def compose(base: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """Base with ordered patches; the last patch of a key wins.

    ``patches`` has the base columns, ``action`` and ``seq``. One ``max_by`` per
    key replaces a pass per patch, however many components there are. Where the
    last ``seq`` of a key has several different patches, or an unpatched base
    several different records, there is no winner and the job fails with the key;
    ``patch_ties`` lists such patches beforehand.
    """
    columns = base.columns
    rows = stack([
        base.select(*columns, F.lit("put").alias("action"), F.lit(0).cast("bigint").alias("seq")),
        patches.select(*columns, "action", F.col("seq").cast("bigint").alias("seq")),
    ])
    content = F.struct("action", *[c for c in columns if c not in keys])
    rows = rows.withColumn("_digest", F.when(F.col("action") == "remove", F.lit(0)).otherwise(F.xxhash64(content)))
    last = rows.groupBy(*keys).agg(
        F.max_by(content, "seq").alias("r"),
        F.max(F.struct("seq", "_digest"))["_digest"].alias("_most"), F.min(F.struct(-F.col("seq"), "_digest"))["_digest"].alias("_least"),
    )
    tie = F.concat(F.lit("several last patches of one key: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_most") == F.col("_least"), F.col("r.action")).otherwise(F.raise_error(tie))
    return last.filter(checked == "put").select(
        *[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in columns]
    )


def patch_ties(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Patches that ``compose`` can't order: keys with several different patches of one ``seq``."""
    content = F.struct(*[c for c in patches.columns if c not in (*keys, "seq")])
    return patches.groupBy(*keys, "seq").agg(F.count_distinct(content).alias("n_patches")).filter("n_patches > 1")


def patch_overlaps(patches: DataFrame, keys: list[str], component: str) -> DataFrame:
    """Keys more than one component targets."""
    pairs = patches.groupBy(*keys, component).agg(F.count("*").alias("_n"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_components")).filter("n_components > 1")


def resolve_overlap(changes: DataFrame, rules: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Named fields from named components; everything else must be undisputed.

    ``changes(*keys, component, pointer, value)`` holds one value per component
    and pointer, a NULL value being a removal; ``rules(*keys, pointer,
    component)`` names the winner of a disputed pointer. Returns (resolved
    leaves, unresolved pointers). A resolved removal has a NULL value. A pointer
    for which two rules name different components is unresolved.
    """
    by = [*keys, "pointer"]
    winners = rules.groupBy(*by).agg(
        F.max("component").alias("winner"), (F.min("component") != F.max("component")).alias("_two_rules")
    )
    # A struct is never NULL, so a removal counts as a value of its own.
    put = F.struct(F.col("value").alias("value"))
    per_pointer = changes.join(winners, by, "left").groupBy(*by).agg(
        F.count_distinct(put).alias("n_values"), F.max(put).alias("any_value"),
        F.max(F.when(F.col("component") == F.col("winner"), put)).alias("ruled_value"),
        F.bool_or(F.coalesce("_two_rules", F.lit(False))).alias("_two_rules"),
    )
    value = F.coalesce("ruled_value", F.when(F.col("n_values") == 1, F.col("any_value")))
    judged = per_pointer.select(*by, "n_values", F.when(~F.col("_two_rules"), value).alias("put"))
    return (
        judged.filter("put is not null").select(*by, F.col("put.value").alias("value")),
        judged.filter("put is null").select(*by, "n_values"),
    )


def ancestors(pointer: Column) -> Column:
    """The pointers above a JSON pointer, the empty one of the whole document first."""
    steps = F.split(pointer, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def nested_overlaps(changes: DataFrame, keys: list[str], component: str = "component") -> DataFrame:
    """Pointers one component changes above pointers another component changes.

    ``changes(*keys, component, pointer)``; rows (*keys, pointer, component,
    inner_component, n_inner): whoever changes ``pointer`` also decides
    ``n_inner`` pointers below it that ``inner_component`` changes. Every pointer
    carries its own ancestors as keys, so the join is by equality; inner pointers
    are counted by ancestor before they meet the outer one.
    """
    named = changes.filter(F.col("pointer") != "").select(*keys, F.col(component).alias("inner_component"), "pointer").distinct()
    inner = named.withColumn("pointer", F.explode(ancestors(F.col("pointer")))).groupBy(*keys, "pointer", "inner_component").agg(
        F.count("*").alias("n_inner"))
    outer = changes.select(*keys, "pointer", F.col(component).alias("component")).distinct()
    met = outer.join(inner, [*keys, "pointer"]).filter(F.col("component") != F.col("inner_component"))
    return met.select(*keys, "pointer", "component", "inner_component", "n_inner")


def resolve_nested(changes: DataFrame, rules: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``resolve_overlap`` where a pointer also disputes those below it.

    A pointer that another component changes above or below stays unresolved,
    unless one rule each gives all parties of that dispute to one component: the
    rule of the outer pointer then decides for what lies below it, whose own
    changes by others fall. Returns (resolved leaves, unresolved pointers).
    """
    # Changes, disputes and judgements are each read by several joins and made once.
    changes = cut_lineage(changes)
    resolved, unresolved = resolve_overlap(changes, rules, keys)
    by = [*keys, "pointer"]
    winners = rules.groupBy(*by).agg(F.min("component").alias("winner"), F.max("component").alias("_other"))
    winners = winners.filter("winner = _other").drop("_other")
    outer = cut_lineage(nested_overlaps(changes, keys).select(*by).distinct().join(winners, by, "left"))
    # Disputed outer pointers, and below each of them every changed pointer.
    below = changes.filter(F.col("pointer") != "").select(*by, "component").distinct().withColumn(
        "_above", F.explode(ancestors(F.col("pointer"))))
    above = outer.select(*keys, F.col("pointer").alias("_above"), "winner")
    judged = cut_lineage(below.join(above, [*keys, "_above"]).groupBy(*by).agg(
        F.max(F.col("winner").isNull()).alias("_open"), F.bool_or(F.col("component") == F.col("winner")).alias("_own")))
    open_outer = outer.filter("winner is null").select(*by)
    fallen = judged.filter(~F.col("_open") & ~F.coalesce("_own", F.lit(False))).select(*by)
    open_ = judged.filter("_open").select(*by).unionByName(open_outer).distinct()
    kept = resolved.join(open_.unionByName(fallen).distinct(), by, "left_anti")
    counts = changes.groupBy(*by).agg(F.count_distinct(F.struct("value")).alias("n_values"))
    left = counts.join(open_, by, "left_semi").unionByName(
        unresolved.join(open_.unionByName(fallen).distinct(), by, "left_anti").select(*by, "n_values"))
    return kept, left


def roundtrip(before: DataFrame, diffs: DataFrame, proposed: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves where before + diff is not the proposed value; must be empty.

    Also reports a diff whose recorded before-value is not the base's value, and
    pointers that a side holds twice as ``ambiguous``.
    """
    by = [*keys, "pointer"]
    rows = stack([
        tag(before, "before", by, ["value"]), tag(proposed, "proposed", by, ["value"]),
        diffs.select(
            *by, F.col("op"), F.col("before").alias("diff_before"), F.col("after").alias("value"),
            F.lit("diff").alias("_side"),
        ),
    ])
    sides = rows.groupBy(*by).agg(
        side_value("before", "value").alias("base"), side_value("proposed", "value").alias("want"),
        side_value("diff", "value").alias("after"), F.max("op").alias("op"),
        F.max("diff_before").alias("diff_before"),
        *[side_count(side).alias(f"_n_{side}") for side in ("before", "proposed", "diff")],
    )
    got = F.when(F.col("op").isNull(), F.col("base")).otherwise(F.col("after"))
    problem = (
        F.when(F.expr("_n_before > 1 or _n_proposed > 1 or _n_diff > 1"), "ambiguous")
        .when(F.col("op").isNotNull() & ~F.col("diff_before").eqNullSafe(F.col("base")), "before_differs")
        .when(~got.eqNullSafe(F.col("want")), "result_differs")
    )
    return sides.select(*by, problem.alias("problem")).filter("problem is not null")


def guard_before(base: DataFrame, patch: DataFrame, keys: list[str], sha: str) -> DataFrame:
    """Patches with ``valid``: the base record still has the recorded digest.

    A patch without ``before_sha`` adds a record and needs the key to be free.
    One verdict a patch: ``n_base`` counts the base records of its key, and a key
    held twice is no valid base.
    """
    current = base.groupBy(*keys).agg(F.max(sha).alias("_current"), F.count("*").alias("n_base"))
    joined = patch.join(current, keys, "left").withColumn("n_base", F.coalesce("n_base", F.lit(0).cast("bigint")))
    held = F.when(F.col("before_sha").isNull(), F.col("n_base") == 0).otherwise(
        (F.col("n_base") == 1) & F.col("before_sha").eqNullSafe(F.col("_current")))
    return joined.withColumn("valid", held).drop("_current")


def unapproved(changes: DataFrame, approved: DataFrame, keys: list[str]) -> DataFrame:
    """Changed fields without an approval for (keys, action, field).

    ``changes(*keys, action, fields)`` with an array of fields; an added or
    removed record carries the field ``*``.
    """
    rows = changes.withColumn("field", F.explode("fields")).drop("fields")
    by = [*keys, "action", "field"]
    return rows.join(approved.select(*by).distinct(), by, "left_anti")


def preserved_children(
    before: DataFrame, after: DataFrame, keys: list[str],
    declared_removed: DataFrame | None = None, declared_added: DataFrame | None = None,
) -> DataFrame:
    """Child keys lost or gained without a declaration; NULL declarations mean none."""
    sides = [tag(before, "before", keys), tag(after, "after", keys)]
    if declared_removed is not None:
        sides.append(tag(declared_removed, "removed", keys))
    if declared_added is not None:
        sides.append(tag(declared_added, "added", keys))
    counts = stack(sides).groupBy(*keys).agg(
        *[side_count(s).alias(f"n_{s}") for s in ("before", "after", "removed", "added")]
    )
    problem = (
        F.when(F.expr("n_before > 0 and n_after = 0 and n_removed = 0"), "lost")
        .when(F.expr("n_before = 0 and n_after > 0 and n_added = 0"), "unnamed_addition")
        .when(F.expr("n_after > 0 and n_removed > 0"), "removed_but_present")
        .when(F.expr("n_after = 0 and n_added > 0"), "added_but_absent")
    )
    return counts.select(*keys, problem.alias("problem")).filter("problem is not null")


def dependency_closure(
    changed: DataFrame, relationships: DataFrame, tasks: DataFrame, facets: DataFrame
) -> dict[str, DataFrame]:
    """Edges, tasks and task-facet bindings one step away from changed subjects.

    ``changed(subject_id)``; edges match by either endpoint as two equi joins,
    each edge once. ``tasks(task_id, subject_id)`` and ``facets(task_id,
    facet_id, subject_id)`` are exploded bindings.
    """
    ids = changed.select("subject_id")
    source = relationships.join(ids.withColumnRenamed("subject_id", "source_subject_id"), "source_subject_id", "left_semi")
    rest = relationships.join(ids.withColumnRenamed("subject_id", "source_subject_id"), "source_subject_id", "left_anti")
    target = rest.join(ids.withColumnRenamed("subject_id", "target_subject_id"), "target_subject_id", "left_semi")
    touched = tasks.join(ids, "subject_id", "left_semi").select("task_id").distinct()
    bound = facets.join(ids, "subject_id", "left_semi").select("task_id", "facet_id").distinct()
    return {
        "relationships": source.unionByName(target.select(*source.columns)),
        "tasks": touched,
        "facets": bound,
    }


def page_opportunities(evidence: DataFrame, unit: list[str]) -> DataFrame:
    """Scoring units of evidence: several facts on one page are one unit."""
    return evidence.groupBy(*unit).agg(F.count("*").alias("n_evidence"))


def opportunity_diff(old: DataFrame, new: DataFrame, unit: list[str], member: str) -> DataFrame:
    """Units ``added``, ``removed``, ``changed`` or ``unchanged`` by their members.

    Membership is compared member by member and then counted per unit; no
    member list is ever gathered.
    """
    per_member = key_counts(old, new, [*unit, member])
    units = per_member.groupBy(*unit).agg(
        F.count_if(F.col("n_left") > 0).alias("n_before"),
        F.count_if(F.col("n_right") > 0).alias("n_after"),
        F.count_if((F.col("n_left") > 0) & (F.col("n_right") == 0)).alias("n_lost"),
        F.count_if((F.col("n_left") == 0) & (F.col("n_right") > 0)).alias("n_gained"),
    )
    status = (
        F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed")
        .when((F.col("n_lost") > 0) | (F.col("n_gained") > 0), "changed").otherwise("unchanged")
    )
    return units.withColumn("status", status)


def edge_conflicts(
    edges: DataFrame, inverse: dict[str, str], keys: tuple[str, str, str] = ("source", "type", "target")
) -> DataFrame:
    """Reversed duplicates and pairs with several types.

    ``reversed``: (a, t, b) and (b, t', a) with t' the inverse of t, found by
    looking up the expected reverse edge, reported once per edge.
    ``types``: one ordered pair under more than one type.
    ``inverse`` gives the inverse of each type that has one.
    """
    a, t, b = keys
    once = edges.groupBy(a, t, b).agg(F.count("*").alias("n_bindings"))
    table = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
    expected = once.select(
        F.col(b).alias(a), table[F.col(t)].alias(t), F.col(a).alias(b), F.col(t).alias("_own")
    )
    # A self-loop of a symmetric type is its own reverse, not a second edge.
    expected = expected.filter(F.col(t).isNotNull() & ~((F.col(a) == F.col(b)) & (F.col(t) == F.col("_own")))).drop("_own").distinct()
    reversed_edges = once.join(expected, [a, t, b], "left_semi").select(
        a, b, F.lit("reversed").alias("kind"), F.col(t).alias("detail")
    )
    several = once.groupBy(a, b).agg(F.count("*").alias("n")).filter("n > 1").select(
        a, b, F.lit("types").alias("kind"), F.col("n").cast("string").alias("detail")
    )
    return reversed_edges.unionByName(several)


def retire(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), keys, "left_anti")


def retire_check(before: DataFrame, after: DataFrame, ids: DataFrame, keys: list[str], sha: str) -> DataFrame:
    """Differences between before and after that retirement does not explain."""
    diff = diff_records(before, after, keys, sha).filter("status <> 'unchanged'")
    named = ids.select(*keys, F.lit(True).alias("_named")).distinct()
    joined = diff.join(named, keys, "left")
    fine = (F.col("status") == "removed") & F.coalesce("_named", F.lit(False))
    return joined.filter(~fine).select(*keys, "status")


def lineage_closure(old: DataFrame, mapping: DataFrame, new: DataFrame) -> DataFrame:
    """Old ids without a disposition and mapped new ids that do not exist.

    ``old(id)``, ``mapping(old_id, new_id, disposition)`` with NULL ``new_id``
    for a removal, ``new(id)``.
    """
    disposed = mapping.select(F.col("old_id").alias("id"))
    undisposed = closure(old.select("id"), disposed.distinct(), ["id"]).select(
        "id", F.when(F.col("kind") == "missing", "undisposed").otherwise("unknown_old").alias("problem")
    )
    targets = mapping.filter("new_id is not null").select(F.col("new_id").alias("ref")).distinct()
    lost = dangling(targets, new, ["ref"], ["id"]).select(
        F.col("ref").alias("id"), F.lit("target_absent").alias("problem")
    )
    return undisposed.unionByName(lost)


def lineage_chains(mapping: DataFrame) -> DataFrame:
    """(id, final_id, status, n_paths, n_steps): what became of every id after all versions.

    ``mapping(old_id, new_id)`` holds the steps of all versions, NULL ``new_id``
    for a removal; an id may split into several and several may merge into one.
    ``current`` ids have no further step. ``n_paths`` counts the ways that lead
    from one to the other (NULL beyond 64 bits), ``n_steps`` the longest. Steps
    are composed with themselves, so a chain of n versions takes log2(n) rounds;
    ways that have ended are not moved again. Once no way meets an ended one, all
    that is left runs into a ``cycle``, with an id of it as the final one: rounds
    then touch only ids that run into cycles and go on until the ids that are
    reached no longer become fewer. Joins are shuffled at every size, because the
    steps may be many times what Spark guesses from the files below them.
    """
    steps = cut_lineage(mapping.select(F.col("old_id").alias("id"), F.col("new_id").alias("final_id")).distinct())
    going = cut_lineage(steps.select(F.col("id").alias("_id")).distinct())
    n_ids = going.count()
    one = F.lit(1).cast("bigint")
    now = cut_lineage(steps.join(grown(going), F.col("final_id") == F.col("_id"), "left").select(
        "id", "final_id", one.alias("n_paths"), one.alias("n_steps"), F.col("_id").isNotNull().alias("open")))

    def summed(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(
            F.when(F.count("n_paths") == F.count("*"), F.try_sum("n_paths")).alias("n_paths"), F.max("n_steps").alias("n_steps"))

    def parted(rows: DataFrame) -> tuple[list[DataFrame], DataFrame, bool]:
        """What has ended, if anything has, what goes on, and whether anything does."""
        open_, n = rows.agg(F.count_if("open"), F.count("*")).first()
        return [rows.filter("not open").drop("open")] if open_ < n else [], rows.filter("open").drop("open"), open_ > 0

    # What has ended is kept as it is; a round moves only the ways that still go on.
    ended, going_on, left = parted(now)
    reach, met_end, reached = 1, True, None
    while reach <= n_ids and left:
        on = going_on.withColumn("open", F.lit(True))
        if met_end:
            on = reduce(DataFrame.unionByName, [f.withColumn("open", F.lit(False)) for f in ended], on)
        else:
            # No way that is left ever meets an end. The ids reached in more steps are
            # among those reached in fewer; once they are as many, all lie on the way
            # round or between cycles.
            before, reached = reached, cut_lineage(going_on.select("final_id").distinct()).count()
            if reached == before:
                break
        on = on.select(F.col("id").alias("_id"), F.col("final_id").alias("_to"), F.col("n_paths").alias("_p"),
                       F.col("n_steps").alias("_s"), "open")
        moved = going_on.join(grown(on), F.col("final_id") == F.col("_id")).select(
            "id", F.col("_to").alias("final_id"), F.try_multiply("n_paths", "_p").alias("n_paths"),
            F.expr("least(n_steps + _s, 4611686018427387903)").alias("n_steps"), "open")
        now = cut_lineage(summed(moved, ["id", "final_id", "open"]))
        found, going_on, left = parted(now)
        met_end = met_end and bool(found)
        ended += found
        reach *= 2
    # An id may meet the same end in several rounds, by ways of different lengths.
    closed = [summed(reduce(DataFrame.unionByName, ended), ["id", "final_id"]).withColumn("open", F.lit(False))] if ended else []
    now = reduce(DataFrame.unionByName, closed, going_on.withColumn("open", F.lit(True)))
    status = F.when(F.col("open"), "cycle").when(F.col("final_id").isNull(), "removed").otherwise("current")
    ends = now.withColumn("status", status).select("id", "final_id", "status", "n_paths", "n_steps")
    # On a cycle the number of steps taken says nothing; one of its ids stands for it.
    rings = ends.filter("status = 'cycle'").groupBy("id", "status").agg(F.min("final_id").alias("final_id")).select(
        "id", "final_id", "status", F.lit(None).cast("bigint").alias("n_paths"), F.lit(None).cast("bigint").alias("n_steps"))
    return ends.filter("status <> 'cycle'").unionByName(rings)


def proposal_partition(ledger: DataFrame, population: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts per disposition, and the keys not disposed exactly once."""
    counts = ledger.groupBy("disposition").agg(F.count("*").alias("n"))
    return counts, partition_check(ledger, population, keys)


def population_accounting(
    before: DataFrame, after: DataFrame, by: list[str], weight: str, ids: list[str] | None = None
) -> DataFrame:
    """Records and weights per group before and after, and whether they are equal.

    With ``ids``, the columns that name a record, also the records only one side
    holds and a digest of each side's records with their weights (see
    ``multiset_state``): equal populations hold the same records, not only as
    many. A NULL group is a group.
    """
    rows = stack([tag(before, "before", [*by, *(ids or [])], [weight]), tag(after, "after", [*by, *(ids or [])], [weight])])

    def weighed(side: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_side") == side, F.col(weight))), F.lit(0)).cast("bigint")

    sides = ("before", "after")
    if ids is None:
        out = rows.groupBy(*by).agg(*[side_count(s).alias(f"n_{s}") for s in sides], *[weighed(s).alias(f"weight_{s}") for s in sides])
        return out.withColumn("equal", F.expr("n_before = n_after and weight_before = weight_after"))
    digest = F.sha2(F.to_json(F.struct(*ids, weight), {"ignoreNullFields": "false"}), 256)
    per_record = rows.withColumn("_sha", digest).groupBy(*by, *ids, "_sha").agg(
        *[side_count(s).alias(f"n_{s}") for s in sides], *[weighed(s).alias(f"weight_{s}") for s in sides])
    per_id = per_record.groupBy(*by, *ids).agg(
        *[F.sum(f"{c}_{s}").alias(f"{c}_{s}") for c in ("n", "weight") for s in sides],
        *[x for s in sides for x in multiset_sums("_sha", f"n_{s}", f"_{s}")])
    lost = F.greatest(F.lit(0), F.expr("n_before - n_after"))
    gained = F.greatest(F.lit(0), F.expr("n_after - n_before"))
    out = per_id.groupBy(*by).agg(
        *[F.sum(f"{c}_{s}").cast("bigint").alias(f"{c}_{s}") for c in ("n", "weight") for s in sides],
        F.sum(lost).cast("bigint").alias("n_lost"), F.sum(gained).cast("bigint").alias("n_gained"),
        *[F.sum(f"_{s}{i}").alias(f"_{s}{i}") for s in sides for i in range(LANES)],
    )
    named = out.withColumns({f"sha_{s}": multiset_sha(f"n_{s}", f"_{s}") for s in sides})
    return named.drop(*[f"_{s}{i}" for s in sides for i in range(LANES)]).withColumn("equal", F.expr("sha_before = sha_after"))


def metadata_only(
    old_leaves: DataFrame, new_leaves: DataFrame, keys: list[str],
    dropped: list[str], restored: list[str],
) -> DataFrame:
    """Whether a revision changed nothing but named metadata, per document.

    ``dropped`` pointers may be added with everything under them; ``restored``
    pointers may be replaced. Any other change fails the document.
    """
    def under(prefixes: list[str]) -> Column:
        ok = F.lit(False)
        for p in prefixes:
            ok = ok | (F.col("pointer") == p) | F.col("pointer").startswith(f"{p}/")
        return ok

    changes = diff_fields(old_leaves, new_leaves, keys)
    fine = ((F.col("op") == "add") & under(dropped)) | (
        (F.col("op") == "replace") & F.col("pointer").isin(restored)
    )
    judged = changes.groupBy(*keys).agg(
        F.count("*").alias("n_changes"), F.count_if(~fine).alias("n_other_changes")
    )
    # Every document has a row, so one without a change is seen to be examined.
    none = F.lit(0).cast("bigint")
    every = stack([old_leaves.select(*keys), new_leaves.select(*keys)]).distinct()
    return every.join(grown(judged), keys, "left").withColumns({
        "n_changes": F.coalesce("n_changes", none), "n_other_changes": F.coalesce("n_other_changes", none),
    }).withColumn("metadata_only", F.col("n_other_changes") == 0)
