"""Set algebra over keys: closure, partitions, unions, integrity, duplicates.

Two-sided questions are one tagged union and one hash aggregation, so each row
is moved once and hot keys are combined before they are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.ranking import bucketed_position, range_join
from folioscope.functions.numbers import ratio
from folioscope.functions.sides import key_counts
from folioscope.functions.scan import scan
from folioscope.functions.skew import hot_join
from folioscope.functions.text import label_key, label_near_key


def closure(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, as ``missing`` or ``extra``."""
    kind = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra")
    return key_counts(expected, actual, keys).select(*keys, kind.alias("kind")).filter("kind is not null")


def partition_check(assignments: DataFrame, population: DataFrame, keys: list[str]) -> DataFrame:
    """Keys not assigned exactly once: ``overlap``, ``missing`` or ``extra``."""
    kind = (
        F.when(F.col("n_left") == 0, "extra")
        .when(F.col("n_right") == 0, "missing")
        .when(F.col("n_right") > 1, "overlap")
    )
    counts = key_counts(population, assignments, keys)
    return counts.select(*keys, kind.alias("kind"), F.col("n_right").alias("n_assigned")).filter(
        "kind is not null"
    )


def union_accounting(bindings: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Unique keys, bindings, repeated bindings and keys bound more than once."""
    by = by or []
    per_key = bindings.groupBy(*by, *keys).agg(F.count("*").alias("_n"))
    return per_key.groupBy(*by).agg(
        F.count("*").alias("unique_keys"),
        F.sum("_n").cast("bigint").alias("bindings"),
        (F.sum("_n") - F.count("*")).cast("bigint").alias("duplicate_bindings"),
        F.count_if(F.col("_n") > 1).alias("keys_with_overlap"),
    )


def multiset_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number of occurrences differs, with both numbers."""
    return key_counts(a, b, columns).filter("n_left <> n_right")


def complement(population: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Population keys not yet disposed."""
    return population.join(done.select(*keys).distinct(), keys, "left_anti")


def assign_by_first_page(
    evidence: DataFrame, buckets: DataFrame, by: list[str], parent: str, page: str, width: int = 1024
) -> DataFrame:
    """Bucket of each parent's earliest page; ``buckets(*by, bucket, lo, hi)``."""
    first = evidence.groupBy(*by, parent).agg(F.min(page).alias("first_page"), F.count("*").alias("n_evidence"))
    return range_join(first, buckets, by, "first_page", "lo", "hi", width=width, how="left").drop("lo", "hi")


def follow_parent(children: DataFrame, assigned: DataFrame, keys: list[str]) -> DataFrame:
    """Children take the bucket of their parent."""
    return children.join(assigned.select(*keys, "bucket"), keys, "left")


def assign_by_rank(
    rows: DataFrame, by: list[str], group: str, position: str, ranges: DataFrame, width: int = 1024
) -> DataFrame:
    """Bucket of each group by its order of first appearance.

    First positions differ between groups of one ``by`` value, because a
    position holds one row. ``ranges(bucket, lo, hi)`` are ranks.
    """
    first = rows.groupBy(*by, group).agg(F.min(position).alias("first_position"))
    ranked = bucketed_position(first, by, "first_position", "rank")
    return range_join(ranked, ranges, [], "rank", "lo", "hi", width=width, how="left").drop("lo", "hi")


def dangling(child: DataFrame, parent: DataFrame, refs: list[str], keys: list[str]) -> DataFrame:
    """Child rows whose reference names no parent; NULL references dangle.

    Keys are compared first, as counts; child rows are met only by the keys
    that have no parent.
    """
    target = parent.select(*[F.col(k).alias(r) for r, k in zip(refs, keys)]).na.drop(subset=refs)
    lost = key_counts(child, target, refs).filter("n_left > 0 and n_right = 0").drop("n_right")
    return hot_join(child, lost, refs, "n_left")


def facet_subset(facets: DataFrame, tasks: DataFrame, parent: list[str], ids: str) -> DataFrame:
    """Ids a facet names beyond its parent task's ids, per facet.

    ``facets(*parent, facet_id, ids)`` and ``tasks(*parent, ids)`` hold arrays.
    """
    joined = facets.join(tasks.select(*parent, F.col(ids).alias("_allowed")), parent, "left")
    outside = F.array_except(F.col(ids), F.coalesce(F.col("_allowed"), F.array().cast("array<bigint>")))
    return joined.withColumn("n_outside", F.size(outside).cast("bigint")).withColumn(
        "subset_ok", F.col("n_outside") == 0
    ).drop("_allowed")


def facet_subset_bindings(
    facets: DataFrame, tasks: DataFrame, parent: list[str], facet: str, subject: str
) -> DataFrame:
    """The same question on exploded bindings: ids per facet and ids outside the task.

    Each (parent, facet, subject) meets its task's subject in an equi join, so a
    task with very many ids is never one row.
    """
    allowed = tasks.select(*parent, subject, F.lit(True).alias("_in")).distinct()
    joined = facets.select(*parent, facet, subject).distinct().join(allowed, [*parent, subject], "left")
    return joined.groupBy(*parent, facet).agg(
        F.count("*").alias("n_ids"), F.count_if(F.col("_in").isNull()).alias("n_outside")
    ).withColumn("subset_ok", F.col("n_outside") == 0)


def page_scope(nested: DataFrame, evidence: DataFrame, parent: list[str], page: str) -> DataFrame:
    """Nested pages that are not among their parent's evidence pages."""
    allowed = evidence.select(*parent, page).distinct()
    return nested.select(*parent, page).distinct().join(allowed, [*parent, page], "left_anti")


def page_range_scope(nested: DataFrame, owners: DataFrame, parent: list[str], page: str) -> DataFrame:
    """Nested pages outside every range of their owner; ``owners(*parent, lo, hi)``.

    Pages meet ranges on the parent and a bin of the page, so a parent with many
    pages and ranges is spread over its bins.
    """
    pages = nested.select(*parent, page).distinct()
    ranges = owners.select(*parent, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    met = range_join(pages, ranges, parent, page, "_lo", "_hi", how="left")
    return met.filter("_lo is null").select(*parent, page)


def excluded_pages(refs: DataFrame, special: DataFrame, keys: list[str]) -> DataFrame:
    """References to an excluded page; must be empty."""
    return refs.join(special.select(*keys), keys, "left_semi")


def dupes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def near_dupes(labels: DataFrame, by: list[str], label: str, id_col: str) -> DataFrame:
    """Groups of equal labels after normalization.

    ``exact`` groups agree after case, punctuation and spacing are removed.
    ``near`` groups hold the same set of words in at least two exact forms.
    Labels are reduced to two digests where they are read, so no text is moved
    and no pair of labels is formed; copies are counted before they are moved.
    """
    keyed = labels.withColumn("_form", label_key(F.col(label))).select(
        *by, id_col, F.sha2("_form", 256).alias("_exact"), F.sha2(label_near_key(F.col("_form")), 256).alias("_near")
    )
    forms = keyed.groupBy(*by, "_near", "_exact").agg(
        F.count("*").alias("n_labels"), F.min(id_col).alias("first_id")
    )
    exact = forms.filter("n_labels > 1").select(
        *by, F.lit("exact").alias("kind"), F.col("_exact").alias("key"), "n_labels",
        F.lit(1).cast("bigint").alias("n_forms"), "first_id",
    )
    near = (
        forms.groupBy(*by, F.col("_near").alias("key"))
        .agg(
            F.sum("n_labels").cast("bigint").alias("n_labels"),
            F.count("*").alias("n_forms"), F.min("first_id").alias("first_id"),
        )
        .filter("n_forms > 1")
    )
    return exact.unionByName(near.withColumn("kind", F.lit("near")))


def cross_chunk(evidence: DataFrame, subject: list[str], chunk: str) -> DataFrame:
    """Subjects whose evidence spans more than one chunk."""
    pairs = evidence.groupBy(*subject, chunk).agg(F.count("*").alias("_n"))
    return pairs.groupBy(*subject).agg(
        F.count("*").alias("n_chunks"), F.sum("_n").cast("bigint").alias("n_evidence")
    ).filter("n_chunks > 1")


def uncovered(subjects: DataFrame, tasks: DataFrame, key: str, ids: str) -> DataFrame:
    """Subjects no task names; ``tasks.ids`` is an array of subject keys."""
    named = tasks.select(F.explode(ids).alias(key)).distinct()
    return subjects.join(named, key, "left_anti")


def empty_required(df: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Records with a required field that is NULL or blank, and those fields."""
    def blank(c: str) -> Column:
        return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")

    fields = F.array_compact(F.array(*[F.when(blank(c), c) for c in required]))
    return df.select(*keys, fields.alias("empty_fields")).filter(F.size("empty_fields") > 0)


def coverage_ratio(
    reviewed: DataFrame, inventory: DataFrame, by: list[str], keys: list[str]
) -> DataFrame:
    """Reviewed of inventory per entity and lineage; keys outside it do not count."""
    counts = key_counts(inventory, reviewed, [*by, *keys]).filter("n_left > 0")
    return counts.groupBy(*by).agg(
        F.count("*").alias("inventory"), F.count_if(F.col("n_right") > 0).alias("reviewed")
    ).withColumn("reviewed_ratio", ratio(F.col("reviewed"), F.col("inventory")))


def disposition_cube(ledger: DataFrame, dims: list[str], weight: str | None = None) -> DataFrame:
    """Counts by every combination of the dimensions, with all subtotals.

    ``weight`` names a column of counts when the ledger is already counted. The
    finest level is summed first, so the cube copies few rows.
    """
    base = ledger.groupBy(*dims).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    return base.cube(*dims).agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("_n").cast("bigint").alias("n")
    )


def canonicalize(df: DataFrame, keys: list[str], sha: str, position: str) -> DataFrame:
    """One row per key: multiplicity, number of different values, first and last position.

    ``status`` is ``single``, ``identical`` (one obligation, multiplicity kept)
    or ``conflict`` (values differ, to be rejected).
    """
    status = (
        F.when(F.col("n_values") > 1, "conflict").when(F.col("multiplicity") > 1, "identical")
        .otherwise("single")
    )
    per_value = df.groupBy(*keys, sha).agg(
        F.count("*").alias("_n"), F.min(position).alias("_lo"), F.max(position).alias("_hi")
    )
    return per_value.groupBy(*keys).agg(
        F.sum("_n").cast("bigint").alias("multiplicity"), F.count("*").alias("n_values"),
        F.min("_lo").alias("first_position"), F.max("_hi").alias("last_position"),
    ).withColumn("status", status)


def occurrence_positions(df: DataFrame, canonical: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Every position of a repeated key, one row each.

    Kept long on purpose: a key with very many copies never becomes one array.
    """
    repeated = canonical.filter("multiplicity > 1").select(*keys, "status", "multiplicity")
    return hot_join(df.select(*keys, position), repeated, keys, "multiplicity")


def consolidate(tasks: DataFrame, question: list[str], target: str) -> DataFrame:
    """The complete union of targets per question, one row per (question, target)."""
    return tasks.groupBy(*question, target).agg(F.count("*").alias("n_tasks"))


def crosswalk_shape(mapping: DataFrame, left: str, right: str) -> DataFrame:
    """Each pair's shape from both sides' numbers of partners.

    1:1 ``equivalent``, 1:n ``split``, n:1 ``merge``, n:m ``changed_boundary``.
    """
    pairs = mapping.select(left, right).distinct()
    rights = pairs.groupBy(left).agg(F.count("*").alias("n_right")).withColumn("_n", F.col("n_right"))
    lefts = pairs.groupBy(right).agg(F.count("*").alias("n_left")).withColumn("_n", F.col("n_left"))
    shape = (
        F.when((F.col("n_right") == 1) & (F.col("n_left") == 1), "equivalent")
        .when(F.col("n_left") == 1, "split")
        .when(F.col("n_right") == 1, "merge")
        .otherwise("changed_boundary")
    )
    counted = hot_join(hot_join(pairs, rights, [left], "_n"), lefts, [right], "_n")
    return counted.withColumn("shape", shape)


def mapping_counts(mapping: DataFrame, by: list[str], key: str, dest: str) -> DataFrame:
    """Unique keys, unique destinations and destination bindings."""
    pairs = mapping.groupBy(*by, key, dest).agg(F.count("*").alias("_n"))
    return pairs.groupBy(*by).agg(
        F.count_distinct(key).alias("unique_keys"),
        F.count_distinct(dest).alias("unique_destinations"),
        F.count("*").alias("distinct_bindings"),
        F.sum("_n").cast("bigint").alias("bindings"),
    )


def entity_counts(entities: DataFrame, by: list[str]) -> DataFrame:
    return entities.groupBy(*by).agg(F.count("*").alias("n"))


def independence(overlays: DataFrame, reviews: DataFrame, deltas: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Per overlay: other reviewer, exact delta coverage, no candidate exposure.

    ``overlays(overlay_id, author_id, candidate_seen)``, ``reviews(overlay_id,
    reviewer_id, candidate_seen)``, ``deltas`` and ``reviewed`` hold
    (overlay_id, delta_id).
    """
    gaps = closure(deltas, reviewed, ["overlay_id", "delta_id"]).groupBy("overlay_id").agg(
        F.count_if(F.col("kind") == "missing").alias("n_unreviewed"),
        F.count_if(F.col("kind") == "extra").alias("n_unknown"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        overlays.withColumnRenamed("candidate_seen", "author_saw")
        .join(reviews.withColumnRenamed("candidate_seen", "reviewer_saw"), "overlay_id", "left")
        .join(gaps, "overlay_id", "left")
        .select(
            "overlay_id",
            F.coalesce(F.col("author_id") != F.col("reviewer_id"), F.lit(False)).alias("other_reviewer"),
            (~F.coalesce("author_saw", F.lit(True)) & ~F.coalesce("reviewer_saw", F.lit(True))).alias("unexposed"),
            F.coalesce("n_unreviewed", zero).alias("n_unreviewed"),
            F.coalesce("n_unknown", zero).alias("n_unknown"),
        )
        .withColumn("ok", F.expr("other_reviewer and unexposed and n_unreviewed = 0 and n_unknown = 0"))
    )


def chronology(events: DataFrame, rules: dict[str, list[str]], scope: list[str]) -> DataFrame:
    """Dependent events that do not follow their prerequisite.

    ``events(*scope, kind, ts, event_id)``; ``rules`` gives the prerequisites of
    a kind. First times and numbers of events are one row per scope and kind;
    the events meet that row, whatever the size of a scope.
    """
    table = F.create_map(*[
        x for kind, needs in rules.items() for x in (F.lit(kind), F.array(*[F.lit(n) for n in needs]))
    ])
    stats = events.groupBy(*scope, "kind").agg(F.min("ts").alias("ready"), F.count("*").alias("_n"))
    first = stats.select(*scope, F.col("kind").alias("prerequisite"), "ready")
    needed = stats.select(*scope, "kind", "_n", F.explode(table[F.col("kind")]).alias("prerequisite"))
    met = needed.join(first, [*scope, "prerequisite"], "left")
    dependent = events.filter(F.col("kind").isin(*rules)).select(
        *scope, "kind", "ts", "event_id", F.explode(table[F.col("kind")]).alias("prerequisite")
    )
    late = F.col("ready").isNull() | (F.col("ts") <= F.col("ready"))
    return hot_join(dependent, met, [*scope, "kind", "prerequisite"], "_n", "left").filter(late).select(
        *scope, "event_id", "kind", "prerequisite",
        F.when(F.col("ready").isNull(), "no_prerequisite").otherwise("too_early").alias("problem"),
    )


def sequence_breaks(events: DataFrame, scope: list[str], step: str, ts: str) -> DataFrame:
    """Steps of a scope that begin before some earlier step has ended.

    Each step is reduced to its first and last time and compared with the latest
    end of all steps before it, whatever numbers those have.
    """
    spans = events.groupBy(*scope, step).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    ended = scan(spans, scope, [step], maxima={"_before": "_last"})
    return ended.filter("_first < _before").select(*scope, step)


def latest_prerequisite(events: DataFrame, rules: dict[str, list[str]], scope: list[str]) -> DataFrame:
    """The latest prerequisite strictly before each dependent event, NULL where there is none.

    ``events(*scope, kind, ts, event_id)``; one row per event and prerequisite of
    its kind: (*scope, event_id, kind, prerequisite, ready_id, ready_at). Of
    prerequisites at one time the one of the largest id counts. An as-of lookup:
    both kinds lie in one order, and a running maximum carries the last
    prerequisite forward.
    """
    pairs = [(kind, need) for kind, needs in rules.items() for need in needs]
    # At one time dependents come first, so an event is never before itself or its equals.
    roles = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(0).alias("turn")) for k, n in pairs],
                    *[F.struct(F.lit(n).alias("k"), F.lit(n).alias("n"), F.lit(1).alias("turn")) for n in sorted({n for _, n in pairs})])
    mine = F.explode(F.filter(roles, lambda x: x["k"] == F.col("kind")))
    rows = events.filter(F.col("kind").isin(*{x for p in pairs for x in p})).select(*scope, "kind", "ts", "event_id", mine.alias("_r"))
    rows = rows.select(*scope, "kind", "ts", "event_id", F.col("_r.n").alias("prerequisite"), F.col("_r.turn").alias("_turn"))
    rows = rows.withColumn("_ready", F.when(F.col("_turn") == 1, F.struct("ts", "event_id")))
    asof = scan(rows, [*scope, "prerequisite"], ["ts", "_turn", "event_id"], maxima={"_last": "_ready"})
    return asof.filter("_turn = 0").select(
        *scope, "event_id", "kind", "prerequisite", F.col("_last.event_id").alias("ready_id"), F.col("_last.ts").alias("ready_at"))
