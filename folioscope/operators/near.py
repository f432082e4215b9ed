"""Near duplicates: texts that share most of their words, labels one letter apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.graph import components
from folioscope.functions.runs import counted_bins, rarest, signed
from folioscope.functions.skew import grown, hot_join
from folioscope.functions.text import label_key
from folioscope.session import cut_lineage, written

ROWS, BANDS = 5, 9  # bands only link copies early, so that groups of them meet once; what they miss is found by prefixes
RANKS = 1 << 18  # items are counted in as many bins


def shingles(words: Column, n: int) -> Column:
    """Distinct hashes of all runs of ``n`` words; a shorter text is one run."""
    def runs(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
            F.size(w) < n, F.array(F.xxhash64(w))
        ).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n))))

    # The variable of an outer lambda holds the words, so they are not split again for each run.
    return F.array_distinct(F.get(F.transform(F.array(words), runs), F.lit(0)))


def _classes(rows: DataFrame, forms: DataFrame, by: list[str]) -> DataFrame:
    """One row per label: its class, the smallest id in it, and the class's number of forms.

    ``rows(*by, id, form)`` holds all labels (NULL form: none to compare),
    ``forms(form, rep, n, root)`` the different ones, linked ones with one root.
    """
    placed = cut_lineage(forms)
    classes = placed.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("n_forms"))
    named = hot_join(placed, classes.withColumn("_c", F.lit(1)), ["root"], "_c").select("form", "class_id", "n_forms", "n")
    out = hot_join(rows.filter("form is not null"), named, ["form"], "n").select(*by, "id", "class_id", "n_forms")
    alone = rows.filter("form is null").select(*by, "id", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("n_forms"))
    return out.unionByName(alone)


def _rooted(forms: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``forms`` with ``root``: the smallest key that the edges connect with the form's, or its own."""
    roots = components(edges).select(F.col("node").alias("_node"), "root")
    return forms.join(grown(roots), F.col(key) == F.col("_node"), "left").withColumn("root", F.coalesce("root", key)).drop("_node")


def _alike(pairs: DataFrame, sets: DataFrame, by: list[str], similar: tuple[int, int]) -> DataFrame:
    """The ``pairs(a, b, ...)`` of one group whose sets are at least as ``similar``, compared exactly."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("no").alias(name), F.col("items").alias(f"_{name}"), *[F.col(c).alias(f"_{name}{i}") for i, c in enumerate(by)])

    met = pairs.join(grown(side("a")), "a").join(grown(side("b")), "b")
    both = F.size(F.array_intersect("_a", "_b"))
    enough = both * similar[1] >= (F.size("_a") + F.size("_b") - both) * similar[0]
    for i in range(len(by)):
        enough = enough & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    return met.filter(enough).select(*pairs.columns)


def _unlinked(sets: DataFrame, rooted: DataFrame, by: list[str], similar: tuple[int, int]) -> DataFrame:
    """(a, b, root_a, root_b): all pairs of ``sets(no, items, *by)`` that may be ``similar`` and have two roots in ``rooted(no, root)``.

    The items of a set are ordered, rarest first by the counts of their bins.
    The first item that two similar sets share then lies so early in both that what
    follows it is still enough for the similarity (prefix and position filters), so
    each set is found by its first items alone and no similar pair is left out. The
    counts of the bins are all that the driver holds; they decide how many pairs
    meet, not which are found.
    """
    top, base = similar
    counts = sets.select(F.explode("items").alias("x")).groupBy(F.col("x").bitwiseAND(F.lit(RANKS - 1)).alias("bin")).agg(F.count("*").alias("n"))
    first = rarest(F.col("items"), counted_bins(counts, RANKS), top, base)
    found = sets.select("no", *by, F.size("items").alias("size"), first.alias("first"))
    found = cut_lineage(found.join(grown(rooted.select("no", "root")), "no"))
    shown = found.select("no", "root", "size", *by, F.posexplode("first").alias("at", "item")).select(
        "no", "root", "size", "at", F.xxhash64("item", *by).alias("key"))
    # An item all of whose sets are linked already has nothing to add.
    keys = cut_lineage(shown.groupBy("key").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).filter("_l < _h").select("key"))
    live = cut_lineage(shown.join(grown(keys), "key", "left_semi"))
    small = live.select("key", *[F.col(c).alias(f"{c}_a") for c in ("no", "root", "size", "at")])
    large = live.select("key", *[F.col(c).alias(f"{c}_b") for c in ("no", "root", "size", "at")])
    need = (F.col("size_a") + F.col("size_b")) * top  # of items in common, times top + base
    met = small.join(grown(large), "key").filter(
        "root_a <> root_b and (size_a < size_b or size_a = size_b and no_a < no_b)").filter(
        (F.col("size_a") * base >= F.col("size_b") * top)
        & ((F.col("size_a") - F.col("at_a")) * (top + base) >= need) & ((F.col("size_b") - F.col("at_b")) * (top + base) >= need))
    return met.select(F.col("no_a").alias("a"), F.col("no_b").alias("b"), "root_a", "root_b").distinct()


def near_texts(
    labels: DataFrame, by: list[str], label: str, id_col: str, words: int = 5, similar: tuple[int, int] = (4, 5)
) -> DataFrame:
    """(*by, id, class_id, n_forms): classes of texts whose runs of ``words`` words overlap.

    Texts are compared inside their ``by`` group after case, punctuation and
    spacing are removed. Two are linked when the Jaccard similarity of their sets
    of runs is at least ``similar`` (numerator, denominator); a class is whatever
    links connect, and no link is missed. Equal sets are one form before anything
    is compared. Forms that share a band of minimum hashes meet the band's two
    outermost forms, so a group of n near copies costs n comparisons a band. All
    pairs that are not connected by then and share one of their rarest runs meet
    too (``_unlinked``), and each comparison is exact. A text without words is a
    class of its own.
    """
    form = label_key(F.coalesce(F.col(label), F.lit("")))
    split = F.when(form == "", F.array().cast("array<string>")).otherwise(F.split(form, " "))
    sets = labels.select(*by, F.col(id_col).alias("id"), shingles(split, words).alias("items"))
    # The digest of a set holds its group, so forms of two groups never meet. It is
    # made before the cut, because the last joins read the forms again.
    head = F.concat(*[F.concat(F.to_json(F.struct(c)), F.lit(",")) for c in by]) if by else F.lit("")
    rows = written(sets.select("*", signed(head, F.col("items"), ROWS, BANDS).alias("_s")).select(
        *by, "id", "items", F.col("_s.digest").alias("form"), "_s.bands"))
    # The number of a form is stored with it, so it stays what it is.
    sets = written(rows.filter("form is not null").groupBy("form").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value(F.struct("items", "bands")).alias("_s"),
        *[F.any_value(c).alias(c) for c in by]).select(
        F.monotonically_increasing_id().alias("no"), "form", "rep", "n", "_s.items", "_s.bands", *by))
    keyed = sets.select("no", F.explode("bands").alias("band"), *by).select("no", F.xxhash64("band", *by).alias("band"))
    outer = keyed.groupBy("band").agg(
        F.min("no").alias("_low"), F.max("no").alias("_high"), F.count("*").alias("_n")).filter("_n > 1")
    met = hot_join(keyed, outer, ["band"], "_n")
    pairs = met.select(F.col("no").alias("a"), F.explode(F.array("_low", "_high")).alias("b")).filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    early = cut_lineage(_rooted(sets.select("no", "form", "rep", "n"), "no", _alike(pairs, sets, by, similar)))
    late = _alike(_unlinked(sets, early, by, similar), sets, by, similar)
    joined = components(late.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(
        F.col("node").alias("root"), F.col("root").alias("_root"))
    placed = early.join(grown(joined), "root", "left").select("form", "rep", "n", F.coalesce("_root", "root").alias("root"))
    return _classes(rows.select(*by, "id", "form"), placed, by)


def near_spellings(labels: DataFrame, by: list[str], label: str, id_col: str) -> DataFrame:
    """(*by, id, class_id, n_forms): classes of labels connected by single changed letters.

    Labels are compared inside their ``by`` group after case, punctuation and
    spacing are removed; two are linked when one inserted, deleted or replaced
    character turns one into the other. Every link is found: labels that agree
    but for the character at one position share that position's deletion key,
    and all labels under such a key are one replacement apart, so each meets the
    smallest only; a label one character longer has the shorter one among its
    deletions. The keys of a label take the square of its length, so this is for
    labels, not for texts. A label without letters or digits is a class of its own.
    """
    form = label_key(F.col(label))
    rows = labels.select(*by, F.col(id_col).alias("id"), F.when(form != "", form).alias("text"))
    name = F.to_json(F.struct(*by, "text"))  # forms of two groups never meet
    rows = rows.withColumn("form", F.when(F.col("text").isNotNull(), name))
    forms = cut_lineage(rows.filter("form is not null").groupBy("form").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.any_value("text").alias("text"),
        *[F.any_value(c).alias(c) for c in by]))
    at = F.explode(F.sequence(F.lit(1), F.length("text")))
    keys = forms.select("form", "text", *by, at.alias("_at")).withColumn(
        "_key", F.xxhash64(*by, F.expr("concat(substring(text, 1, _at - 1), substring(text, _at + 1))")))
    same = W.partitionBy("_key", "_at")
    replaced = keys.select("form", "text", F.min(F.struct("form", "text")).over(same).alias("_first")).filter("form <> _first.form")
    shorter = forms.select(F.col("form").alias("_form"), F.col("text").alias("_text"), F.xxhash64(*by, "text").alias("_key"))
    grown = keys.select("form", "text", "_key").join(shorter, "_key")
    links = replaced.select(F.col("form").alias("a"), "text", F.col("_first.form").alias("b"), F.col("_first.text").alias("_text")).unionByName(
        grown.select(F.col("form").alias("a"), "text", F.col("_form").alias("b"), "_text"))
    # Keys are hashes, so each link is verified.
    edges = links.filter(F.levenshtein("text", "_text", 1) == 1).select("a", "b").distinct()
    return _classes(rows.drop("text"), _rooted(forms.select("form", "rep", "n"), "form", edges), by)
