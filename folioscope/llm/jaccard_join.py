"""N-gram Jaccard self-join by chosen paths.

A text is the set of its five-word shingles. Texts of equal sets are one class
before anything is compared. Every set has 64 minimum hashes; two sets agree on
one of them with their Jaccard similarity. A run starts with all sets in one
node; a node of more than ``LIMIT`` sets draws coordinates, each with the chance
1 / (threshold * 64) and at least one, and a set goes to the child of each drawn
coordinate and its own value there. Two similar sets stay together with the
chance of their similarity per level. Small nodes are compared by brute force on
a sketch. A node still too large after ``DEPTH`` levels is compared in blocks, so
nothing is cut off. Runs repeat until the miss of a pair at the threshold is
below 1 - ``RECALL``.

Nodes only yield candidates, as trees of at most n - 1 edges. The sets inside a
candidate component are then compared exactly, in blocks of bounded size; links,
their number per set, and the classes come from these exact comparisons.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import graph
from folioscope.llm.shared import cut, stored, table
from folioscope.llm.words import LETTER_DIGIT, LOWER, U64, Words, mixed, prefix, ranges, slices

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99
COORDINATES = 64
LIMIT = 1024
DEPTH = 3
# Sketches agree less than sets by chance: four standard deviations of 64 coordinates.
SKETCH_THRESHOLD = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
BLOCK = 256
SALTS = 16


def n_runs(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is missed at most with 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


# ---------------------------------------------------------------- sets
_MULTIPLY = (mixed(np.arange(1, COORDINATES + 1).astype(U64)) | U64(1))
_ADD = mixed(np.arange(1001, 1001 + COORDINATES).astype(U64))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts, where each text's begin)."""
    words = Words(column, LETTER_DIGIT, LOWER)
    hashes = words.hashes()
    first, shingle = words.windows(hashes, SHINGLE)
    doc = words.doc[first]
    short = np.flatnonzero((words.n_words > 0) & (words.n_words < SHINGLE))
    if len(short):  # a short text is one shingle of all its words
        whole = ranges(prefix(hashes), words.first[short], words.first[short + 1]) ^ U64(SHINGLE)
        doc, shingle = np.concatenate([doc, short]), np.concatenate([shingle, whole])
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    doc, shingle = doc[new], shingle[new]
    return shingle, np.searchsorted(doc, np.arange(len(column) + 1))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, set digest, minimum hashes) of each text; null digest without words."""
    for batch in slices(batches, "text"):
        shingles, bounds = shingle_sets(batch.column("text"))
        size = np.diff(bounds)
        full = size > 0
        minima = np.zeros((int(full.sum()), COORDINATES), np.int32)
        at = bounds[:-1][full]
        for i in range(COORDINATES):
            if len(at):
                h = ((shingles * _MULTIPLY[i] + _ADD[i]) >> U64(32)).astype(np.uint32)
                minima[:, i] = np.minimum.reduceat(h, at).view(np.int32)
        digests = [_digest(shingles[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rows = iter(minima)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(digests, pa.binary()),
            pa.array([next(rows) if f else None for f in full], pa.list_(pa.int32())),
        ], ["doc_id", "digest", "minima"])


def join_unique(many: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``many`` with the columns of its key's row in ``one``; a hot key is dealt to SALTS tasks."""
    dealt = many.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)).cast("int"))
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


# ---------------------------------------------------------------- paths
def drawn(nodes: DataFrame) -> DataFrame:
    """(node, i): the coordinates of each node, each with its chance, the one of the smallest hash always."""
    most = 1 << 20
    hashed = nodes.select("node", F.transform(
        F.sequence(F.lit(0), F.lit(COORDINATES - 1)),
        lambda i: F.struct(F.pmod(F.xxhash64("node", i), F.lit(most)).alias("h"), i.alias("i")),
    ).alias("all"))
    least = hashed.withColumn("least", F.array_min("all")["i"])
    chance = int(most / (THRESHOLD * COORDINATES))
    return least.select("node", F.transform(
        F.filter("all", lambda x: (x["h"] < chance) | (x["i"] == F.col("least"))), lambda x: x["i"]
    ).alias("drawn"))


def root_rows(sets: DataFrame, runs: int) -> DataFrame:
    """(digest, node) of the first level: all runs start at a node that holds every set."""
    # As many rows as runs.
    draws = drawn(sets.sparkSession.range(runs).select(F.col("id").alias("node"))).collect()
    arms = F.array(*[
        F.xxhash64(F.lit(r.node), F.lit(i), F.get("minima", F.lit(i))) for r in draws for i in r.drawn
    ])
    return sets.select("digest", F.explode(arms).alias("node"))


def children(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """(digest, node) one level down, from rows (digest, node, minima) of nodes that split."""
    met = join_unique(rows, draws, "node").withColumn("i", F.explode("drawn"))
    return met.select("digest", F.xxhash64("node", "i", F.get("minima", F.col("i"))).alias("node"))


def _same(matrix: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (matrix == row).sum(axis=1)


def roots(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """Smallest member of each item's group under the pairs."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches in the order of the keys."""
    held, before = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*values, strict=True))
        first = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i] != rows[first]:
                if held and rows[first] != before:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(first, i - first))
                before, first = rows[first], i
    if held:
        yield pa.Table.from_batches(held)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees (root, member) over the pairs of a node whose sketches agree enough."""
    need = math.ceil(SKETCH_THRESHOLD * COORDINATES)
    out_a, out_b = [], []
    for group in _groups(batches, ["node", "i", "j"]):
        digests = group.column("digest").to_pylist()
        order = sorted(range(len(digests)), key=digests.__getitem__)
        digests = [digests[k] for k in order]
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)[order]
        pairs = []
        for k in range(len(digests) - 1):
            hit = np.flatnonzero(_same(sketch[k + 1 :], sketch[k]) >= need)
            pairs.extend((k, k + 1 + int(h)) for h in hit)
        for member, root in enumerate(roots(len(digests), pairs)):
            if digests[root] != digests[member]:
                out_a.append(digests[root])
                out_b.append(digests[member])
        if len(out_a) > 50_000:
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})
            out_a, out_b = [], []
    if out_a:
        yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})


def blocked(rows: DataFrame, size: str, key: str, block: int) -> DataFrame:
    """Rows of each group dealt to blocks, and a copy for each pair (i, j) of blocks it takes part in."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(key), n).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_other")


def candidate_edges(sets: DataFrame, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """(a, b): trees over candidate pairs of all runs; ``sets`` has digest and minima, one row per set."""
    sets = sets.select("digest", "minima")
    sketch = sets.select("digest", F.expr("unhex(array_join(transform(minima, m -> lpad(hex(m & 255), 2, '0')), ''))").alias("sketch"))
    nodes, edges = root_rows(sets, n_runs(depth=depth)), None
    for level in range(1, depth + 1):
        nodes = stored(nodes, "paths")
        counts = nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        met = cut(join_unique(nodes, counts, "node"))
        last = level == depth
        small = met if last else met.filter(F.col("n") <= limit)
        compared = blocked(small.join(sketch, "digest"), "n", "digest", limit).select("node", "i", "j", "digest", "sketch")
        ordered = compared.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
        found = ordered.mapInArrow(_candidates, "a binary, b binary")
        edges = found if edges is None else edges.union(found)
        large = met.filter(F.col("n") > limit)
        if last or large.isEmpty():
            break
        draws = drawn(large.select("node").distinct())
        nodes = children(large.join(sets, "digest").select("digest", "node", "minima"), draws)
    return edges


# ---------------------------------------------------------------- components
def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task as (smallest, member) trees, some tens of thousands at a time."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        names = sorted({*a, *b})
        number = {name: i for i, name in enumerate(names)}
        tops = roots(len(names), [(number[x], number[y]) for x, y in zip(a, b, strict=True)])
        pairs = [(names[t], names[i]) for i, t in enumerate(tops) if t != i]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(member, root) of all connected components; the root of a component, its smallest member, has no row.

    Tasks contract their own edges to trees before any row moves; stars then
    end in one round of joins.
    """
    trees = edges.select("a", "b").mapInArrow(_contracted, "a binary, b binary")
    return graph.components(trees).filter("node <> root").withColumnRenamed("node", "member")


# ---------------------------------------------------------------- exact links
def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to sets; a text whose digest is not the wanted one is another row of the same id."""
    for batch in slices(batches, "text"):
        shingles, bounds = shingle_sets(batch.column("text"))
        wanted = batch.column("digest").to_pylist()
        sets = [shingles[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        fits = [len(s) > 0 and _digest(s) == w for s, w in zip(sets, wanted, strict=True)]
        out = batch.filter(pa.array(fits, pa.bool_())).select(["root", "digest", "n"])
        yield out.append_column("shingles", pa.array([s.tobytes() for s, f in zip(sets, fits, strict=True) if f], pa.binary()))


def common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    if len(sets) < 6:
        out = np.zeros((len(sets), len(sets)), np.int64)
        for a in range(len(sets)):
            out[a, a] = len(sets[a])
            for b in range(a):
                out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, slot, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # shingles of one set alone are in no intersection
    shared = (count > 1)[slot]
    owner, slot = owner[shared], number[slot[shared]]
    order = np.argsort(slot, kind="stable")
    owner, slot = owner[order], slot[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(slot[-1]) + 1 if len(slot) else 0, columns):
        a, b = np.searchsorted(slot, (first, first + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], slot[a:b] - first] = 1
        out += part @ part.T
    out = np.rint(out).astype(np.int64)
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, number of links, smallest set of its tree) of one pair of blocks."""
    out: list[tuple[bytes, int, bytes]] = []

    def flushed():
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
            ["digest", "n_links", "root"],
        )

    for group in _groups(batches, ["root", "i", "j"]):
        within = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        own = dict(zip(group.column("digest").to_pylist(), group.column("_own").to_pylist(), strict=True))
        raw = dict(zip(group.column("digest").to_pylist(), group.column("shingles").to_pylist(), strict=True))
        digests = sorted(raw)
        block = np.array([own[d] for d in digests])
        sets = [np.frombuffer(raw[d], U64) for d in digests]
        size = np.array([len(s) for s in sets])
        both = common(sets)
        # similarity >= 0.8 in whole numbers: 5 * both >= 4 * union
        link = 5 * both >= 4 * (size[:, None] + size[None, :] - both)
        np.fill_diagonal(link, False)
        if not within:
            link &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(link))
        tops = roots(len(digests), list(zip(a.tolist(), b.tolist(), strict=True)))
        number = link.sum(axis=1)
        out.extend((digests[k], int(number[k]), digests[tops[k]]) for k in np.flatnonzero(number))
        if len(out) > 50_000:
            yield flushed()
    if out:
        yield flushed()


def exact_links(docs: DataFrame, sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(digest, n_links, root): rows of exact comparisons inside candidate components."""
    groups = candidates.select("root", F.col("member").alias("digest"))
    groups = groups.union(groups.select("root", F.col("root").alias("digest")).distinct())
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = join_unique(groups, sizes, "root").join(sets.select("digest", "rep"), "digest")
    members = cut(members.withColumnRenamed("rep", "_rep"))
    texts = docs.select("doc_id", "text").join(members, F.col("doc_id").eqNullSafe(F.col("_rep")))
    with_sets = texts.select("text", "root", "digest", "n").mapInArrow(
        _with_sets, "root binary, digest binary, n bigint, shingles binary"
    )
    ordered = blocked(with_sets, "n", "digest", BLOCK).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return ordered.select("root", "i", "j", "_own", "digest", "shingles").mapInArrow(
        _linked, "digest binary, n_links bigint, root binary"
    )


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id, n_links, class_set: one row per row of ``docs``.

    Words are runs of letters, digits and non-ASCII characters with A-Z in lower
    case; a text of one to four words is one shingle. ``class_id`` is the
    smallest doc_id connected to the row by equal sets or links of similarity 0.8
    or more, ``class_set`` the smallest digest; ``n_links`` counts the other sets it
    is linked to. A text without
    words (null, empty, signs only) has a null digest, its own id as class and
    no links. Repeated rows share a class. A class of null ids alone has a null
    id. Other columns are ignored; an empty table gives no rows. A long text is a
    slice of its own and a set like any other. Ties of ids go to the smaller digest.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_signed, f"doc_id {kind}, digest binary, minima array<int>")
    rows = stored(rows, "signatures")
    sets = rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.any_value("minima").alias("minima")
    )
    sets = cut(sets)
    links = cut(exact_links(docs, sets, components(candidate_edges(sets))))
    joined = components(links.select(F.col("root").alias("a"), F.col("digest").alias("b")))
    counts = links.groupBy("digest").agg(F.sum("n_links").alias("n_links"))
    roots_ = sets.select("digest", "rep").join(joined.withColumnRenamed("member", "digest"), "digest", "left").join(
        counts, "digest", "left"
    ).select("digest", "rep", F.coalesce("root", "digest").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    roots_ = cut(roots_)
    ids = roots_.groupBy("root").agg(F.min("rep").alias("class_id"))
    by_set = join_unique(roots_, ids, "root").select("digest", "class_id", "n_links", F.col("root").alias("class_set"))
    worded = join_unique(rows.select("doc_id", "digest").filter(F.col("digest").isNotNull()), by_set, "digest")
    alone = rows.filter(F.col("digest").isNull()).select(
        "doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"),
        F.lit(None).cast("binary").alias("class_set"),
    )
    return worded.select("doc_id", "digest", "class_id", "n_links", "class_set").union(alone)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        shingles, bounds = shingle_sets(batch.column("text"))
        digests = [_digest(shingles[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names} | {"_jj_digest": pa.array(digests, pa.binary())})


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id.

    Rows are told apart by id and set, so of rows that repeat both one stays.
    Texts without words are classes of their own and stay, whatever ids they share.
    """
    found = classes(docs)
    chosen = found.filter(F.col("digest").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(
        F.col("class_id").alias("_jj_id"), "class_set"
    ).agg(F.min("digest").alias("_jj_set")).drop("class_set")  # of sets of one id in one class one stays
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(_digested, kind + ", _jj_digest binary").withColumn(
        "_jj_row", F.when(F.col("_jj_digest").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    )
    met = rows.join(
        chosen, F.col("doc_id").eqNullSafe(F.col("_jj_id")) & (F.col("_jj_digest") == F.col("_jj_set")), "left"
    )
    kept = met.filter(F.col("_jj_set").isNotNull() | F.col("_jj_digest").isNull())
    return kept.dropDuplicates(["doc_id", "_jj_digest", "_jj_row"]).select(*docs.columns)
