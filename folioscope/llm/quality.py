"""Quality rules: counted base rules and a hashed n-gram logistic regression.

The features are word unigrams, word pairs, and byte 3- and 5-grams, each hashed
into one of 2**18 bins. A text is the mean of its grams per group, so its length
does not matter. A pair of equal words is one feature whatever the word, because
repetition shows in words never seen before. The regression is trained on a
bounded sample of labelled rows and calibrated on rows held out of it; scores
are compared with fixed thresholds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import table
from folioscope.llm.words import NOT_BLANK, U64, Words, mixed, ranges, slices, sums

BINS = 1 << 18
GROUPS = 4
# Labelled rows per class that are used for training: the bound of the sample.
ROWS_PER_CLASS = 750
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_PROBABILITY = 0.5

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def base_counts(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words per text."""
    raw, at, n = words.raw, words.at, words.n_docs
    out = {
        "n_words": words.n_words.astype(np.int64),
        "word_chars": sums((words.inside & ~_CONTINUES[raw]).astype(np.int64), at),
        "n_symbols": sums(_SYMBOL[raw].astype(np.int64), at),
    }
    # Lines of all texts: borders after each line feed and at the ends of texts.
    feed = np.flatnonzero(raw == 10)
    begin = np.union1d(at[:-1], feed + 1)
    begin = begin[begin < len(raw)]
    doc = np.searchsorted(at, begin, side="right") - 1
    end = np.append(begin[1:], len(raw))[: len(begin)]
    feeds = np.zeros(len(begin), np.int64)
    feeds[raw[end - 1] == 10] = 1
    worded = sums(words.inside.astype(np.int64), np.append(begin, len(raw))) > 0
    line, doc = ranges(words.h, begin, end - feeds)[worded], doc[worded]
    out["n_dup_lines"] = np.bincount(doc[_repeats(doc, line, first=False)], minlength=n).astype(np.int64)
    # Words in 8-word windows that a text holds twice or more.
    first, window = words.windows(hashes, 8)
    again = first[_repeats(words.doc[first], window, first=True)]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 8, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    out["n_repeat_words"] = np.bincount(words.doc[repeated], minlength=n).astype(np.int64)
    return out


def _repeats(doc: np.ndarray, value: np.ndarray, first: bool) -> np.ndarray:
    """Indices whose (doc, value) occurs more than once; the first ones only if asked."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    hit = np.zeros(len(order), bool)
    hit[1:] = same
    if first:
        hit[:-1] |= same
    return order[hit]


def grams(words: Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group: bins of all grams in text order, and where each text's begin."""
    at, n = words.at, len(words.data)
    bins = [(hashes >> U64(46), words.first)]
    pair = mixed(hashes[1:] * U64(3) + hashes[:-1] + U64(1))
    pair[hashes[1:] == hashes[:-1]] = U64(12345)
    same = words.doc[1:] == words.doc[:-1]
    kept = np.concatenate([[0], np.cumsum(same)])
    bins.append((pair[same] >> U64(46), kept[np.clip(words.first, 0, max(len(hashes) - 1, 0))]))
    for k in (3, 5):
        start = np.arange(max(n - k + 1, 0))
        h = ranges(words.h, start, start + k) if len(start) else np.zeros(0, U64)
        # A gram belongs to the text it begins in; the few across a border do no harm to
        # the next text, but must not depend on it: they are left out.
        inside = np.ones(len(start), bool)
        for back in range(1, k):
            edge = at[1:-1] - back
            inside[edge[(edge >= 0) & (edge < len(start))]] = False
        kept = np.concatenate([[0], np.cumsum(inside)])
        bins.append(((h[inside] ^ U64(k)) >> U64(46), kept[np.clip(at, 0, len(start))]))
    return bins


def scores(words: Words, hashes: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Linear scores of all texts; texts without words get the bias alone."""
    total = np.full(words.n_docs, bias)
    for g, (bins, bounds) in enumerate(grams(words, hashes)):
        count = np.diff(bounds)
        part = sums(weights[g][bins.astype(np.int64)], bounds)
        total += np.where(count > 0, part / np.maximum(count, 1), 0.0)
    return total


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of the sampled labelled rows: at most GROUPS * BINS entries each."""
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), NOT_BLANK)
        found = grams(words, words.hashes())
        index, value = [], []
        for d in range(batch.num_rows):
            i, v = [], []
            for g, (bins, bounds) in enumerate(found):
                own = bins[bounds[d] : bounds[d + 1]].astype(np.int64)
                if len(own):
                    u, c = np.unique(own, return_counts=True)
                    i.append(u + g * BINS)
                    v.append(c / len(own))
            index.append(np.concatenate(i) if i else np.zeros(0, np.int64))
            value.append(np.concatenate(v) if v else np.zeros(0))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("label"),
            pa.array([x.astype(np.int32) for x in index], pa.list_(pa.int32())),
            pa.array([x.astype(np.float32) for x in value], pa.list_(pa.float32())),
        ], ["doc_id", "label", "i", "v"])


def held_out(doc_id) -> bool:
    """Rows kept from training: crc32 of the id's text modulo 5 is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


class Model:
    """Weights per group and bin, bias, and the calibration of scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def fit(label: np.ndarray, index: list[np.ndarray], value: list[np.ndarray], train: np.ndarray,
        rounds: int = 80, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Full-batch logistic regression, then Platt scaling on the rows not trained on.

    The classes weigh the same in both steps. Without two classes the model says
    probability 1 for every text.
    """
    label = label.astype(np.float64)
    if len(set(label[train])) < 2:
        return Model(np.zeros((GROUPS, BINS), np.float32), 0.0, 0.0, 30.0)
    lengths = np.array([len(x) for x in index])
    row = np.repeat(np.arange(len(label), dtype=np.int32), lengths)
    cells = np.concatenate(index)
    values = np.concatenate(value)
    in_train = train[row]
    t_row, t_cells, t_values = row[in_train], cells[in_train], values[in_train]
    share = np.where(label == 1, 0.5 / max(label[train].sum(), 1), 0.5 / max((1 - label[train]).sum(), 1)) * train
    w, bias = np.zeros(GROUPS * BINS), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(t_row, t_values * w[t_cells], minlength=len(label)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * share
        gradient = np.bincount(t_cells, t_values * error[t_row], minlength=len(w)) + decay * w
        gb = error.sum()
        m, s = 0.9 * m + 0.1 * gradient, 0.99 * s + 0.01 * gradient**2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(s / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    z = np.bincount(row, values * w[cells], minlength=len(label)) + bias
    test = ~train if len(set(label[~train])) == 2 else train
    slope, shift = platt(z[test], label[test])
    return Model(w.reshape(GROUPS, BINS).astype(np.float32), bias, slope, shift)


def platt(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid, classes weighing the same, with softened targets."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.where(label == 1, 0.5 / n1, 0.5 / n0)
    scale = np.std(z) or 1.0
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        a -= np.clip(np.linalg.solve(h, x.T @ (share * (p - target))), -2, 2)
    return float(a[0] / scale), float(a[1])


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = ROWS_PER_CLASS) -> Model:
    """Model of a label from at most ``rows`` rows per class, chosen by a hash of the id.

    Only labels 0 and 1 count; rows without a document or an id are left out, and
    of labels repeated for an id the larger counts.
    """
    chosen = None
    unique = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label"))
    for value in (0, 1):
        part = unique.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.union(part)
    # At most 2 * rows rows of two numbers, so this broadcast has a fixed bound.
    sample = docs.select("doc_id", "text").join(
        F.broadcast(chosen.select("doc_id", F.col("label").cast("int").alias("label"))), "doc_id"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = sample.mapInArrow(_vectors, f"doc_id {kind}, label int, i array<int>, v array<float>")
    got = found.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    ids = got.column("doc_id").to_pylist()
    index = [x.values.to_numpy() for x in got.column("i")]
    value = [x.values.to_numpy() for x in got.column("v")]
    return fit(got.column("label").to_numpy(), index, value, np.array([not held_out(i) for i in ids], bool))


def _scored(model, keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), NOT_BLANK)
            hashes = words.hashes()
            out = base_counts(words, hashes)
            failed = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
            p = m.probability(scores(words, hashes, m.weights, m.bias))
            columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            columns |= {k: pa.array(v, pa.int64()) for k, v in out.items()}
            columns |= {"base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= keep)), "probability": pa.array(p)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def score(docs: DataFrame, model: Model, keep: float = MIN_PROBABILITY) -> DataFrame:
    """doc_id, base counts, base_failed, kept, probability: one row per row of ``docs``.

    Null or empty texts have no words and fail the base rules. Repeated rows each
    get their row, null ids stay null, other columns are ignored, an empty table
    gives no rows. A long text is a slice of its own and is read whole. A
    probability equal to ``keep`` keeps the row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    # 4 MB of weights, whatever the input.
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(
        _scored(sent, keep), f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, probability double"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
