"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads a word byte by byte and writes its class: insult,
threat, target, negation or reported speech. Three transducers then read the
classes of a clause and mark insults and threats as negated, as reported, or as
aimed at a target; their composition is one table. What counts is the marked
match of a clause, not the word. Stems of the lexicon beyond the fixed seeds and
the weights of the marks are learned from labelled rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.shared import cut, table
from folioscope.llm.words import LETTER, LOWER, U64, Words, mixed, prefix, ranges, slices

# Seed words of the grammar, * marks an open end.
SEEDS = {
    "insult": "idiot* moron* stupid* loser* scum trash clown* pathetic worthless disgusting imbecile* dumb* "
              "abschaum dumm* trottel* widerlich* idiota* estúpid* imbécil* basura asqueros* crétin* ordure* "
              "stupide* dégueulasse*",
    "threat": "kill* murder* strangle* umbringen töte* matar* mataré tuer* tuerai",
    "target": "you your yours they them he she du dich ihr euch sie tú te usted vosotros tu toi vous",
    "negation": "not never no don't isn't aren't nicht kein* nie no nunca ne pas jamais",
    "report": "said says say called wrote quote quoted sagte sagt schrieb dijo dice escribió dit disait écrit",
}
CLASSES = list(SEEDS)
INSULT, THREAT, TARGET, NEGATION, REPORT = range(1, 6)
# Labelled rows used for training at most: label 0, label 1.
ROWS = (6000, 2000)
MAX_STEMS = 300
MIN_EVIDENCE = 30.0  # of a stem: twice the log-likelihood ratio


# ---------------------------------------------------------------- lexicon
def folded(words: Words) -> None:
    """Latin-1 capitals to small letters, in place of the bytes the lexicon reads."""
    data = words.data
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    data[capital] += 0x20


class Lexicon:
    """A deterministic transducer from the bytes of a word to a class and a weight."""

    def __init__(self, entries: list[tuple[bytes, bool, int, float]]):
        rows, self.prefix, self.word, self.weight = [{}], [0], [0], [1.0]
        for stem, open_end, kind, weight in entries:
            state = 0
            for byte in stem:
                if byte not in rows[state]:
                    rows[state][byte] = len(rows)
                    rows.append({})
                    self.prefix.append(0)
                    self.word.append(0)
                    self.weight.append(1.0)
                state = rows[state][byte]
            (self.prefix if open_end else self.word)[state] = kind
            self.weight[state] = max(self.weight[state], weight)
        self.next = np.zeros((len(rows), 256), np.int32)
        for state, row in enumerate(rows):
            for byte, to in row.items():
                self.next[state, byte] = to
        self.prefix, self.word, self.weight = map(np.array, (self.prefix, self.word, self.weight))

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Class (0: none) and weight of each word; all words step together."""
        kind, weight = np.zeros(len(words.start), np.int8), np.ones(len(words.start))
        live = np.arange(len(words.start))
        at, state = words.start.copy(), np.zeros(len(words.start), np.int32)
        while len(live):
            state = self.next[state, words.data[at]]
            on = state > 0
            live, at, state = live[on], at[on] + 1, state[on]
            ended = at == words.end[live]
            out = np.where(self.prefix[state] > 0, self.prefix[state], np.where(ended, self.word[state], 0))
            hit = out > 0
            kind[live[hit]], weight[live[hit]] = out[hit], self.weight[state[hit]]
            live, at, state = live[~ended], at[~ended], state[~ended]
        return kind, weight


def seed_entries() -> list[tuple[bytes, bool, int, float]]:
    return [
        (w.rstrip("*").replace("'", "").encode(), w.endswith("*"), CLASSES.index(c) + 1, 1.0)
        for c in reversed(CLASSES) for w in SEEDS[c].split()
    ]


# ---------------------------------------------------------------- grammar
class Transducer:
    """Arcs (state, symbol) -> (state, output); a missing arc passes the symbol on."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]]):
        self.arcs = arcs

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(a: Transducer, b: Transducer, alphabet: list[str], start=(0, 0)) -> Transducer:
    """The transducer that feeds the output of ``a`` to ``b``, over reachable states."""
    arcs, numbers, open_ = {}, {start: 0}, [start]
    while open_:
        state = open_.pop()
        for symbol in alphabet:
            left, middle = a.step(state[0], symbol)
            right, out = b.step(state[1], middle)
            to = (left, right)
            if to not in numbers:
                numbers[to] = len(numbers)
                open_.append(to)
            arcs[numbers[state], symbol] = (numbers[to], out)
    return Transducer(arcs)


SYMBOLS = ["insult", "threat", "target", "negation", "report"]
_MARKED = ["insult", "threat", "insult-", "threat-"]
# A negation holds for the next insult or threat of the clause.
NEGATED = Transducer({(0, "negation"): (1, "negation"), (1, "insult"): (0, "insult-"), (1, "threat"): (0, "threat-")})
# Reported speech holds until the clause ends.
REPORTED = Transducer({(0, "report"): (1, "report"), **{(1, s): (1, s + '"') for s in _MARKED}})
# A target named earlier in the clause is what the match is aimed at.
AIMED = Transducer({
    (0, "target"): (1, "target"), **{(1, s + q): (1, s + q + ">") for s in _MARKED for q in ("", '"')},
})
GRAMMAR = compose(compose(NEGATED, REPORTED, SYMBOLS), AIMED, SYMBOLS)
MARKS = [k + n + r + t for k in ("insult", "threat") for n in ("", "-") for r in ("", '"') for t in ("", ">")]
MARK = {m: i for i, m in enumerate(MARKS)}


def prior(mark: str) -> float:
    """Weight of a mark before anything is learned."""
    return 1.0 * (0.5 if "-" in mark else 1) * (0.7 if '"' in mark else 1) * (1.3 if ">" in mark else 1)


_BORDER = np.isin(np.arange(256), np.frombuffer(b".!?;:\n", np.uint8))


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: summed lexicon weights of its marked clause matches, a column per mark; number of words."""
    words = Words(column, LETTER, LOWER)
    folded(words)
    out = np.zeros((words.n_docs, len(MARKS) + 1))
    out[:, -1] = words.n_words
    kind, weight = lexicon.read(words)
    if not kind.any():
        return out
    clause = np.cumsum(_BORDER[words.raw])[words.start] + words.doc  # texts are clauses' borders too
    said = np.flatnonzero(kind)
    matched = np.unique(clause[kind == INSULT].tolist() + clause[kind == THREAT].tolist())
    said = said[np.isin(clause[said], matched)]
    state, before = 0, None
    for w in said:
        if clause[w] != before:
            state, before = 0, clause[w]
        state, mark = GRAMMAR.step(state, CLASSES[kind[w] - 1])
        if mark in MARK:
            out[words.doc[w], MARK[mark]] += weight[w]
    return out


def inputs(x: np.ndarray) -> np.ndarray:
    """Inputs of the regression; length counts, since a long text holds more chance matches."""
    return np.concatenate([np.sqrt(x[:, :-1]), np.log1p(x[:, -1:])], axis=1)


# ---------------------------------------------------------------- learning
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with three minimum hashes of their word triples; copies mostly share one."""
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), LETTER, LOWER)
        first, triple = words.windows(words.hashes(), 3)
        bounds = np.searchsorted(words.doc[first], np.arange(batch.num_rows))
        full = np.diff(np.append(bounds, len(first))) > 0
        whole = ranges(prefix(words.raw), words.at[:-1], words.at[1:]).view(np.int64)
        for k in range(3):
            low = whole.copy()  # a text of a word or two stands for itself
            if full.any():
                low[full] = np.minimum.reduceat(mixed(triple + U64(k)), bounds[full]).view(np.int64)
            batch = batch.append_column(f"m{k}", pa.array(low))
        yield batch


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per class that hold a word with each prefix (3 to 8 bytes) or each whole word."""
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"), LETTER, LOWER)
        folded(words)
        words.hashes()
        label = batch.column("label").to_numpy()
        size = words.end - words.start
        for k in (*range(3, 9), 0):
            at = np.flatnonzero(size >= k if k else size <= 24)
            if k:  # not inside a character
                nxt = words.start[at] + k
                at = at[(nxt == words.end[at]) | ((words.data[np.minimum(nxt, len(words.data) - 1)] & 0xC0) != 0x80)]
            end = words.start[at] + k if k else words.end[at]
            h = ranges(words.h, words.start[at], end) if len(at) else np.zeros(0, U64)
            u, one, inv = np.unique(h, return_index=True, return_inverse=True)
            pair = np.unique(np.stack([inv, words.doc[at]], axis=1), axis=0)
            hit = label[pair[:, 1]] == 1
            tox = np.bincount(pair[hit, 0], minlength=len(u))
            all_ = np.bincount(pair[:, 0], minlength=len(u))
            stems = [words.data[words.start[at[i]] : end[i]].tobytes() for i in one]
            yield pa.RecordBatch.from_arrays([
                pa.array(stems, pa.binary()), pa.array(np.full(len(u), k > 0)), pa.array(tox, pa.int64()),
                pa.array(all_ - tox, pa.int64()),
            ], ["stem", "open_end", "toxic", "clean"])


def evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Twice the log-likelihood ratio of a stem that marks label 1; negative if it marks 0."""
    def part(k, n, p):
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)

    p = (toxic + clean) / (n_toxic + n_clean)
    if p >= 1 or toxic / n_toxic <= clean / n_clean:
        return -1.0
    own = part(toxic, n_toxic, toxic / n_toxic) + part(clean, n_clean, clean / n_clean)
    return 2 * (own - part(toxic, n_toxic, p) - part(clean, n_clean, p))


def chosen(rows: list[tuple[bytes, bool, int, int]], n_toxic: int, n_clean: int) -> list[tuple[bytes, bool, int, float]]:
    """Lexicon entries: stems by evidence, the longer first of equal ones, none within or around a chosen one."""
    ranked = sorted(rows, key=lambda r: (-evidence(r[2], r[3], n_toxic, n_clean), -len(r[0]), r[0], not r[1]))
    kept: list[tuple[bytes, bool, int, float]] = []
    for s, o, t, c in ranked:
        if any((open_ and s.startswith(stem)) or (o and stem.startswith(s)) for stem, open_, _, _ in kept):
            continue
        share = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        kept.append((s, o, INSULT, max(0.5, share)))
    return kept


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, column: pa.Array) -> np.ndarray:
        z = inputs(features(column, self.lexicon)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def regression(x: np.ndarray, label: np.ndarray, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression drawn to the prior weights; without two classes, the prior alone."""
    base = np.array([prior(m) for m in MARKS] + [0.0, -1.0])
    if len(set(label)) < 2:
        return base[:-1], base[-1]
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = base.copy()
    pull = np.full(len(w), decay)
    pull[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) / len(x) + pull * (w - base)
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag(pull + 1e-9)
        step = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = ROWS) -> Model:
    """Model from at most ``rows`` labelled rows per class, chosen by a hash of the id.

    Rows whose id has a crc32 divisible by 5 are never used. Only labels 0 and 1
    count; of labels repeated for an id the larger counts. Without labels of both
    classes the fixed seeds and prior weights decide. Stems of equal evidence rank
    by their bytes; the layout of the tables changes nothing.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    parts = [
        usable.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows[value])
        for value in (0, 1)
    ]
    # At most sum(rows) rows of two numbers, so this broadcast has a fixed bound.
    sample = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id")
    totals = dict(sample.groupBy("label").count().collect())
    n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
    entries = seed_entries()
    if not n_clean or not n_toxic:
        return Model(Lexicon(entries), *regression(np.zeros((0, len(MARKS) + 1)), np.zeros(0)))
    # A word of one text that has many copies is no evidence: of copies with one label,
    # rows that agree on two of three minimum hashes, the one of the smallest id counts.
    distinct = sample.mapInArrow(
        _sketched, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, label int, m0 bigint, m1 bigint, m2 bigint"
    )
    for pair in (("m0", "m1"), ("m0", "m2"), ("m1", "m2")):
        copies = W.partitionBy("label", *pair).orderBy("doc_id", F.xxhash64("text"))
        distinct = distinct.withColumn("_copy", F.row_number().over(copies)).filter("_copy = 1").drop("_copy")
    distinct = cut(distinct.select("text", "label"))  # at most sum(rows) rows
    totals = dict(distinct.groupBy("label").count().collect())
    n_clean, n_toxic = totals.get(0, 0) or 1, totals.get(1, 0) or 1
    counted = distinct.mapInArrow(
        _prefixes, "stem binary, open_end boolean, toxic bigint, clean bigint"
    ).groupBy("stem", "open_end").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # A first cut in SQL; MAX_STEMS * 20 rows at most reach the driver.
    strong = counted.filter(
        (F.col("toxic") >= 4) & (F.col("toxic") * n_clean > F.col("clean") * n_toxic * 8)
    ).orderBy(F.desc("toxic"), "stem", "open_end").limit(MAX_STEMS * 20).collect()
    ranked = [(bytes(r.stem), r.open_end, r.toxic, r.clean) for r in strong
              if evidence(r.toxic, r.clean, n_toxic, n_clean) >= MIN_EVIDENCE]
    learned = sorted(chosen(ranked, n_toxic, n_clean), key=lambda e: -e[3])[:MAX_STEMS]
    lexicon = Lexicon(entries + learned)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features(batch.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))],
                ["doc_id", "label", "x"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(vectors, f"doc_id {kind}, label int, x array<double>").toArrow()
    # One order, whatever the layout: rows of one id and label by their inputs.
    first = pa.array([str(v) for v in got.column("x").to_pylist()])
    got = got.append_column("order", first).sort_by([("doc_id", "ascending"), ("label", "ascending"), ("order", "ascending")])
    x = inputs(np.array(got.column("x").to_pylist()))
    return Model(lexicon, *regression(x, got.column("label").to_numpy().astype(float)))


def _scored(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            columns = {c: batch.column(c) for c in keep}
            columns["_tx_score"] = pa.array(model.value.score(batch.column("text")))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with a column score in 0..1, one row per row.

    Null or empty texts match nothing and get the score of the bias. Repeated
    rows each get their row, ids may be null, an empty table gives no rows. A
    column of ``docs`` called score is replaced. A long text is a slice of its own
    and is read whole; its length is an input. Scores may tie.
    """
    kept = [c for c in keep or docs.columns if c != "score"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_STEMS stems
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    sent_columns = dict.fromkeys([*kept, "text"])
    out = docs.select(*sent_columns).mapInArrow(_scored(sent, kept), fields + ", _tx_score double")
    return out.withColumnRenamed("_tx_score", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
