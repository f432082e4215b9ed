"""Token counts by rank-synchronous merging of ragged arrays.

The model is a sentencepiece BPE with byte fallback: symbols are characters, and
the neighbouring pair whose joined string is the best-ranked piece is merged,
the leftmost first among equals, until no pair is a piece. Two neighbouring
characters that stand side by side in no piece can never end up in one symbol,
so a text falls apart there into pre-tokens that are merged independently.

Pre-tokens of a slice lie behind each other in one ragged array. Each round finds
the lowest-ranked pair of every sequence, merges all of them at once and drops
the sequences without a pair. A pre-token is merged once a slice, however often
it occurs. Only the number of symbols that survive is kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.shared import table
from folioscope.llm.words import buffers, prefix, ranges, release, slices

LIMIT = 4096
CHUNK = 1 << 19  # characters merged at once; a cut lies between two pre-tokens
LONG = 256  # symbols; a longer pre-token is merged by a queue, in n log n instead of n * n
SPACE = "▁"
_NONE = np.int64(1) << 62
_LOW = (np.int64(1) << 32) - 1


class Merger:
    """Pieces and pairs of a sentencepiece BPE model, and counts of whole texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  ﬁ\t") != SPACE + "a" + SPACE * 2 + "ﬁ\t":
            raise ValueError("only models that change nothing but blanks are supported")
        plain = [i for i in range(model.vocab_size())
                 if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        inner = {c for piece in score if len(piece) > 1 for c in piece}
        # Characters that only occur inside longer pieces are symbols too, of several bytes each.
        names = list(score) + sorted(inner - set(score))
        number = {name: i for i, name in enumerate(names)}
        self.cost = np.array([1 if name in score else len(name.encode()) for name in names], np.int64)
        self.symbol = np.full(0x110000, -1, np.int32)
        for name in names:
            if len(name) == 1:
                self.symbol[ord(name)] = number[name]
        level = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = {}
        for piece, s in score.items():
            for k in range(1, len(piece)):
                left, right = number.get(piece[:k]), number.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * len(names) + right] = (level[s], number[piece])
        self.width = len(names)
        self.keys = np.array(sorted(pairs), np.int64)
        found = np.array([pairs[int(k)] for k in self.keys], np.int64).reshape(-1, 2)
        self.rank, self.joined = found[:, 0], found[:, 1]
        # Which characters may stand side by side: a table over the letters of longer pieces, 0 for all others.
        letters = sorted(inner)
        self.letter = np.zeros(0x110000, np.int16)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        place = {c: i + 1 for i, c in enumerate(letters)}
        self.beside = np.zeros((len(letters) + 1,) * 2, bool)
        for piece in score:
            for a, b in zip(piece, piece[1:]):
                self.beside[place[a], place[b]] = True

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of neighbouring symbols; rank -1 where they are no piece."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], -1), self.joined[at]

    def merged(self, symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Cost of the symbols that survive in each of the sequences behind each other in ``symbols``."""
        out = np.zeros(len(length), np.int64)
        who = np.arange(len(length))
        symbols = symbols.copy()
        rank, joined = self._ranked(symbols, length)
        while len(who):
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            best = np.minimum.reduceat(np.where(rank < 0, _NONE, (rank << 32) | np.arange(len(rank))), first)
            live = best < _NONE
            if not live.all():
                totals = np.add.reduceat(self.cost[symbols], first)
                out[who[~live]] = totals[~live]
                keep = np.repeat(live, length)
                shift = np.cumsum(~keep)  # dropped symbols before each place
                symbols, rank, joined = symbols[keep], rank[keep], joined[keep]
                at = best[live] & _LOW
                at = at - shift[at]
                who, length = who[live], length[live]
            else:
                at = best & _LOW
            if not len(who):
                break
            symbols[at] = joined[at]
            rank[at] = -1
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, rank, joined = symbols[stay], rank[stay], joined[stay]
            at = at - np.arange(len(at))  # one symbol went in each earlier sequence
            length = length - 1
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            end = first + length - 1
            for place in (at[at > first] - 1, at[at < end]):
                rank[place], joined[place] = self.pairs(symbols[place], symbols[place + 1])
        return out

    def _ranked(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, joined = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], joined[:-1] = self.pairs(symbols[:-1], symbols[1:])
        rank[np.cumsum(length) - 1] = -1
        return rank, joined

    def queued(self, symbols: np.ndarray) -> int:
        """The same for one long sequence: a linked list and a queue of its pairs."""
        n = len(symbols)
        value, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank, joined = self.pairs(symbols[:-1], symbols[1:])
        queue = [(r, i, w, value[i], value[i + 1]) for i, (r, w) in enumerate(zip(rank.tolist(), joined.tolist())) if r >= 0]
        heapq.heapify(queue)
        known: dict[int, tuple[int, int]] = {}
        while queue:
            _, i, w, left, right = heapq.heappop(queue)
            j = after[i]
            if value[i] != left or j == n or value[j] != right:
                continue
            value[i], value[j] = w, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a < 0 or b == n:
                    continue
                key = value[a] * self.width + value[b]
                if key not in known:
                    r, w2 = self.pairs(np.array([value[a]]), np.array([value[b]]))
                    known[key] = int(r[0]), int(w2[0])
                r, w2 = known[key]
                if r >= 0:
                    heapq.heappush(queue, (r, a, w2, value[a], value[b]))
        return int(sum(self.cost[v] for v in value if v >= 0))

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a string column; a null has none."""
        raw, at = buffers(column)
        full = at[1:] > at[:-1]
        out = np.zeros(len(column), np.int64)
        if not full.any():
            return out
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        head = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at]  # first code point of each text
        begin = head[:-1][full]
        # One blank goes before each text that has characters.
        points = np.insert(points, begin, 0x20)
        begin = begin + np.arange(len(begin))
        points[points == 0x20] = ord(SPACE)
        border = np.zeros(len(points), bool)
        border[begin] = True
        total = np.zeros(len(points) + 1, np.int64)
        first = 0
        while first < len(points):
            last = self._cut(points, border, first)
            total[first + 1 : last + 1] = self._chunk(points[first:last], border[first:last])
            first = last
        total = np.cumsum(total)
        ends = np.append(begin[1:], len(points))
        out[full] = total[ends] - total[begin]
        return out

    def _apart(self, points: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Whether each character begins a pre-token, judged by the one before it."""
        apart = border.copy()
        letter = self.letter[points]
        apart[0] = True
        apart[1:] |= ~self.beside[letter[:-1], letter[1:]]
        return apart

    def _cut(self, points: np.ndarray, border: np.ndarray, first: int) -> int:
        last = first + CHUNK
        while last < len(points):
            apart = np.flatnonzero(self._apart(points[last - CHUNK : last + 1], border[last - CHUNK : last + 1]))
            if apart[-1] > 0:  # the first of a part is no evidence
                return last - CHUNK + int(apart[-1])
            last += CHUNK
        return len(points)

    def _chunk(self, points: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, written at its first character."""
        start = np.flatnonzero(self._apart(points, border))
        length = np.diff(np.append(start, len(points)))
        symbols = self.symbol[points]
        out = np.zeros(len(points), np.int64)
        one = length == 1
        known = symbols[start[one]]
        width = 1 + (points[start[one]] >= 0x80) + (points[start[one]] >= 0x800) + (points[start[one]] >= 0x10000)
        out[start[one]] = np.where(known >= 0, self.cost[known], width)
        many = np.flatnonzero(~one)
        if not len(many):
            return out
        start, length = start[many], length[many]
        key = ranges(prefix(points.astype(np.uint64)), start, start + length)
        _, pick, group = np.unique(key, return_index=True, return_inverse=True)
        # A pre-token whose characters differ from those of its hash's first one stands for itself.
        same = length == length[pick][group]
        offset = np.arange(length[same].sum()) - np.repeat(np.cumsum(length[same]) - length[same], length[same])
        equal = points[np.repeat(start[same], length[same]) + offset] == points[
            np.repeat(start[pick][group[same]], length[same]) + offset]
        same[np.flatnonzero(same)[~np.logical_and.reduceat(
            equal, np.cumsum(length[same]) - length[same])]] = False
        group = group.copy()
        group[~same] = len(pick) + np.arange((~same).sum())
        pick = np.concatenate([pick, np.flatnonzero(~same)])
        size = np.zeros(len(pick), np.int64)
        short = np.flatnonzero(length[pick] <= LONG)
        if len(short):
            at, n = start[pick[short]], length[pick[short]]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            size[short] = self.merged(symbols[np.repeat(at, n) + offset].astype(np.int64), n)
        for k in np.flatnonzero(length[pick] > LONG):
            at = start[pick[k]]
            size[k] = self.queued(symbols[at : at + length[pick[k]]].astype(np.int64))
        out[start] = size[group]
        return out


@lru_cache(maxsize=1)
def _merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``.

    ``path`` is the model's file on every executor. A null text counts as empty;
    an empty text has no tokens. Null and repeated ids are rows like any other,
    so there are no ties. A long text is merged in chunks cut between two
    pre-tokens; a task holds a text and its code points, but only a chunk's
    arrays. An empty table gives no rows, and other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = None
        for batch in slices(batches, "text"):
            merger = merger or _merger(path)
            text = batch.column("text")
            n = merger.counts(text)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
        release()

    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
