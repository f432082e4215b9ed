"""Chat formatting with typed content parts.

A turn holds text, or parts of the kinds text, image, audio and document. A
visitor flattens the parts in order: text is escaped, an attachment becomes a
numbered placeholder, and its reference and the tokens it expands to are
recorded. Formatted turns are written one row each, in order, with their place
in the conversation and the span of text under the loss mask, so a conversation
with very many turns is many rows. The text of a conversation is its turns one
after the other. Reading back parses the written rows only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.shared import stored, table

TURN, END = "<|turn|>", "<|end|>"
# Control strings of common templates; a backslash after the first character breaks them.
CONTROL = ("<|", "[INST]", "[/INST]", "<s>", "</s>")
LOSS_ROLE = "assistant"

PARTS = T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType()),
]))


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, control[0] + "\\" + control[1:])
    return text


_ESCAPE = re.compile(r"\\(\\?)")


def unescaped(text: str) -> str:
    """Of two backslashes one stays; a single one was put in and goes."""
    return _ESCAPE.sub(r"\1", text)


class Flatten:
    """Visitor over the parts of one turn: pieces of text, attachments, expanded tokens."""

    def __init__(self, patch: int = 14, audio_per_second: int = 25, document_per_page: int = 256):
        self.patch, self.audio_per_second, self.document_per_page = patch, audio_per_second, document_per_page
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        handler = getattr(self, f"visit_{part.get('type') or 'text'}", None)
        if handler is None:
            raise ValueError(f"unknown content part {part.get('type')!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escaped(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda n: math.ceil(max(n or 1, 1) / self.patch)
        self._attach("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil(max(part.get("seconds") or 0.0, 0.0) * self.audio_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(part.get("pages") or 1, 1) * self.document_per_page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments) + 1
        self.attachments.append({"number": number, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.pieces.append(f"<|{kind}:{number}|>")


def formatted_turn(role: str | None, text: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[dict]]:
    """(piece, loss start, loss end, attachments); the loss span is empty but for assistant turns."""
    visitor = Flatten()
    for part in parts if parts is not None else [{"type": "text", "text": text}]:
        visitor.visit(part)
    head = TURN + escaped(role or "").replace("\n", "\\n") + "\n"
    body = "".join(visitor.pieces)
    start = len(head) if role == LOSS_ROLE else 0
    return head + body + END + "\n", start, start + len(body) if role == LOSS_ROLE else 0, visitor.attachments


def parsed_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a written piece; placeholders stay in the text."""
    head, _, rest = piece[len(TURN):].partition("\n")
    role = re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), head)
    return role, unescaped(rest[: -len(END) - 1])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted turns of sorted conversations, numbered from 0 in each."""
    before, number = object(), 0
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        out = {k: [] for k in ("no", "piece", "loss_start", "loss_end", "attachments", "expanded_tokens")}
        columns = (batch.column(c).to_pylist() for c in ("role", "text", "parts"))
        for conv, role, text, parts in zip(ids, *columns, strict=True):
            number = number + 1 if conv == before else 0
            before = conv
            piece, start, end, attachments = formatted_turn(role, text, parts)
            values = (number, piece, start, end, attachments, sum(a["tokens"] for a in attachments))
            for key, value in zip(out, values, strict=True):
                out[key].append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([
            ("number", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())
        ])), pa.int64())
        yield pa.RecordBatch.from_pydict(
            {"conv_id": batch.column("conv_id")}
            | {k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)}
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, no, piece, loss_start, loss_end, attachments, expanded_tokens: one row per turn.

    ``conversations`` has conv_id, turn, role, text and, if its turns have typed
    content, parts (see PARTS), which then replaces text. Turns are numbered by
    turn (null first), then role, then text, so ties and repeated rows have an
    order. A null text is empty, a null role is empty, null ids are one
    conversation. Other columns are ignored; an empty table gives no rows.
    """
    parts = F.col("parts") if "parts" in conversations.columns else F.lit(None)
    turns = conversations.select("conv_id", "turn", "role", "text", parts.cast(PARTS).alias("parts"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    # Only order is carried from row to row, so a conversation of any length streams through.
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        _numbered,
        f"conv_id {kind}, no bigint, piece string, loss_start bigint, loss_end bigint, "
        "attachments array<struct<number:int,type:string,ref:string,tokens:bigint>>, expanded_tokens bigint",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of sorted pieces, one conversation after the other, without holding one whole."""
    rows, current, open_ = [], None, False

    def close():
        conv, n, turns, loss, loss_chars, chars, tokens = current
        rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, tokens))

    def flushed():
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "expanded_tokens")
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, columns, strict=True)], names
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end", "expanded_tokens"))
        for conv, piece, start, end, tokens in zip(*columns, strict=True):
            if not open_ or conv != current[0]:
                if open_:
                    close()
                current, open_ = [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0], True
            role, text = parsed_turn(piece)
            loss = unescaped(piece[start:end])
            current[1] += 1
            current[2].update(f"{role}\n{text}\n".encode())
            current[3].update(loss.encode())
            current[4] += len(loss)
            current[5] += len(piece)
            current[6] += tokens
        if rows:
            yield flushed()
    if open_:
        close()
        yield flushed()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from written pieces: turns, text under the loss mask, lengths, digests."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "no")
    return ordered.withColumn("conv_id", F.col("conv_id").cast("bigint")).mapInArrow(
        _digests,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, expanded_tokens bigint",
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, LOSS_ROLE, control)], given.schema)
    formatted = stored(format_turns(given.unionByName(own)), "chat")
    return read_back(formatted).drop("expanded_tokens")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *,
    replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '[INST]', '[\INST]'),
      '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>') AS t,
    replace(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '[INST]', '[\INST]'),
      '[/INST]', '[\/INST]'), '<s>', '<\s>'), '</s>', '<\/s>'), chr(10), '\n') AS r
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(length('<|turn|>' || r || chr(10) || t || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
