"""Personal data with offset-preserving deobfuscation.

Base patterns run on the text as it is. Then small transducers rewrite disguises
(look-alike characters, spelled digits, written at and dot) to plain characters;
each output character carries the source span it came from. The same patterns
run on the normalised text, and what they find there is led back to source
spans. Base spans stay; a span inside one of its kind adds nothing and is dropped.
Rewriting is done only in texts that hold something a transducer may rewrite;
elsewhere the normalised text is the text itself.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.shared import table
from folioscope.llm.words import LETTER_DIGIT, LOWER, Words, slices

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract. Possessive runs and the look-behind
# only keep a failing run from being tried again from each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part is the run before an at sign, which it can't pass."""
    at, free, after = text.find("@"), 0, 0
    while at >= 0:
        run = text[max(free, after):at]
        start = at - len(run) + len(run.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        after = at + 1
        at = text.find("@", max(after, free))


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by kind as listed, then start."""
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = digits_of(m.group()) if m.end() - m.start() <= 40 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


# Look-alikes of ASCII letters, digits and signs that compatibility forms don't cover.
LOOKALIKES = dict(zip(
    "аеорсухіјѕԁԛԝһкмтвнгпАВЕКМНОРСТУХІЈЅαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․∙•‐‑‒–−﹣",
    "aeopcyxijsdqwhkmtbhrnABEKMHOPCTYXIJSabeiknoptuxABEZHIKMNOPTYX...------",
    strict=True,
))
# Characters without width, which split an identifier for a reader's eye only.
UNSEEN = "​‌‍⁠﻿­"
NUMBER_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "un": "1", "deux": "2", "trois": "3",
    "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2",
    "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_NUMBER = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_OPEN, _CLOSE = r"[(\[{<]\s{0,2}", r"\s{0,2}[)\]}>]"
_AT, _DOT = r"(?:at|arroba|arobase|ät|klammeraffe|@)", r"(?:dot|punkt|point|punto|\.)"
# A written at sign or dot in brackets, or between blanks as a word of its own.
BRACKET_AT = rf"\s{{0,2}}{_OPEN}{_AT}{_CLOSE}\s{{0,2}}"
BRACKET_DOT = rf"\s{{0,2}}{_OPEN}{_DOT}{_CLOSE}\s{{0,2}}"
WORD_AT, WORD_DOT = r"\s{1,2}(?:at|arroba|arobase|ät)\s{1,2}", r"\s{1,2}(?:dot|punkt|punto)\s{1,2}"
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
# An address counts as disguised only whole: name, at, name, dot, name.
ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9_%+-])(?P<local>{_NAME}(?:(?:\.|{BRACKET_DOT}|{WORD_DOT}){_NAME}){{0,4}})"
    rf"(?:(?P<sure>{BRACKET_AT}|\s@\s|@)|(?P<word>{WORD_AT}))"
    rf"(?P<domain>[A-Za-z0-9-]{{1,63}}(?:(?:\.|{BRACKET_DOT}|{WORD_DOT})[A-Za-z0-9-]{{1,63}}){{1,4}})",
    re.IGNORECASE,
)
DOTTED = re.compile(rf"{BRACKET_DOT}|{WORD_DOT}", re.IGNORECASE)
SPELLED = re.compile(
    rf"\b(?:{_NUMBER})(?:(?:{WORD_DOT}|[\s,.-]{{1,2}})(?:(?:{_NUMBER})\b|[0-9]+\b|plus\b))+", re.IGNORECASE
)
SPELLED_PART = re.compile(rf"\b(?:{_NUMBER})\b", re.IGNORECASE)
DOTTED_NUMBERS = re.compile(rf"[0-9]{{1,3}}(?:(?:\.|{BRACKET_DOT}|{WORD_DOT})[0-9]{{1,3}}){{3}}", re.IGNORECASE)
PLUS = re.compile(r"\bplus\s{1,2}(?=[0-9])", re.IGNORECASE)
# Texts without a character of ``changed()``, any of these and the words below have nothing to rewrite.
BRACKETED = re.compile(rf"{_OPEN}(?:{_AT}|{_DOT}){_CLOSE}", re.IGNORECASE)
NOT_ASCII = re.compile(r"[^\x00-\x7f]")
SPACED_AT = re.compile(r"\s@\s")
LONE_WORDS = ("dot", "punkt", "punto", "plus")
# Runs of ASCII letters and digits that every number word holds one of.
NUMBER_PARTS = {re.split("[^a-z]", w)[-1] for w in NUMBER_WORDS}
# Letters that ``re.IGNORECASE`` takes for an ASCII one; the Kelvin sign is in ``changed()``.
FOLDED = {"ſ": "s", "İ": "i", "ı": "i"}
ASCII_LETTER_DIGIT = LETTER_DIGIT & (np.arange(256) < 0x80)


class Mapped:
    """A text and, for each of its characters, the source span it stands for; None: each for itself."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | None = None):
        self.text, self.spans = text, spans

    def rewritten(self, pattern: re.Pattern, plain) -> Mapped:
        """Each match replaced by ``plain(match)``; its characters stand for the whole match.

        A match that stays as it is keeps the spans of its characters.
        """
        new = [(m.span(), plain(m)) for m in pattern.finditer(self.text)]
        new = [((a, b), x) for (a, b), x in new if x is not None and x != self.text[a:b]]
        if not new:
            return self
        old = self.spans or [(i, i + 1) for i in range(len(self.text))]
        out, spans, at = [], [], 0
        for (a, b), x in new:
            out.append(self.text[at:a])
            spans.extend(old[at:a])
            out.append(x)
            spans.extend([(old[a][0], old[b - 1][1])] * len(x))
            at = b
        out.append(self.text[at:])
        spans.extend(old[at:])
        return Mapped("".join(out), spans)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (self.spans[start][0], self.spans[end - 1][1]) if self.spans else (start, end)


def _plain(c: str) -> str:
    if c in UNSEEN:
        return ""
    new = LOOKALIKES.get(c, c)
    if new == c and ord(c) > 0x2000:
        form = unicodedata.normalize("NFKC", c)
        new = form if form.isascii() else c
    return new


@lru_cache(maxsize=1)
def changed() -> dict[str, str]:
    """Every character that ``_plain`` rewrites, and to what."""
    return {c: _plain(c) for c in map(chr, range(0x80, 0x110000)) if _plain(c) != c}


def plain_characters(text: str) -> Mapped:
    """Transducer 1: look-alikes and compatibility forms to ASCII, unseen characters go."""
    whole = Mapped(text)
    return whole if text.isascii() else whole.rewritten(NOT_ASCII, lambda m: changed().get(m.group()))


def _address(m: re.Match) -> str | None:
    """The plain address; a bare word "at" counts only where the domain has a written dot."""
    domain = DOTTED.sub(".", m["domain"])
    if m["word"] and domain == m["domain"]:
        return None
    if not re.fullmatch(r"[A-Za-z]{2,}", domain.rpartition(".")[2]):
        return None
    return f"{DOTTED.sub('.', m['local'])}@{domain}"


def _digit(m: re.Match) -> str:
    return NUMBER_WORDS["".join(FOLDED.get(c, c) for c in m.group()).lower()]


def _digits(m: re.Match) -> str | None:
    if len(SPELLED_PART.findall(m.group())) < 3:
        return None
    plain = re.sub(WORD_DOT, ".", m.group(), flags=re.IGNORECASE)
    plain = SPELLED_PART.sub(_digit, plain)
    plain = re.sub(r"(?i)\bplus\b", "+", plain)
    return re.sub(r"(?<=[0-9+])[\s,-]{1,2}(?=[0-9])", "", plain)


def normalised(text: str) -> Mapped:
    """The composition of all transducers; the last two change a text only by a written dot or at sign."""
    m = plain_characters(text)
    m = m.rewritten(SPELLED, _digits)
    m = m.rewritten(PLUS, lambda _: "+")
    if DOTTED.search(m.text):
        m = m.rewritten(DOTTED_NUMBERS, lambda x: DOTTED.sub(".", x.group()))
    elif not written_sign(m.text):
        return m
    return m.rewritten(ADDRESS, _address)


def _hashes(words) -> np.ndarray:
    return np.unique(Words(pa.array(list(words)), ASCII_LETTER_DIGIT, LOWER).hashes())


def worded(texts: pa.Array) -> np.ndarray:
    """Which texts may hold a word of LONE_WORDS or three spelled digits, wherever these stand.

    Words are runs of ASCII letters and digits, so a number word beside any other
    sign counts, and "fünf" counts by its last run.
    """
    words = Words(texts, ASCII_LETTER_DIGIT, LOWER)
    hashes = words.hashes()
    number = np.isin(hashes, _hashes(NUMBER_PARTS))
    out = np.bincount(words.doc[number], minlength=len(texts)) >= 3
    out[words.doc[np.isin(hashes, _hashes(LONE_WORDS))]] = True
    return out


def written_sign(text: str) -> bool:
    """Whether a text holds an at sign or a dot in brackets, or an at sign between blanks."""
    return "@" in text and bool(SPACED_AT.search(text)) or any(c in text for c in "([{<") and bool(BRACKETED.search(text))


def disguised(text: str) -> bool:
    """Whether a text holds a character or a sign that some transducer rewrites."""
    if not text.isascii() and (not changed().keys().isdisjoint(text) or any(c in text for c in FOLDED)):
        return True
    return written_sign(text)


def find(text: str | None, worded: bool = True) -> tuple[list, list]:
    """(base, all) spans of a text as (kind, start, end); null or empty: none."""
    if not text:
        return [], []
    base = identifiers(text)
    if not worded and not disguised(text):
        return base, base
    plain = normalised(text)
    if plain.text == text:
        return base, base
    found = list(base)
    for kind, a, b in identifiers(plain.text):
        start, end = plain.source(a, b)
        if not any(k == kind and s <= start and end <= e for k, s, e in found):
            found.append((kind, start, end))
    return base, sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text")
        pairs = [find(text, w) for text, w in zip(texts.to_pylist(), worded(texts), strict=True)]
        columns = {c: batch.column(c) for c in batch.schema.names if c != "text"}
        for kind in KINDS:
            columns[f"n_{kind}"] = pa.array([sum(k == kind for k, _, _ in b) for b, _ in pairs], pa.int64())
        columns["base_sha256"] = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in pairs])
        columns["spans"] = pa.array([written(s) for _, s in pairs])
        columns["n_disguised"] = pa.array([len(s) - len(b) for b, s in pairs], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans per kind, base_sha256, spans, n_disguised: one row per row.

    Offsets count code points, ends exclusive. Null or empty texts have no spans.
    Repeated rows each get their row, null ids stay null, other columns are
    ignored, an empty table gives no rows. A long text is a slice of its own and is
    searched whole. Spans of one kind never overlap; kinds may share characters.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(
        _rows, fields + ", base_sha256 string, spans string, n_disguised bigint"
    )


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
