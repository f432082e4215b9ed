"""Unicode-aware text expressions. All are JVM expressions except ``nfkc``."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Character classes with the meaning of the measured protocol.
# SPACE is every Unicode white space plus the four ASCII separators 1C-1F;
# WORDISH is letters and non-decimal numbers; ALNUM is letters and numbers;
# DIGIT is decimal digits plus the digit characters NFKC leaves alone.
SPACE = r"[\s\x1c-\x1f]"
WORDISH = r"[\p{L}\p{Nl}\p{No}]"
ALNUM = r"[\p{L}\p{N}]"
HYPHEN = r"[-\x{AD}]"
DIGIT = (
    r"[\p{Nd}\x{1369}-\x{1371}\x{19DA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}"
    r"\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{11F50}-\x{11F59}\x{16AC0}-\x{16AC9}\x{1E4F0}-\x{1E4F9}]"
)
CAPTION_LABEL = rf"(?U)^Map{SPACE}+\p{{Nd}}+\.{SPACE}*"


# Blocks of Latin, Greek and Cyrillic letters, punctuation and currency signs. They
# hold no character that could compose with the one before it.
_PLAIN_BLOCKS = [(0x00, 0x2FF), (0x370, 0x482), (0x48A, 0x52F), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x20A0, 0x20BF)]


def _unstable_class() -> str:
    """Pattern for a character that NFKC may change.

    Characters of the plain blocks that NFKC maps to themselves stay as they
    are in any order; everything else is passed on to be normalized.
    """
    ranges: list[list[int]] = []
    for lo, hi in _PLAIN_BLOCKS:
        for c in range(lo, hi + 1):
            if unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)):
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
    return "[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


UNSTABLE = _unstable_class()


def _nfkc_udfs():
    """The two NFKC functions, free of references to this module.

    Functions made inside a function travel to the executors by value, so the
    package need not be installed there.
    """

    def normalized(words):
        # Each different non-ASCII string is normalized once per batch.
        foreign = pc.invert(pc.string_is_ascii(words)).fill_null(False)
        distinct = words.filter(foreign).dictionary_encode()
        plain = pa.array(
            [unicodedata.normalize("NFKC", w) for w in distinct.dictionary.to_pylist()], type=words.type
        )
        return pc.replace_with_mask(words, foreign, plain.take(distinct.indices))

    @F.arrow_udf(StringType())
    def strings(values: pa.Array) -> pa.Array:
        return normalized(values)

    @F.arrow_udf(ArrayType(ArrayType(StringType())))
    def lines(pages: pa.Array) -> pa.Array:
        inner = pages.values
        words = pa.ListArray.from_arrays(inner.offsets, normalized(inner.values))
        return pa.ListArray.from_arrays(pages.offsets, words, mask=pages.is_null())

    return strings, lines


_nfkc_batch, _nfkc_lines_batch = _nfkc_udfs()


def _may_change(col: Column) -> Column:
    """True if NFKC may change the text; ASCII runs are passed over in one step."""
    return F.regexp_replace(col, r"[\x00-\x7F]+", "").rlike(UNSTABLE)


def nfkc(col: Column) -> Column:
    """NFKC form. Only values with a character NFKC may change carry text to Python."""
    return F.coalesce(_nfkc_batch(F.when(_may_change(col), col)), col)


def nfkc_lines(lines: Column) -> Column:
    """NFKC form of each word in an array of lines of words, without NULLs.

    A page crosses to Python once instead of once per word, and only if it
    holds a character that NFKC may change; accented letters alone do not count.
    """
    foreign = F.exists(lines, lambda words: _may_change(F.array_join(words, " ")))
    return F.coalesce(_nfkc_lines_batch(F.when(foreign, lines)), lines)


def is_digits(col: Column) -> Column:
    return col.rlike(f"^{DIGIT}+$")


def dehyphenate(col: Column) -> Column:
    """Join a word split by a hyphen or soft hyphen at a line end."""
    pattern = rf"(?U)({WORDISH}){HYPHEN}{SPACE}*\n{SPACE}*(?={WORDISH})"
    return F.regexp_replace(col, pattern, "$1")


def strip_caption_label(col: Column) -> Column:
    return F.regexp_replace(col, CAPTION_LABEL, "")


def tokens(col: Column) -> Column:
    """White-space units that hold at least one letter or number."""
    return F.filter(F.split(col, rf"(?U){SPACE}+"), lambda t: t.rlike(ALNUM))


def count_tokens(col: Column) -> Column:
    """Number of ``tokens``: one match from a unit's first letter or number to its end.

    Linear in the text; long runs of punctuation are passed over once.
    """
    return F.regexp_count(col, F.lit(rf"(?U){ALNUM}[^\s\x1c-\x1f]*")).cast("bigint")


def ends_in_hyphen(col: Column) -> Column:
    return col.rlike(rf"(?U){WORDISH}{HYPHEN}{SPACE}*$")


def starts_with_letter(col: Column) -> Column:
    return col.rlike(rf"(?U)^{SPACE}*{WORDISH}")


def label_key(col: Column) -> Column:
    """Exact-duplicate key of a label: case, punctuation and spacing removed."""
    spaced = F.regexp_replace(F.lower(col), rf"[^\p{{L}}\p{{N}}]+", " ")
    return F.trim(spaced)


def label_near_key(col: Column) -> Column:
    """Near-duplicate key: the sorted distinct words of ``label_key``."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(label_key(col), " "))), " ")
