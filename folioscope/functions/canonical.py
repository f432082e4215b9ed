"""Canonical JSON and content digests.

Canonical means: keys sorted by code point, no spaces, raw Unicode, numbers as
Python spells them, whole numbers of any length kept, the last of repeated keys.
Texts that VARIANT spells the same way stay in the JVM; others cross to Python.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fractions and exponents, long whole numbers, minus zero, escaped characters,
# and characters whose order differs between UTF-16 and code points.
_OTHERWISE = r"[0-9][.eE]|[0-9]{18}|-0|\\u|[^\x{0}-\x{D7FF}]"


def _canonical_udf():
    """The Python form, free of references to this module (it travels by value)."""

    def spelled(text, dropped):
        import json

        try:
            value = json.loads(text)
            if dropped:
                if not isinstance(value, dict):
                    return None
                value = {k: v for k, v in value.items() if k not in dropped}
            out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            out.encode()  # half a surrogate pair has no bytes to hash
            return out
        except (ValueError, RecursionError):
            return None

    @F.arrow_udf(StringType())
    def canonical(texts: pa.Array, fields: pa.Array) -> pa.Array:
        dropped = set(fields[0].as_py().split("\0")[1:]) if len(fields) else set()
        return pa.array([None if t is None else spelled(t, dropped) for t in texts.to_pylist()], pa.string())

    return canonical


_canonical = _canonical_udf()


def _either(json_text: Column, inside: Column, dropped: list[str]) -> Column:
    """``inside`` where VARIANT gives the canonical spelling, the Python form elsewhere."""
    kept = F.when(~json_text.rlike(_OTHERWISE), inside)
    fields = F.lit("\0".join(["", *dropped]))
    # A text VARIANT can't parse may hold a key twice, so Python looks at it too.
    return F.coalesce(kept, _canonical(F.when(kept.isNull(), json_text), fields))


def canonical_json(json_text: Column) -> Column:
    """Sorted keys, no spaces, raw Unicode; NULL when the text is not JSON."""
    return _either(json_text, F.to_json(F.try_parse_json(json_text)), [])


def canonical_sha(json_text: Column) -> Column:
    return F.sha2(canonical_json(json_text), 256)


def drop_fields(json_text: Column, fields: Iterable[str]) -> Column:
    """The JSON object without the named top-level fields, as canonical text."""
    names = list(fields)
    is_object = F.try_variant_get(F.try_parse_json(json_text), "$", "map<string,variant>")
    kept = F.map_filter(is_object, lambda k, _: ~k.isin(*names))
    return _either(json_text, F.to_json(F.try_parse_json(F.to_json(kept))), names)


def json_field(json_text: Column, name: str) -> Column:
    return F.try_variant_get(F.try_parse_json(json_text), f"$.{name}", "string")


def record_json(columns: Iterable[str]) -> Column:
    """A typed record as canonical JSON text, NULL fields kept as JSON null."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def record_sha(columns: Iterable[str]) -> Column:
    return F.sha2(record_json(columns), 256)


def has_non_ascii_key(json_text: Column) -> Column:
    """Flags texts whose key order could differ between UTF-16 and code points."""
    return json_text.rlike(r'"[^"\\]*[^\x00-\x7F][^"\\]*"\s*:')
