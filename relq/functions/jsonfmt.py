"""JSON text the way Python's ``json.dumps(..., ensure_ascii=False)`` writes it (H5).

Spark's ``to_json`` is compact (``{"a":1}``); Python separates with ``", "`` and
``": "``.  Objects are therefore assembled with ``concat``, and only string
escaping is delegated to ``to_json``.  The escapes agree except for the hex case
of ``\\u00XX`` control characters, which Python writes in lower case.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters whose \u escape contains a hex letter (the others have no case to fix).
_LETTER_ESCAPES = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]


def _lower_hex(c: Column) -> Column:
    out = c
    for h in _LETTER_ESCAPES:
        # only an escape that is not itself preceded by an escaped backslash
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u" + h, "$1\\\\u" + h.lower())
    return F.when(F.instr(c, "\\u00") > 0, out).otherwise(c)


def json_string(c: Column) -> Column:
    """A string column as a JSON string literal (quoted, escaped); null -> ``null``."""
    j = F.to_json(F.struct(c.alias("s")))  # {"s":"..."}
    quoted = F.substring(j, F.lit(6), F.length(j) - 6)
    return F.when(c.isNull(), F.lit("null")).otherwise(_lower_hex(quoted))


def needs_escape(value: str) -> bool:
    return json.dumps(value, ensure_ascii=False) != '"' + value + '"'


def json_fixed(c: Column, vocabulary) -> Column:
    """A string column whose values all come from ``vocabulary`` (fixed template text).

    Such values need no escaping, so the escape machinery stays out of the plan.
    """
    bad = [v for v in vocabulary if needs_escape(v)]
    if bad:
        raise ValueError(f"vocabulary values need JSON escaping: {bad[:3]}")
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def json_bool(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).when(c, F.lit("true")).otherwise(F.lit("false"))


def json_object(fields: list[tuple[str, Column]]) -> Column:
    """``{"k1": v1, "k2": v2}`` from (key, JSON-text column) pairs."""
    parts: list[Column] = [F.lit("{")]
    for i, (k, v) in enumerate(fields):
        parts.append(F.lit(("" if i == 0 else ", ") + json.dumps(k, ensure_ascii=False) + ": "))
        parts.append(v)
    parts.append(F.lit("}"))
    return F.concat(*parts)


def to_json_spaced(struct_fields: list[tuple[str, Column]]) -> Column:
    """Encode string/boolean columns or nested field lists as one Python-style JSON object."""
    enc = []
    for k, v in struct_fields:
        if isinstance(v, list):
            enc.append((k, to_json_spaced(v)))
        elif isinstance(v, tuple) and v[0] == "bool":
            enc.append((k, json_bool(v[1])))
        else:
            enc.append((k, json_string(v)))
    return json_object(enc)
