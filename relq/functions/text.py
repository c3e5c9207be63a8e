"""String helpers with Python ``str`` semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the code points for which Python's str.isspace() is true (what str.strip() removes).
PY_WHITESPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]

_WS_CHARS = "".join(chr(c) for c in PY_WHITESPACE)

# FIXED VALUES of the sample and answer formats: the input separator, the query marker, the
# code fence an answer may be wrapped in, and the fallback pattern for answers that are not JSON
# (first "relevant": <bool-ish word>).
INPUT_SEP = "\nDocument:"
QUERY_MARK = "Query:"
FENCE_OPEN = "```json"
FENCE_CLOSE = "```"
RELEVANT_RE = r'"relevant"\s*:\s*(true|false|True|False)'


def py_strip(c: Column) -> Column:
    """``str.strip()`` (H7): Spark's one-argument ``trim`` removes spaces only, so the
    full set of Python whitespace is passed as the trim set (no scan of the middle)."""
    return F.trim(c, F.lit(_WS_CHARS))


def split_input(inp: Column) -> Column:
    """``input.split("\\nDocument:", 1)`` as a 1- or 2-element array."""
    return F.split(inp, INPUT_SEP, 2)


def query_part(parts: Column) -> Column:
    """Left part with every ``Query:`` deleted, stripped."""
    return py_strip(F.replace(F.get(parts, 0), F.lit(QUERY_MARK), F.lit("")))


def document_part(parts: Column) -> Column:
    return py_strip(F.get(parts, 1))


def has_separator(parts: Column) -> Column:
    """Rows whose input cannot be split are dropped."""
    return F.size(parts) == 2


def extract_query(inp: Column, strict: bool = False) -> Column:
    """The query of an input; a missing separator is null, or an error when ``strict``.

    Only the text before the first separator is cut out (the document is not copied)."""
    found = F.instr(inp, INPUT_SEP) > 0
    q = py_strip(F.replace(F.substring_index(inp, INPUT_SEP, 1), F.lit(QUERY_MARK), F.lit("")))
    if strict:
        return F.when(found, q).otherwise(
            F.raise_error(F.lit("input has no '\\nDocument:' separator")).cast("string"))
    return F.when(found, q)


def strip_fence(t: Column) -> Column:
    """H9: drop a leading ```json (7 chars), then a trailing ``` (3 chars)."""
    t1 = F.when(t.startswith(FENCE_OPEN), F.substring(t, F.lit(len(FENCE_OPEN) + 1), F.length(t))).otherwise(t)
    return F.when(t1.endswith(FENCE_CLOSE), F.substring(t1, F.lit(1), F.length(t1) - len(FENCE_CLOSE))).otherwise(t1)


def brace_slice(t: Column) -> Column:
    """``t[t.find('{') : t.rfind('}') + 1]`` when that is non-empty, else null."""
    start = F.instr(t, "{")  # 1-based, 0 when absent
    from_end = F.instr(F.reverse(t), "}")
    end_excl = F.length(t) - from_end + 1  # 0-based exclusive end; 0 when no '}'
    ok = (start > 0) & (from_end > 0) & (end_excl > start - 1)
    return F.when(ok, F.substring(t, start, end_excl - start + 1))


def regex_flag(t: Column) -> Column:
    """The fallback regex; null when nothing matches."""
    word = F.regexp_extract(t, RELEVANT_RE, 1)
    return F.when(word != "", F.lower(word) == "true")
