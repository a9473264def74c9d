"""Deterministic identities: path id, condition seed, run id, response cache key.

All are SHA-256 based column expressions (``sha2``), reproducible across
processes and identical in DuckDB (``sha256``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\x1f"  # unit separator between key parts

_PRINTABLE = r"\A[ -~]*\z"  # not ^..$: in Java $ also matches before a final line break
_SHORT_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _hex4(cp: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(cp)), 4, "0"))


def _escape_char(c: Column) -> Column:
    cp = F.ascii(c).cast("long")
    expr = None
    for raw, esc in _SHORT_ESCAPES.items():
        expr = F.when(c == raw, esc) if expr is None else expr.when(c == raw, esc)
    off = cp - 0x10000
    pair = F.concat(_hex4(F.shiftright(off, 10) + 0xD800), _hex4((off % 1024) + 0xDC00))
    return (expr.when(c.rlike(_PRINTABLE), c)
            .when(cp < 0x10000, _hex4(cp))
            .otherwise(pair))


def json_escape(col: Column) -> Column:
    """The body of a JSON string literal exactly as Python's ``json.dumps`` writes it.

    ASCII-only output (``ensure_ascii``): quote and backslash escaped, the five
    short control escapes, other control and non-ASCII characters as
    lower-case ``\\uXXXX`` (surrogate pairs above the BMP).  Plain printable
    ASCII takes a two-``replace`` fast path; the per-character transform only
    runs on strings that need it.  Escaping is per character, so the escape
    of a concatenation is the concatenation of the escapes.
    """
    simple = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    slow = F.array_join(F.transform(F.split(col, ""), _escape_char), "")
    return F.when(col.rlike(_PRINTABLE), simple).otherwise(slow)


def json_quote(col: Column) -> Column:
    """A JSON string literal (``json.dumps`` of one string)."""
    return F.concat(F.lit('"'), json_escape(col), F.lit('"'))


def py_json_escape(s: str) -> str:
    """Driver-side escape of a literal (same rules)."""
    return json.dumps(s)[1:-1]


def path_id(signature: Column, turns: Column, quoted_turns: Column | None = None, plain: Column | None = None) -> Column:
    """First 16 hex chars of SHA-256 over ``{"signature": s, "turns": [...]}``.

    Same canonical text as ``json.dumps({...}, sort_keys=True)``: keys sorted,
    ``", "`` and ``": "`` separators.  ``quoted_turns`` is the already quoted,
    comma-joined turn list when the caller built it without a lambda; ``plain``
    says that the signature is its own JSON escape.
    """
    body = quoted_turns if quoted_turns is not None else F.array_join(F.transform(turns, json_quote), ", ")
    name = json_quote(signature)
    if plain is not None:
        name = F.when(plain, F.concat(F.lit('"'), signature, F.lit('"'))).otherwise(name)
    doc = F.concat(F.lit('{"signature": '), name, F.lit(', "turns": ['), body, F.lit("]}"))
    return F.substring(F.sha2(doc, 256), 1, 16)


def keyed_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEP, *[p.cast("string") for p in parts]), 256)


def key_head(*parts: Column) -> Column:
    """The first parts of a key as one: ``keyed_hash(key_head(a, b), c)`` equals ``keyed_hash(a, b, c)`` (null parts are left out)."""
    return F.when(F.coalesce(*[p.cast("string") for p in parts]).isNotNull(), F.concat_ws(SEP, *[p.cast("string") for p in parts]))


def condition_seed(*parts: Column) -> Column:
    """Reproducible 28-bit seed from the condition key (first 7 hex digits)."""
    return F.conv(F.substring(keyed_hash(*parts), 1, 7), 16, 10).cast("int")


def run_id(*parts: Column) -> Column:
    """Deterministic run id: re-generating a manifest yields the same keys."""
    return keyed_hash(*parts)


# DuckDB spellings of the same identities (for the oracles).
def sql_keyed_hash(*parts: str) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def sql_condition_seed(*parts: str) -> str:
    return f"CAST(('0x' || left({sql_keyed_hash(*parts)}, 7)) AS INTEGER)"


def sql_json_quote_ascii(x: str) -> str:
    """Oracle JSON quoting, valid for printable-ASCII text (all driver text used)."""
    return f"('\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"')"


def sql_path_id(signature: str, turns: str) -> str:
    q = sql_json_quote_ascii("t_")
    return ("left(sha256('{\"signature\": ' || " + sql_json_quote_ascii(signature) +
            " || ', \"turns\": [' || array_to_string(list_transform(" + turns + ", lambda t_: " + q +
            "), ', ') || ']}'), 16)")


def sql_json_quote(x: str) -> str:
    """Oracle JSON quoting with ``ensure_ascii`` semantics (BMP text)."""
    return ("('\"' || array_to_string(list_transform(string_split(" + x + ", ''), lambda c_: CASE "
            "WHEN c_ = '\"' THEN '\\\"' WHEN c_ = '\\' THEN '\\\\' "
            "WHEN unicode(c_) BETWEEN 32 AND 126 THEN c_ "
            "WHEN c_ = chr(10) THEN '\\n' WHEN c_ = chr(13) THEN '\\r' WHEN c_ = chr(9) THEN '\\t' "
            "WHEN c_ = chr(8) THEN '\\b' WHEN c_ = chr(12) THEN '\\f' "
            "ELSE printf('\\u%04x', unicode(c_)) END), '') || '\"')")
