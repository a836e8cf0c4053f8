"""Canonical form of JSON documents that are stored as text.

The JVM's own parser and writer already sort keys and drop blanks, so they do
the work for plain documents.  A document with numbers the JVM prints its own
way (``1e7``, ``1.50``, integers beyond 15 digits), escapes, integer-like keys
or repeated keys is passed to an Arrow function instead; the others reach that
function as nulls.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Signs in keys and strings that the built-in parser and writer may not reproduce a document exactly.
_UNUSUAL = r'\\[^nt"\\]|"[0-9]+"\s*:|[^\x00-\x{D7FF}]'
#: Numbers that the built-in writer prints its own way: exponents, fractions that end in zero or are tiny,
#: 16 digits and more, negative zero.
_ODD_NUMBER = r"[0-9][eE]|\.[0-9]*0(?![0-9])|[0-9.]{16}|-0(?![.0-9])|0\.00000"

_SHORT_ESCAPE = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}
_TO_ESCAPE = re.compile('[\x00-\x1f"\\\\\ud800-\udfff]')


def quote(text: str) -> str:
    """JSON string literal with the escapes of ``JSON.stringify``."""
    return '"' + _TO_ESCAPE.sub(lambda m: _SHORT_ESCAPE.get(ord(m[0])) or f"\\u{ord(m[0]):04x}", text) + '"'


def number_text(value: float) -> str:
    """JavaScript's text of a double (also the tests' independent check)."""
    if value == 0:
        return "0"
    if math.isinf(value) or math.isnan(value):
        return "null"
    sign = "-" if value < 0 else ""
    mantissa, _, exponent = repr(abs(value)).partition("e")
    left, _, right = mantissa.partition(".")
    digits = (left + right).lstrip("0")
    point = len(left) + int(exponent or 0) - (len(left + right) - len(digits))
    digits = digits.rstrip("0")
    if len(digits) <= point <= 21:
        return sign + digits.ljust(point, "0")
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    tail = "." + digits[1:] if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{tail}e{point - 1:+d}"


def name_order(key: str) -> tuple:
    """Sort key of a property name: integer-like names by value, then UTF-16 order."""
    if key.isascii() and key.isdigit() and str(int(key)) == key and int(key) < 2**32 - 1:
        return (0, int(key), b"")
    return (1, 0, key.encode("utf-16-be", "surrogatepass"))


def _write(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, float):
        return number_text(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    return "{" + ",".join(f"{quote(k)}:{_write(value[k])}" for k in sorted(value, key=name_order)) + "}"


def canonical_text(document: str) -> str:
    """Canonical JSON of one document; a repeated key keeps its last value."""
    return _write(json.loads(document, parse_int=float))


@F.arrow_udf(T.StringType())
def _canonical(documents: pa.Array) -> pa.Array:
    return pa.array([None if d is None else canonical_text(d) for d in documents.to_pylist()], pa.string())


def with_canonical_json(frame: DataFrame, source: Column, name: str) -> DataFrame:
    """``frame`` with the canonical form of a JSON text column as ``name``.

    Null stays null; text that is not JSON raises.
    """
    # Strings are left out, their escapes first, when numbers are looked at.
    numbers = F.regexp_replace(F.regexp_replace(source, r"\\.", ""), '"[^"]*"', "")
    usual = ~source.rlike(_UNUSUAL) & ~numbers.rlike(_ODD_NUMBER)
    plain = F.when(usual, F.to_json(F.try_parse_json(source)))
    rest = F.when(F.col(name).isNull(), source)
    return frame.withColumn(name, plain).withColumn(name, F.coalesce(name, _canonical(rest)))
