"""A cell's value as document text and as canonical JSON.

Each is a built-in expression chosen from the column's data type, so it runs
inside the JVM next to the scan.  Expressions are built as SQL text, one call
per cell, since a table may have hundreds of columns.  Only JSON kept as text
with numbers or escapes that the JVM prints another way goes through
:mod:`inktally.functions.json_text`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inktally.functions.json_text import name_order, quote
from inktally.functions.numbers import bind_sql, js_number_sql

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType)
_FLOATS = (T.FloatType, T.DoubleType)
_TEXTS = (T.StringType, T.CharType, T.VarcharType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_JSON_NAMES = ("json", "jsonb")
_INTERVALS = (T.DayTimeIntervalType, T.YearMonthIntervalType)


def literal(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def cell(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def in_utc(session: SparkSession) -> bool:
    """Whether the session's time zone is UTC, which allows shorter expressions."""
    return session.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z", "GMT", "+00:00")


def iso_millis_sql(x: str, kind: T.DataType, utc_session: bool) -> str:
    """Date or timestamp as ``2024-01-02T03:04:05.678Z``: UTC, cut to milliseconds.

    Right under any session time zone unless ``utc_session`` says it is UTC.
    Years outside 1-9999 get four digits up to 9999, else a sign and six digits.
    """
    if utc_session:
        usual = f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
        utc = f"cast({x} as timestamp_ntz)"
    else:
        utc = _utc_sql(x, kind)
        text = f"cast({utc} as string)"
        usual = (
            f"concat(translate(substring({text}, 1, 19), ' ', 'T'), '.', rpad(substring({text}, 21, 3), 3, '0'), 'Z')"
        )
    # All that follows the year: -MM-dd HH:mm:ss with up to six decimals.
    year = (
        "if(year(t) between 0 and 9999, lpad(cast(year(t) as string), 4, '0'), "
        "concat(if(year(t) < 0, '-', '+'), lpad(cast(abs(year(t)) as string), 6, '0')))"
    )
    rest = "regexp_extract(cast(t as string), r'^[+-]?\\d+(-.*)$', 1)"
    far = (
        f"concat({year}, substring({rest}, 1, 6), 'T', substring({rest}, 8, 8), '.', "
        f"rpad(substring({rest}, 17, 3), 3, '0'), 'Z')"
    )
    return (
        f"case when {utc} >= timestamp_ntz'0001-01-01 00:00:00' and {utc} < timestamp_ntz'9999-12-31 00:00:00' "
        f"then {usual} when {x} is not null then {bind_sql(utc, 't', far)} end"
    )


def _utc_sql(x: str, kind: T.DataType) -> str:
    """The instant as a timestamp without a zone, in UTC."""
    if isinstance(kind, T.TimestampType):
        seconds = f"cast(cast(unix_micros({x}) as decimal(20,0)) / 1000000 as decimal(18,6))"
        return f"(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}))"
    return f"cast({x} as timestamp_ntz)"


def iso_millis(x: str, kind: T.DataType, session: SparkSession) -> Column:
    """Column of :func:`iso_millis_sql`."""
    return F.expr(iso_millis_sql(x, kind, in_utc(session)))


def json_string_sql(x: str) -> str:
    """A JSON string literal; null stays null.

    Escapes of control characters have upper-case hex digits until
    :func:`lower_hex_sql` is applied to the whole.
    """
    # {"v":"..."} without its frame: the text before the closing brace ends with a quote.
    return f"case when {x} is not null then rtrim('}}', substr(to_json(named_struct('v', {x})), 6)) end"


def lower_hex_sql(json: str, checked: bool = True) -> str:
    """JSON written by the JVM with the escapes of ``JSON.stringify``: ``\\u001f``, not ``\\u001F``.

    A pair of backslashes is set aside first, as it may precede the letters
    ``u001F`` of the text itself; JSON holds no raw control character that
    could be mistaken for its stand-in.  ``checked`` looks for such escapes
    first; without it ``json`` is written once, for expressions used seldom.
    """
    pair, stand_in = literal(chr(92) * 2), "char(1)"
    out = f"replace({json}, {pair}, {stand_in})"
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        out = f"replace({out}, {literal(f'{chr(92)}u{code:04X}')}, {literal(f'{chr(92)}u{code:04x}')})"
    out = f"replace({out}, {stand_in}, {pair})"
    if not checked:
        return out
    return f"case when contains({json}, {literal(chr(92) + 'u00')}) then {out} else {json} end"


def _bytes_sql(x: str) -> str:
    """A byte buffer as an object from index to byte."""
    item = f"concat('\"', i - 1, '\":', conv(hex(substr({x}, i, 1)), 16, 10))"
    items = f"array_join(transform(sequence(1, length({x})), i -> {item}), ',')"
    return f"case when length({x}) = 0 then '{{}}' when {x} is not null then concat('{{', {items}, '}}') end"


def _interval_sql(x: str, kind: T.DataType) -> str:
    """An interval as an object of its parts that are not zero."""
    if isinstance(kind, T.YearMonthIntervalType):
        parts = [(n, f"extract({n} from {x})", None) for n in ("month", "year")]
    else:
        second = f"extract(second from {x})"
        whole = f"cast({second} as int)"
        millis = f"cast(({second} - {whole}) * 1000 as double)"
        parts = [
            ("day", f"extract(day from {x})", None),
            ("hour", f"extract(hour from {x})", None),
            ("millisecond", millis, js_number_sql(millis)),
            ("minute", f"extract(minute from {x})", None),
            ("second", whole, None),
        ]
    made = ", ".join(
        f"if({number} <> 0, concat('\"{name}s\":', {text or number}), null)" for name, number, text in parts
    )
    return f"if({x} is not null, concat('{{', concat_ws(',', {made}), '}}'), null)"


def json_sql(x: str, kind: T.DataType, utc_session: bool, inside: str = "column", depth: int = 0) -> str:
    """Canonical JSON of one value as SQL text, never null (null is the text ``null``).

    ``inside`` is ``column``, ``array`` or ``json``: a 64-bit integer or decimal
    is a string when it is the cell itself, while a decimal in an array and any
    number in a JSON document is a number.
    """
    if isinstance(kind, _TEXTS):
        out = json_string_sql(x)
    elif isinstance(kind, (*_WHOLE, T.BooleanType, T.NullType)):
        out = f"cast({x} as string)"
    elif isinstance(kind, T.LongType) and inside != "json" or isinstance(kind, T.DecimalType) and inside == "column":
        out = f"concat('\"', cast({x} as string), '\"')"
    elif isinstance(kind, (T.LongType, T.DecimalType)):
        out = js_number_sql(f"cast({x} as double)")
    elif isinstance(kind, _FLOATS):
        number = js_number_sql(x, isinstance(kind, T.FloatType))
        out = f"if(isnan({x}) or abs({x}) = double('Infinity'), null, {number})"
    elif isinstance(kind, _TIMES):
        out = f"concat('\"', {iso_millis_sql(x, kind, utc_session)}, '\"')"
    elif isinstance(kind, T.BinaryType):
        out = _bytes_sql(x)
    elif isinstance(kind, _INTERVALS):
        out = _interval_sql(x, kind)
    elif isinstance(kind, T.ArrayType):
        deeper = "array" if inside == "column" else inside
        item = json_sql(f"x{depth}", kind.elementType, utc_session, deeper, depth + 1)
        out = f"concat('[', array_join(transform({x}, x{depth} -> {item}), ','), ']')"
    elif isinstance(kind, T.StructType):
        members = [
            (f.name, json_sql(f"{x}.{cell(f.name)}", f.dataType, utc_session, "json", depth)) for f in kind.fields
        ]
        made = [
            part
            for place, (name, value) in enumerate(sorted(members, key=lambda m: name_order(m[0])))
            for part in (literal(f"{',' if place else ''}{quote(name)}:"), value)
        ]
        out = f"if({x} is not null, concat('{{', {''.join(p + ', ' for p in made)}'}}'), null)"
    elif isinstance(kind, T.MapType):
        e, value = f"x{depth}", json_sql(f"x{depth}.value", kind.valueType, utc_session, "json", depth + 1)
        entries = f"transform(map_entries({x}), {e} -> struct(cast({e}.key as string) as k, {value} as v))"
        pair = f"concat({json_string_sql(f'{e}.k')}, ':', {e}.v)"
        out = f"concat('{{', array_join(transform(array_sort({entries}), {e} -> {pair}), ','), '}}')"
    elif isinstance(kind, T.VariantType):
        out = f"to_json({x})"
    else:
        raise TypeError(f"no JSON form for {kind.simpleString()}")
    return f"coalesce({out}, 'null')"


def holds_variant(kind: T.DataType) -> bool:
    """Whether a type is a variant or has one at any depth."""
    if isinstance(kind, T.ArrayType):
        return holds_variant(kind.elementType)
    if isinstance(kind, T.MapType):
        return holds_variant(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(holds_variant(f.dataType) for f in kind.fields)
    return isinstance(kind, T.VariantType)


def is_document(kind: T.DataType, declared: str) -> bool:
    """Whether a cell is a JSON document: a variant, a value with variants inside, or text declared ``json``."""
    return holds_variant(kind) or isinstance(kind, _TEXTS) and declared.lower() in _JSON_NAMES


def document_source(name: str, kind: T.DataType, utc_session: bool) -> Column:
    """The JSON text of a document cell, null when the cell is null.

    Variants are still in the JVM's form; the rest of a nested value is canonical
    and stays as it is when the whole text is made so.
    """
    x = cell(name)
    if isinstance(kind, _TEXTS):
        return F.expr(x)
    return F.expr(f"if({x} is not null, {json_sql(x, kind, utc_session)}, null)")


def _writer_sql(x: str, kind: T.DataType, utc_session: bool) -> str | None:
    """The value in a type that the JVM's JSON writer prints as wanted, or None."""
    if isinstance(kind, (*_TEXTS, *_WHOLE, T.BooleanType)):
        return x
    if isinstance(kind, (T.LongType, T.DecimalType)):
        return f"cast({x} as string)"
    if isinstance(kind, _TIMES):
        return iso_millis_sql(x, kind, utc_session)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (*_TEXTS, *_WHOLE, T.BooleanType)):
        return x
    return None


def json_object_sql(members: Sequence[tuple[str, str, T.DataType | None]], utc_session: bool) -> str:
    """Canonical JSON object of (name, SQL text, type): keys sorted, nulls kept, no blanks.

    Neighbours that the JVM's JSON writer prints as wanted go through it
    together; the others are put in between.  A type of None marks a value that
    is JSON already.  :func:`lower_hex_sql` is still to be applied.
    """
    parts: list[str] = []
    together: list[str] = []

    def flush() -> None:
        if together:
            made = f"to_json(named_struct({', '.join(together)}), map('ignoreNullFields', 'false'))"
            # Without the braces; no value that goes through the writer ends with one itself.
            parts.append(f"rtrim('}}', substr({made}, 2))")
            together.clear()

    for name, x, kind in sorted(members, key=lambda member: name_order(member[0])):
        plain = None if kind is None else _writer_sql(x, kind, utc_session)
        if plain is not None:
            together += [literal(name), plain]
            continue
        flush()
        value = f"coalesce({x}, 'null')" if kind is None else json_sql(x, kind, utc_session)
        parts.append(f"concat({literal(quote(name) + ':')}, {value})")
    flush()
    if not parts:
        return "'{}'"
    return f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')"


def text_value(name: str, kind: T.DataType, utc_session: bool) -> Column:
    """A cell as document text, null when the cell is null."""
    x = cell(name)
    if isinstance(kind, _TEXTS):
        return F.expr(x)
    if isinstance(kind, _FLOATS):
        return F.expr(js_number_sql(x, isinstance(kind, T.FloatType)))
    if isinstance(kind, _TIMES):
        return F.expr(iso_millis_sql(x, kind, utc_session))
    if isinstance(kind, (*_WHOLE, T.LongType, T.DecimalType, T.BooleanType)):
        return F.expr(f"cast({x} as string)")
    json = bind_sql(json_sql(x, kind, utc_session), "j", lower_hex_sql("j"))
    return F.expr(f"if({x} is not null, {json}, null)")


def json_document_text(canonical: Column) -> Column:
    """A canonical JSON document as text: objects and arrays as they are, scalars bare."""
    scalar = F.from_json(F.concat(F.lit("["), canonical, F.lit("]")), "array<string>")[0]
    return (
        F.when(canonical == "null", F.lit(None).cast("string"))
        .when(F.startswith(canonical, F.lit('"')), scalar)
        .otherwise(canonical)
    )
