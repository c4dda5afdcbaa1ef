"""JSON text in the two layouts the data model uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASCII_OPTIONS = {"writeNonAsciiCharacterAsCodePoint": "true"}
_ESCAPED_BACKSLASH = "\x01"  # no JSON text holds this character as it is
_REST = 1 << 30


def quoted_ascii(c: Column) -> Column:
    """A JSON string literal in pure ASCII, other characters as lower-case UTF-16 escapes.

    Spark writes the escapes in upper case: the text is cut at the escapes, and the four digits
    that open every further piece are lowered.
    """
    quoted = F.to_json(F.array(c), _ASCII_OPTIONS)
    # With "escaped backslash" out of the way, every backslash left begins an escape.
    plain = F.replace(quoted, F.lit("\\\\"), F.lit(_ESCAPED_BACKSLASH))
    pieces = F.transform(
        F.split(plain, r"\\u", -1),
        lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lower(F.substring(p, 1, 4)), F.substring(p, 5, _REST))),
    )
    joined = F.replace(F.array_join(pieces, "\\u"), F.lit(_ESCAPED_BACKSLASH), F.lit("\\\\"))
    joined = F.replace(joined, F.lit("\x7f"), F.lit("\\u007f"))
    # The brackets of the array stand outside the quotes of its only element.
    return F.when(c.isNotNull(), F.btrim(joined, F.lit("[]")))


def _number(c: Column) -> Column:
    """A double as most scripting languages print it: digits up to 16 places before the point and from
    four after it, else an exponent of two digits at least."""
    text = c.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    short = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    size = F.abs(c)
    return (
        F.when(F.isnan(c) | (size == float("inf")), text)
        .when(~F.contains(text, F.lit("E")), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(short)
    )


def _value(c: Column, kind: T.DataType) -> Column:
    """The JSON text of a value; null is the word."""
    if isinstance(kind, T.StringType):
        text = quoted_ascii(c)
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        text = _number(c.cast("double"))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda e: _value(e, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(inner, ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(quoted_ascii(e["key"].cast("string")), F.lit(": "), _value(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), entry), ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        parts = [F.concat(quoted_ascii(F.lit(f.name)), F.lit(": "), _value(c.getField(f.name), f.dataType)) for f in kind.fields]
        text = F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    else:
        text = quoted_ascii(c.cast("string"))
    return F.coalesce(text, F.lit("null"))


def json_object(schema: T.StructType, columns: list[str], compact: bool = False) -> Column:
    """Columns as one JSON object in column order, nulls kept.

    The default layout has a blank after ``,`` and ``:`` and ASCII escapes, as most scripting
    languages print it; ``compact`` is Spark's own UTF-8 ``to_json``.
    """
    if compact:
        fields = [F.col(f"`{c}`").alias(c) for c in columns]
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    parts: list[Column] = []
    for i, c in enumerate(columns):
        parts.append(F.concat(F.lit(", " if i else "{"), quoted_ascii(F.lit(c)), F.lit(": ")))
        parts.append(_value(F.col(f"`{c}`"), schema[c].dataType))
    return F.concat(*parts, F.lit("}"))
