"""Canonical text of values of any type, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a list's items are joined, and the suffix of a UTC time.
ITEM_SEPARATOR, UTC_SUFFIX = ", ", "+00:00"


def canon(value: Column, kind: T.DataType, ordered: bool = False) -> Column:
    """The canonical text of a value; a null is the empty text.

    Booleans are true and false; dates and times are UTC with whole seconds; floats have at most six decimals
    without trailing zeros (NaN, infinities and numbers too large for that as Spark prints them); decimals keep
    their scale; lists are their items' texts in byte order (in their own with ``ordered``, which holds for the
    outermost list only), nulls and repeats kept; structs, maps and binaries are JSON, the last as base64.
    """
    return F.coalesce(_text(value, kind, ordered), F.lit(""))


def _text(value: Column, kind: T.DataType, ordered: bool) -> Column:
    if isinstance(kind, T.BooleanType):
        return value.cast("string")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(UTC_SUFFIX))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        exact = F.round(value.cast("double"), 6).try_cast("decimal(38,6)").cast("string")
        return F.coalesce(F.regexp_replace(exact, r"\.?0+$", ""), value.cast("string"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: canon(x, kind.elementType))
        return F.array_join(items if ordered else F.array_sort(items), ITEM_SEPARATOR)
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.to_json(value)
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    return value.cast("string")
