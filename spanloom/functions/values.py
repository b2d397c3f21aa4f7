"""Value functions with Postgres rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.errors import DialectError


def divide(a: Column, b: Column, whole: bool) -> Column:
    """Two integers truncate toward zero; a zero divisor gives NULL where it can't be known before."""
    if whole:
        return F.when(b != 0, F.call_function("div", a, b))
    return F.try_divide(a, b)


def substring(text: Column, start: int, length: int | None = None) -> Column:
    """Places before the text count but hold nothing."""
    first = max(start, 1)
    if length is None:
        return F.substring(text, first, 2**31 - 1)
    if length < 0:
        raise DialectError("UDF_ARG_TYPE", "a negative length")
    return F.substring(text, first, max(0, length + min(start - 1, 0)))


def joined(*parts: Column) -> Column:
    """Text concatenation; NULL if any part is."""
    return F.concat(*parts)


def item(array: Column, k: Column | int) -> Column:
    """1-based; out of bounds is an error."""
    return F.element_at(array, F.lit(k) if isinstance(k, int) else k)


def merge_maps(*maps: Column) -> Column:
    """Right wins; a NULL value clears its key. Duplicates are resolved here, whatever the session's policy."""

    def two(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)

    return F.map_filter(reduce(two, maps), lambda _, v: v.isNotNull())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cos_similarity(a: Column, b: Column) -> Column:
    """Vectors of different lengths are refused when evaluated."""
    same = F.assert_true(F.size(a) == F.size(b), F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" values")))
    value = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(same.isNull(), value)


def vector_length(v: Column) -> Column:
    return F.when(v.isNotNull(), F.size(v))


def bits_per_second(text: Column) -> Column:
    """``4500k``, ``3Mi``, ``2MB``: decimal or binary multiples, B for bytes."""
    m = lambda g: F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)([kKMG]?)(i?)(B?)\s*$", g)
    power = F.when(m(2) == "", 0).when(F.lower(m(2)) == "k", 1).when(m(2) == "M", 2).otherwise(3)
    return F.when(m(1) != "", (m(1).cast("double") * F.pow(F.when(m(3) == "i", F.lit(1024.0)).otherwise(F.lit(1000.0)), power) * F.when(m(4) == "B", 8).otherwise(1)).cast("long"))


def zip_arrays(a: Column, b: Column, f) -> Column:
    """Element by element; lengths must agree."""
    return F.when(F.assert_true(F.size(a) == F.size(b), F.lit("BROADCAST_MISMATCH")).isNull(), F.zip_with(a, b, f))
