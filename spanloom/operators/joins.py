"""Joins of row relations, gap fill, and the single row beside many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.errors import DialectError

#: Rows up to which the other side is broadcast; counted, not assumed.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows (no more are counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join(left: DataFrame, right: DataFrame, on: Column | list[str] | str, how: str = "inner") -> DataFrame:
    if how not in ("inner", "left", "full"):
        raise DialectError("UNSUPPORTED_SQL", f"no {how} join", hint="write the sides the other way round")
    return left.join(right, on, how)


def gap_fill(df: DataFrame, **fills: Column) -> DataFrame:
    """Named columns take the fill where a join left them NULL."""
    return df.withColumns({c: F.coalesce(F.col(c), f) for c, f in fills.items()})


def beside(df: DataFrame, single: DataFrame) -> DataFrame:
    """A relation of exactly one row repeated on every row; checked on two rows at most."""
    rows = single.limit(2).collect()
    if len(rows) != 1:
        raise DialectError("BROADCAST_MISMATCH", "one row is needed beside the others")
    return df.select("*", *(F.lit(rows[0][c]).cast(single.schema[c].dataType).alias(c) for c in single.columns))


def band_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """Points within closed spans of the same keys, as an equi-join on time buckets of ``width``.

    A span is repeated once a bucket it touches; choose a width about as long as a span.
    """
    p = points.withColumn("__bucket", F.floor(F.col(at) / width))
    s = spans.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    test = (p["__bucket"] == s["__bucket"]) & (p[at] >= s[low]) & (p[at] <= s[high])
    for k in keys:
        test = test & (p[k] == s[k])
    return p.join(s, test, how).drop(s["__bucket"]).drop(*(s[k] for k in keys)).drop("__bucket")
