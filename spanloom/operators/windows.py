"""Count windows (tumbling, hopping, short tail), time windows and tick intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.errors import DialectError


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """A 0-based number within the keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def count_windows(df: DataFrame, width: int, stride: int, keys: list[str], order: list[str], tail: bool = True) -> DataFrame:
    """Rows with the ``win`` they belong to, repeated where windows overlap, and whether it is the short ``tail``.

    A window leaves once ``width`` rows are there and drops ``stride``; what remains leaves once at the end.
    """
    if not 0 < stride <= width:
        raise DialectError("UDF_ARG_TYPE", "a stride is above 0 and at most the width")
    rows = numbered(df, keys, order).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    full = F.when(F.col("n") >= width, F.floor((F.col("n") - width) / stride) + 1).otherwise(0).cast("long")
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - (width - 1)) / stride)).cast("long")
    last = F.least(F.floor(F.col("rn") / stride).cast("long"), full - 1)
    whole = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    some = F.when(F.col("rn") >= full * stride, F.array_append(whole, full)).otherwise(whole) if tail else whole
    return rows.withColumn("full", full).withColumn("win", F.explode(some)).withColumn("tail", F.col("win") == F.col("full")).drop("full", "n")


def time_windows(df: DataFrame, ts: str, width: str, slide: str | None, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates of event-time windows: win_start, win_end and the keys."""
    out = df.groupBy(F.window(ts, width, slide), *keys).agg(*aggregates)
    return out.select(*keys, F.col("window.start").alias("win_start"), F.col("window.end").alias("win_end"), *[c for c in out.columns if c != "window" and c not in keys])


def tick_intervals(ticks: DataFrame, at: str, keys: list[str], order: list[str]) -> DataFrame:
    """``until``: where a tick ends, the next one's time; the last takes the rest."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    return ticks.withColumn("until", F.coalesce(F.lead(at).over(w), F.lit(float("inf"))))


def spine(df: DataFrame, keys: list[str], at: str, step: float) -> DataFrame:
    """Ticks at a rate from the first to the last time of each key."""
    out = df.groupBy(*keys).agg(F.floor(F.min(at) / step).alias("a"), F.floor(F.max(at) / step).alias("z"))
    return out.select(*keys, F.explode(F.sequence("a", "z")).alias("__k")).select(*keys, (F.col("__k") * step).alias(at))
