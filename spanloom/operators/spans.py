"""Rows that carry a time span: runs that merge, keyed spans that are reduced, change points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.errors import DialectError


def bound(name: str) -> Column:
    """A span bound as a number; anything else counts as 0."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def runs_of(df: DataFrame, distance: float, keys: list[str], order: list[str], start: str = "start_t", end: str = "end_t") -> DataFrame:
    """The rows with the ``run`` they belong to, as :func:`merge_runs` tells runs apart."""
    w = Window.partitionBy(*keys).orderBy(bound(start), *order)
    reach = F.max(bound(end)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (bound(start) - reach > distance), 1).otherwise(0)
    return df.withColumn("__new", fresh).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_runs(df: DataFrame, distance: float, keys: list[str], order: list[str], start: str = "start_t", end: str = "end_t", text: str | None = None, others: list[str] | None = None) -> DataFrame:
    """Runs per key: a row whose start is at most ``distance`` past the furthest end of its run joins it.

    A run has its first row's start and other fields, its furthest end, its texts joined by a space (NULLs
    skipped), and ``n_rows``. Ties of start go by ``order``. A run's end takes its rows only, not earlier runs': with
    rows that end before they start the furthest end so far could be an earlier run's, but then the row would have
    joined that run.
    """
    if distance < 0:
        raise DialectError("UDF_ARG_TYPE", "a negative distance")
    runs = runs_of(df, distance, keys, order, start, end).withColumn("__s", bound(start)).withColumn("__e", bound(end))
    first = F.struct("__s", *order)
    out = [F.min("__s").alias(start), F.max("__e").alias(end), F.count("*").alias("n_rows")]
    out += [F.min_by(c, first).alias(c) for c in others or []]
    if text:
        pieces = F.array_sort(F.collect_list(F.struct("__s", *order, F.col(text).alias("__text"))))
        out.append(F.array_join(F.transform(F.filter(pieces, lambda x: x["__text"].isNotNull()), lambda x: x["__text"]), " ").alias(text))
    return runs.groupBy(*keys, "run").agg(*out)


def merge_spans(df: DataFrame, max_span: float, keys: list[str], at: str, tick_end: str, start: str, fields: list[str]) -> DataFrame:
    """Rows of one ``start`` are one span: the last row's fields, ending where the last tick that carried it ends.

    Spans longer than ``max_span`` are cut there and go on as new ones; rows without a start are dropped. A stretch
    that no row reaches makes no span.
    """
    if max_span <= 0:
        raise DialectError("UDF_ARG_TYPE", "a span length must be above zero")
    rows = df.where(F.col(start).isNotNull()).withColumn("__cut", F.greatest(F.lit(0), F.floor((F.col(at) - F.col(start)) / max_span)).cast("long"))
    newest = F.struct(at, tick_end, *fields)  # ties of time go by the other fields
    last = [F.max_by(c, newest).alias(c) for c in fields]
    out = rows.groupBy(*keys, start, "__cut").agg(F.max_by(tick_end, newest).alias("__end"), F.count("*").alias("n_rows"), *last)
    low = F.col(start) + F.col("__cut") * max_span
    return out.select(*keys, low.alias("span_start"), F.least(F.col("__end"), low + max_span).alias("span_end"), "n_rows", *fields)


def change_points(df: DataFrame, value: str, threshold: float, keys: list[str], order: list[str]) -> DataFrame:
    """``shot``: a counter that steps where the value moves by more than the threshold from one row to the next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(F.abs(F.col(value) - F.lag(value).over(w)) > threshold, 1).otherwise(0)
    return df.withColumn("__step", step).withColumn("shot", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("__step")


def key_groups(df: DataFrame, key_flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """``grp``: counts the rows that open a group; rows before the first are group 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("grp", F.sum(F.when(key_flag, 1).otherwise(0)).over(w))


def captions_until_next(df: DataFrame, at: str, keys: list[str], order: list[str]) -> DataFrame:
    """Each row as a span to the next row's time; the last one ends where it starts."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    return df.withColumn("start_t", F.col(at)).withColumn("end_t", F.coalesce(F.lead(at).over(w), F.col(at)))


def midpoints(df: DataFrame, at: str, keys: list[str], order: list[str]) -> DataFrame:
    """Each row, and again halfway to its neighbour."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    half = (F.col(at) + F.lead(at).over(w)) / 2
    return df.withColumn("__half", half).withColumn(at, F.explode(F.when(F.col("__half").isNull(), F.array(at)).otherwise(F.array(F.col(at), F.col("__half"))))).drop("__half")


def recent_extent(df: DataFrame, value: str, seconds: float, at: str, keys: list[str]) -> DataFrame:
    """Least and greatest value of the last so many seconds."""
    w = Window.partitionBy(*keys).orderBy((F.col(at) * 1_000_000).cast("long")).rangeBetween(-int(seconds * 1_000_000), 0)
    return df.withColumn("low", F.min(value).over(w)).withColumn("high", F.max(value).over(w))
