"""Grouping and gathers with a fixed order inside arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(value: Column, *order: Column, keep_nulls: bool = False) -> Column:
    """An aggregate: the values as an array in the given order; NULL values are skipped unless kept."""
    pair = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), value.alias("v"))
    rows = F.array_sort(F.collect_list(pair if keep_nulls else F.when(value.isNotNull(), pair)))
    return F.transform(rows, lambda x: x["v"])


def group(df: DataFrame, keys: list[Column | str], order: Column, *aggregates: Column) -> DataFrame:
    """Groups with the place of their first row (``first_ord``), by which they print in order of appearance."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_ord"), *aggregates)


def with_subquery_array(df: DataFrame, gather: DataFrame, name: str) -> DataFrame:
    """An uncorrelated gather (one row, one column) as a column of every row."""
    return df.crossJoin(F.broadcast(gather.select(F.first(gather.columns[0]).alias(name))))
