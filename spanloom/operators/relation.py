"""An ordered relation: DataFrame operations that carry the row order as a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.errors import DialectError
from spanloom.streaming.streams import base_dir
from spanloom.types import refuse_vectors

ORD = "__ord"


class Relation:
    """Rows with an order that survives filters, projections, joins and unions.

    The order is a struct of the source's own ordering columns, so no global numbering (and no single task) is
    needed; joins and unions nest it.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def of(cls, df: DataFrame, *order: str | Column) -> Relation:
        return cls(df.withColumn(ORD, F.struct(*order)))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ORD]

    def where(self, test: Column) -> Relation:
        return Relation(self.df.where(test))

    def check(self, test: Column, message: str) -> Relation:
        """An assertion: a row for which it doesn't hold ends the query."""
        return Relation(self.df.where(F.coalesce(F.assert_true(test, F.lit(message)).isNull(), F.lit(True))))

    def project(self, *columns: Column | str) -> Relation:
        return Relation(self.df.select(*columns, ORD))

    def star(self, leave: tuple[str, ...] = (), replace: dict[str, Column] | None = None) -> Relation:
        """Every column but ``leave`` (names that aren't there are no matter), some replaced in their place."""
        replace = replace or {}
        unknown = set(replace) - set(self.columns)
        if unknown:
            raise DialectError("UNKNOWN_ALIAS", f"no column {sorted(unknown)[0]} to replace")
        return self.project(*(replace[c].alias(c) if c in replace else F.col(c) for c in self.columns if c not in leave))

    def order_by(self, *keys: tuple[str | Column, str]) -> DataFrame:
        """Keys with ``asc`` or ``desc`` (NULLs last and first, as Postgres has it) or ``... nulls first|last``; ties in row order."""
        refuse_vectors(self.df, [k for k, _ in keys if isinstance(k, str)], "sorted by")
        return self.df.orderBy(*(direction(F.col(k) if isinstance(k, str) else k, how) for k, how in keys), ORD)

    def limit(self, keys: list[tuple[str | Column, str]], n: int, offset: int = 0) -> DataFrame:
        if n <= 0:
            raise DialectError("UNSUPPORTED_SQL", "LIMIT takes a positive number")
        df = self.order_by(*keys)
        return (df.offset(offset) if offset else df).limit(n).drop(ORD)

    def placed(self, *keys: tuple[str | Column, str], name: str = "place") -> DataFrame:
        """Every row with its 1-based place by the keys, ties in row order.

        The rows are dealt out by ranges of the keys and written once, so that the ranges cannot change between
        counting and numbering; each is numbered by itself, after the counts of the ranges before it. No task sees all
        rows, and one count a range reaches the driver.
        """
        refuse_vectors(self.df, [k for k, _ in keys if isinstance(k, str)], "sorted by")
        order = [*(direction(F.col(k) if isinstance(k, str) else k, how) for k, how in keys), F.col(ORD)]
        spark, path = self.df.sparkSession, f"{base_dir(self.df.sparkSession)}/ranges"
        ranges = self.df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
        ranges.write.parquet(path)
        rows = spark.read.schema(ranges.schema).parquet(path)
        sizes = {r["__range"]: r["count"] for r in rows.groupBy("__range").count().collect()}
        starts, total = [], 0
        for k in sorted(sizes):
            starts.append((k, total))
            total += sizes[k]
        before = F.broadcast(spark.createDataFrame(starts, "__range int, __before long"))
        own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
        return rows.withColumn("__own", own).join(before, "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__range", "__before", "__own", ORD)

    def union_all(self, *others: Relation) -> Relation:
        """Branches after each other; columns by name."""
        parts = [r.df.withColumn(ORD, F.struct(F.lit(k).alias("branch"), F.to_json(ORD).alias("row"))) for k, r in enumerate((self, *others))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return Relation(out)

    def call(self, f: Callable[..., DataFrame], *args, **kwargs) -> Relation:
        return Relation(f(self.df, *args, **kwargs))

    def frame(self) -> DataFrame:
        return self.df.drop(ORD)


def direction(column: Column, how: str) -> Column:
    return {
        "asc": column.asc_nulls_last,
        "desc": column.desc_nulls_first,
        "asc nulls first": column.asc_nulls_first,
        "asc nulls last": column.asc_nulls_last,
        "desc nulls first": column.desc_nulls_first,
        "desc nulls last": column.desc_nulls_last,
    }[how]()


def splat(df: DataFrame, array: str, width: int, prefix: str | None = None) -> DataFrame:
    """One column an element, NULL beyond the end."""
    return df.select("*", *(F.try_element_at(array, F.lit(k)).alias(f"{prefix or array}_{k}") for k in range(1, width + 1))).drop(array)


def trim(df: DataFrame, ts: str, low: Column | None, high: Column | None) -> DataFrame:
    """A closed window of event time; the bounds reach the scan."""
    if low is not None:
        df = df.where(F.col(ts) >= low)
    return df.where(F.col(ts) <= high) if high is not None else df


def stitch(branches: list[DataFrame], t: str = "t", length: str = "length") -> DataFrame:
    """Branches on one clock: each rebased to zero and moved past the ones before it."""
    sizes = [b.agg((F.max(F.col(t) + F.col(length)) - F.min(t)).alias("span"), F.min(t).alias("first")).withColumn("branch", F.lit(k)) for k, b in enumerate(branches)]
    table = sizes[0]
    for s in sizes[1:]:
        table = table.unionByName(s)
    rows = None
    for k, b in enumerate(branches):
        b = b.withColumn("branch", F.lit(k))
        rows = b if rows is None else rows.unionByName(b)
    # one row a branch on the other side
    before = table.alias("x").join(table.alias("y"), F.col("y.branch") < F.col("x.branch"), "left").groupBy(F.col("x.branch").alias("branch"), F.col("x.first").alias("first")).agg(F.coalesce(F.sum("y.span"), F.lit(0.0)).alias("moved"))
    return rows.join(before, "branch").withColumn(t, F.col(t) - F.col("first") + F.col("moved")).drop("first", "moved")
