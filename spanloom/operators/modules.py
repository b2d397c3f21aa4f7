"""Forms that a stream's user meets as ready-made parts: tallies, stamps, echoes, ports, heartbeats, sinks of effects."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.errors import DialectError
from spanloom.operators.windows import numbered, spine


def rows_and_total(df: DataFrame, keys: list[str], columns: list[str], total: dict[str, Column]) -> DataFrame:
    """Each row, then one more a key: ``is_total`` rows have the aggregates where named and NULL elsewhere."""
    own = df.select(*keys, *columns, F.lit(False).alias("is_total"))
    sums = df.groupBy(*keys).agg(*(c.alias(n) for n, c in total.items())).withColumn("is_total", F.lit(True))
    return own.unionByName(sums, allowMissingColumns=True)


def group_summary(df: DataFrame, key_flag: Column, keys: list[str], at: str, order: list[str], size: Column) -> DataFrame:
    """Per group that a key row opens: rows, bytes, and whether time never runs back in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("grp", F.sum(F.when(key_flag, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__back", F.coalesce(F.col(at) < F.lag(at).over(w), F.lit(False)))
    return rows.groupBy(*keys, "grp").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), (~F.bool_or("__back")).alias("ordered"))


def tally(inputs: dict[str, DataFrame], size: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Rows (and bytes) of each input, as they arrive: inputs aren't paired. An empty input counts 0."""
    out = None
    for name, df in inputs.items():
        one = df.agg(F.lit(name).alias("input"), F.count("*").alias("n"), *([F.coalesce(F.sum(size(df)), F.lit(0)).alias("bytes")] if size else []))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise DialectError("INPUT_NOT_FOUND", "no input to count")
    return out


def head(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The facts of each key's first row."""
    first = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.min_by(c, first).alias(c) for c in columns))


def running_state(ticks: DataFrame, messages: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """Each tick with how many messages have come by then and the latest one's time: state as a running value."""
    rows = ticks.withColumn("__side", F.lit(1)).unionByName(messages.select(*keys, at, F.lit(0).alias("__side")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side", *order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("__side") == 0, F.col(at))
    return rows.withColumn("seen", F.count(own).over(w)).withColumn("latest", F.max(own).over(w)).where("__side = 1").drop("__side")


def recut(packets: DataFrame, keys: list[str], samples: str, at: str, width: int) -> DataFrame:
    """Samples of packets cut anew into windows of ``width``, whatever the packets' bounds, each stamped with its first sample's time.

    ``samples`` is an array of (``at``, value) structs; the last window of a key may be short.
    """
    rows = packets.select(*keys, F.explode(samples).alias("s")).select(*keys, "s.*")
    value = next(f.name for f in rows.schema if f.name not in (*keys, at))
    rows = numbered(rows, keys, [at, value]).withColumn("win", F.floor(F.col("rn") / width))
    return rows.groupBy(*keys, "win").agg(F.min(at).alias(at), F.count("*").alias("n"), F.sum(value).alias("total"))


def in_view(rows: DataFrame, ticks: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """A row for each tick within [start, end) of a span, keyed by the span's start: an equi-join on time buckets."""
    from spanloom.operators.joins import band_join

    out = band_join(ticks, rows, keys, at, start, end, 3600.0)
    return out.where(F.col(at) < F.col(end))


def stamped(messages: DataFrame, body: str, fields: dict[str, Column]) -> DataFrame:
    """JSON messages with further fields; a message that is no object is left as it is."""
    own = F.from_json(body, "map<string,string>")
    extra = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), c.cast("string")) for n, c in fields.items()))
    text = F.rtrim(F.col(body))
    whole = F.when(F.size(own) > 0, F.concat(F.expr(f"left(rtrim(`{body}`), length(rtrim(`{body}`)) - 1)"), F.lit(","), extra, F.lit("}")))
    whole = whole.when(text.rlike(r"^\s*\{\s*\}$"), F.concat(F.lit("{"), extra, F.lit("}")))
    return messages.withColumn(body, F.coalesce(whole, F.col(body)))


def with_beats(df: DataFrame, keys: list[str], at: str, every: float) -> DataFrame:
    """The rows, and a beat every so many seconds of programme time, so that an idle source moves on; ``beat`` tells them apart."""
    beats = spine(df, keys, at, every).withColumn("beat", F.lit(True))
    return df.withColumn("beat", F.lit(False)).unionByName(beats, allowMissingColumns=True)


def without_beats(df: DataFrame) -> DataFrame:
    """What a module is given: beats are dropped before it."""
    return df.where(~F.col("beat")).drop("beat")


def ports(first: DataFrame, second: DataFrame | None = None, many: list[DataFrame] | None = None) -> DataFrame:
    """A call with an optional port and one that takes any number of streams: rows with ``port`` and the stream's number ``n``."""
    out = first.select("*", F.lit("first").alias("port"), F.lit(1).alias("n"))
    if second is not None:
        out = out.unionByName(second.select("*", F.lit("second").alias("port"), F.lit(1).alias("n")))
    for k, df in enumerate(many or [], 1):
        out = out.unionByName(df.select("*", F.lit("many").alias("port"), F.lit(k).alias("n")))
    return out


def window_function(rows: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str], schema: str) -> DataFrame:
    """A function called with the rows of one window of one key at a time; windows are bounded by their width."""
    return rows.groupBy(*keys).applyInPandas(f, schema)


def listed(df: DataFrame, column: str, name: str) -> DataFrame:
    """The items of a comma list as rows, with their 1-based place; empty items are skipped."""
    items = F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")
    return df.select("*", F.posexplode(items).alias("__at", name)).withColumn("index", F.col("__at") + 1).drop("__at", column)


def quiet(df: DataFrame) -> DataFrame:
    """A producer that reads everything and writes nothing."""
    return df.where(F.lit(False))


def effects(stream: DataFrame, effect: Callable[[DataFrame, int], None], timeout: float | None = None) -> None:
    """A sink whose effects are the output: called with every micro-batch, to the end of what is there."""
    from spanloom.streaming.streams import base_dir, finish

    q = stream.writeStream.foreachBatch(effect).option("checkpointLocation", f"{base_dir(stream.sparkSession)}/state").trigger(availableNow=True).start()
    finish(q, timeout)
