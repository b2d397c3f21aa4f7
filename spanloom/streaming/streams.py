"""Structured Streaming forms: windows, session merges, hold, interval with late rows, lateness filter, fan-out.

Each runs over everything that is there (``availableNow``) and returns what the sink got as a DataFrame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.errors import DialectError


def base_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors share; only a local master may do without a setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise DialectError("INTERNAL", "spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or '/tmp/spanloom-checkpoints').rstrip('/')}/stream-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the store itself, so that any path Spark can read will do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def events(spark: SparkSession, sf_dir: str, name: str = "events", files: int | None = None) -> DataFrame:
    """A table as a stream: every part file of a folder, or the one file of that very name; at most ``files`` a micro-batch."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    # a stream's path is a folder; a single file is picked by name from the folder it lies in
    rows = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    # event time needs a time zone; the session's is UTC
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def finish(q, timeout: float | None = None) -> None:
    """Wait for a query's end; one that is still running after ``timeout`` seconds is stopped and refused."""
    done = q.awaitTermination(timeout) if timeout else q.awaitTermination() or True
    if not done:
        q.stop()
        raise DialectError("INTERNAL", f"the stream did not end within {timeout:g} s")
    if q.exception():
        raise q.exception()


def drain(stream: DataFrame, mode: str = "append", timeout: float | None = None) -> DataFrame:
    """Run to the end of the input and read back what was written.

    Append mode goes through a parquet sink; update and complete mode through batches of which the last row of a
    key counts (``__batch`` tells them apart).
    """
    spark = stream.sparkSession
    base = base_dir(spark)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    else:

        def put(df: DataFrame, batch: int) -> None:
            df.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/{batch}")

        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    finish(q, timeout)
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema, T.StructField("__batch", T.IntegerType())])
    reader = spark.read.schema(schema)
    return reader.parquet(f"{base}/out") if mode == "append" else reader.option("recursiveFileLookup", True).parquet(f"{base}/out")


def last_batch(df: DataFrame) -> DataFrame:
    """Complete mode: the table after the last batch that had rows."""
    top = df.agg(F.max("__batch").alias("m"))
    return df.join(F.broadcast(top), F.col("__batch") == F.col("m")).drop("__batch", "m")


def windowed(stream: DataFrame, ts: str, width: str, slide: str | None, keys: list[str], *aggregates, delay: str = "0 seconds") -> DataFrame:
    """Windowed aggregates in complete mode: every window, closed or not."""
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), *keys).agg(*aggregates)
    return out.select(*keys, F.col("window.start").alias("win_start"), F.col("window.end").alias("win_end"), *[c for c in out.columns if c != "window" and c not in keys])


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], *aggregates, delay: str = "0 seconds") -> DataFrame:
    out = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(*aggregates)
    return out.select(*keys, F.col("session_window.start").alias("start_t"), F.col("session_window.end").alias("end_t"), *[c for c in out.columns if c != "session_window" and c not in keys])


class KeyedFold:
    """``applyInPandasWithState`` over the rows of a key in time order, with a small state of named values.

    ``step(state, row) -> list of output rows`` changes the state in place; rows of one micro-batch are sorted, rows
    of later batches come after them. State has one row a key, whatever the key's rows.
    """

    def __init__(self, step: Callable[[dict, object], list[tuple]], initial: dict, output: str, state: str, order: list[str]):
        self.step, self.initial, self.output, self.state, self.order = step, initial, output, state, order

    def __call__(self, stream: DataFrame, keys: list[str]) -> DataFrame:
        step, initial, names, order = self.step, self.initial, list(self.initial), self.order

        def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
            now = dict(zip(names, state.get, strict=True)) if state.exists else dict(initial)
            rows = pd.concat(list(batches)).sort_values(order, kind="stable")
            out = [r for row in rows.itertuples(index=False) for r in step(now, row)]
            state.update(tuple(now[n] for n in names))
            yield pd.DataFrame(out, columns=columns)

        columns = T._parse_datatype_string(self.output).names
        return stream.groupBy(*keys).applyInPandasWithState(run, self.output, self.state, "append", "NoTimeout")


def fan_out(stream: DataFrame, writers: list[Callable[[DataFrame, int], None]]) -> None:
    """One pass over the stream feeding several sinks, the batch cached for them."""

    def put(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for w in writers:
                w(df, batch)
        finally:
            df.unpersist()

    base = base_dir(stream.sparkSession)
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
