"""Sources: table scans, written rows, series, containers, captions, manifests, unions of named inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.errors import DialectError

#: Reader options a scan may carry, with their types.
OPTIONS = {"header": bool, "sep": str, "mergeSchema": bool, "multiLine": bool, "pathGlobFilter": str, "recursiveFileLookup": bool, "wholetext": bool}


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A scan with whitelisted, typed options and an optional declared shape."""
    reader = spark.read.format(form)
    for key, value in options.items():
        if key not in OPTIONS:
            raise DialectError("UNKNOWN_INPUT_OPTION", f"no input option {key}", hint=nearest(key, OPTIONS))
        if not isinstance(value, OPTIONS[key]):
            raise DialectError("INPUT_OPTION_TYPE", f"{key} takes {OPTIONS[key].__name__}")
        reader = reader.option(key, value)
    return (reader.schema(schema) if schema is not None else reader).load(path)


_SCANS: dict[tuple, DataFrame] = {}


def shared_read(spark: SparkSession, path: str, form: str = "parquet", **options) -> DataFrame:
    """As :func:`read`, one scan for equal paths and options of a session, so that Spark can reuse its exchanges."""
    key = (spark.sparkContext.applicationId, path, form, tuple(sorted(options.items())))
    if key not in _SCANS:
        if len(_SCANS) >= 256:
            _SCANS.clear()
        _SCANS[key] = read(spark, path, form, **options)
    return _SCANS[key]


def nearest(name: str, known) -> str | None:
    import difflib

    close = difflib.get_close_matches(name, list(known), 1)
    return f"did you mean {close[0]}?" if close else None


def struct_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Written rows with a derived 1-based ``index``; all rows have the same fields."""
    if not rows:
        raise DialectError("UNSUPPORTED_SQL", "an empty row table")
    if any(r.keys() != rows[0].keys() for r in rows):
        raise DialectError("UNSUPPORTED_SQL", "the rows' fields differ")
    names = list(rows[0])
    return spark.createDataFrame([(k, *(r[n] for n in names)) for k, r in enumerate(rows, 1)], f"index int, {schema}")


def series(spark: SparkSession, first: int, last: int, step: int = 1, name: str = "i") -> DataFrame:
    """Inclusive; a zero step and an empty series are refused."""
    if step == 0:
        raise DialectError("UNSUPPORTED_SQL", "a series cannot step by 0")
    end = last + (1 if step > 0 else -1)
    if (end - first) * step <= 0:
        raise DialectError("UNSUPPORTED_SQL", "the series is empty")
    return spark.range(first, end, step).withColumnRenamed("id", name)


def containers(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row an order with its items nested, in a fixed order, and a map of tags."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    nested = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    tags = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return orders.join(nested, "o_orderkey").withColumn("tags", tags)


def unnest(df: DataFrame, array: str, alias: str) -> DataFrame:
    """Elements as rows with their 1-based place; the other columns repeat."""
    others = [c for c in df.columns if c != array]
    return df.select(*others, F.posexplode(array).alias("__pos", alias)).withColumn("index", F.col("__pos") + 1).drop("__pos")


def titled(rows: DataFrame, title: str, track: str = "track") -> DataFrame:
    """The rows of one titled track; a title that isn't there is refused, naming those that are."""
    out = rows.where(F.col(track) == title)
    if out.isEmpty():
        have = [r[0] for r in rows.select(track).distinct().orderBy(track).limit(20).collect()]
        raise DialectError("STREAM_NOT_FOUND", f"no track {title!r}", hint="there are " + ", ".join(map(str, have)))
    return out


_TIME = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})[.,](\d{1,3})"


def captions(documents: DataFrame, text: str = "text", track: str = "track") -> DataFrame:
    """Cues of WebVTT documents: track, index, text, start_t, end_t. A document without cues gives no rows."""
    blocks = documents.select(F.col(track), F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n+")).alias("at", "block"))
    line = rf"(?m)^[ \t]*{_TIME}[ \t]+-->[ \t]+{_TIME}.*$"
    seconds = lambda g: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(block, r'{line}', {g}), '') AS double)"), F.lit(0.0)) * 3600 + F.regexp_extract("block", line, g + 1).cast("double") * 60 + F.regexp_extract("block", line, g + 2).cast("double") + F.rpad(F.regexp_extract("block", line, g + 3), 3, "0").cast("double") / 1000
    cues = blocks.where(F.col("block").rlike(line)).select(track, "at", F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("text"), seconds(1).alias("start_t"), seconds(5).alias("end_t"))
    order = Window.partitionBy(track).orderBy("at")
    return cues.select(track, F.row_number().over(order).alias("index"), "text", "start_t", "end_t")


def renditions(manifest: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """One row a variant of HLS master manifests: path, index, bandwidth, width, height, codecs, uri."""
    entry = r"(?m)^#EXT-X-STREAM-INF:([^\n]*)\n([^#\n][^\n]*)"
    rows = manifest.select(path, F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(entry), 1).alias("a"), F.regexp_extract_all(text, F.lit(entry), 2).alias("u"))).alias("at", "e"))
    get = lambda pattern: F.nullif(F.regexp_extract("e.a", pattern, 1), F.lit(""))
    return rows.select(path, (F.col("at") + 1).alias("index"), get(r"(?:^|,)BANDWIDTH=(\d+)").cast("long").alias("bandwidth"), get(r"RESOLUTION=(\d+)x").cast("int").alias("width"), get(r"RESOLUTION=\d+x(\d+)").cast("int").alias("height"), get(r'CODECS="([^"]*)"').alias("codecs"), F.trim("e.u").alias("uri"))


def named_inputs(spark: SparkSession, rows: list[dict], key: str = "path", form: str = "parquet") -> DataFrame:
    """Inputs named by rows; the other fields of a row become typed columns of its input's rows."""
    out = None
    for row in rows:
        df = spark.read.format(form).load(row[key])
        for name, value in row.items():
            if name != key:
                df = df.withColumn(name, F.lit(value))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise DialectError("INPUT_NOT_FOUND", "no input is named")
    return out


def epoch(df: DataFrame, ts: str = "ts", name: str = "t") -> DataFrame:
    """Event time as seconds."""
    return df.withColumn(name, F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0))


def bounded(df: DataFrame) -> bool:
    return not df.isStreaming


_LIST = re.compile(r"\s*,\s*")


def split_list(text: str) -> list[str]:
    return [x for x in _LIST.split(text.strip()) if x]
