"""Sinks: the psql-like table, CSV, JSON, NDJSON, one checked row to a path, one file a group."""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.errors import DialectError
from spanloom.sources.tables import nearest
from spanloom.types import is_vector

#: Vector values that a printed table shows.
SHOWN = 4
#: Rows a driver-side rendering may hold.
PRINTED = 10_000
OPTIONS = {"compression": str, "header": bool, "sep": str, "maxRecordsPerFile": int, "quote": str}


def spell(value, kind: T.DataType, whole: bool) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if is_vector(kind):
        rest = "" if whole or len(value) <= SHOWN else f", ... ({len(value)})"
        return "[" + ", ".join(map(str, value if whole else value[:SHOWN])) + rest + "]"
    if isinstance(kind, T.ArrayType):
        return "{" + ",".join(spell(v, kind.elementType, whole) for v in value) + "}"
    if isinstance(kind, T.StructType):
        return "(" + ",".join(spell(v, f.dataType, whole) for v, f in zip(value, kind.fields, strict=True)) + ")"
    return str(value)


def printed(df: DataFrame) -> list[Row]:
    rows = df.limit(PRINTED + 1).collect()
    if len(rows) > PRINTED:
        raise DialectError("ROW_COUNT_MISMATCH", f"more than {PRINTED} rows to print", hint="write them to a path")
    return rows


def render_table(df: DataFrame) -> str:
    kinds = [f.dataType for f in df.schema]
    body = [[spell(v, k, False) for v, k in zip(r, kinds, strict=True)] for r in printed(df)]
    width = [max(map(len, column)) for column in zip(df.columns, *body, strict=True)]
    show = lambda cells: (" " + " | ".join(c.ljust(w) for c, w in zip(cells, width, strict=True))).rstrip()
    foot = f"({len(body)} row{'s' * (len(body) != 1)})"
    return "\n".join([show(df.columns), "+".join("-" * (w + 2) for w in width), *map(show, body), foot])


def render_csv(df: DataFrame, header: bool = True) -> str:
    out = io.StringIO()
    put = csv.writer(out, lineterminator="\n")
    if header:
        put.writerow(df.columns)
    kinds = [f.dataType for f in df.schema]
    put.writerows([spell(v, k, True) for v, k in zip(r, kinds, strict=True)] for r in printed(df))
    return out.getvalue()


def render_json(df: DataFrame) -> str:
    def plain(v, kind):
        if v is None or isinstance(v, bool | int | float) or is_vector(kind):
            return v
        return spell(v, kind, True)

    rows = [{f.name: plain(v, f.dataType) for v, f in zip(r, df.schema, strict=True)} for r in printed(df)]
    return json.dumps(rows, indent=2, ensure_ascii=False) + "\n"


def checked(options: dict) -> dict:
    for key, value in options.items():
        if key not in OPTIONS:
            raise DialectError("UNKNOWN_SINK_OPTION", f"no sink option {key}", hint=nearest(key, OPTIONS))
        if not isinstance(value, OPTIONS[key]):
            raise DialectError("SINK_OPTION_TYPE", f"{key} takes {OPTIONS[key].__name__}")
    return options


def write(df: DataFrame, path: str, form: str | None = None, **options) -> None:
    """``.json`` and ``.ndjson`` paths imply JSON lines; otherwise ``form`` or parquet."""
    form = form or ("json" if re.search(r"\.(nd)?json$", path) else "csv" if path.endswith(".csv") else "parquet")
    df.write.format(form).options(**checked(options)).mode("errorifexists").save(path)


def write_tagged(df: DataFrame, path: str, reserved: tuple[str, ...] = (), **options) -> None:
    """Rows whose metadata are a ``tags`` map and a ``disposition`` struct; fields that are only read can't be written."""
    for name in df.columns:
        if name in reserved:
            raise DialectError("SINK_OPTION_TYPE", f"{name} is only read", hint="tags and disposition are written")
    if "tags" in df.columns and not isinstance(df.schema["tags"].dataType, T.MapType):
        raise DialectError("SINK_OPTION_TYPE", "tags are a map")
    if "disposition" in df.columns and not isinstance(df.schema["disposition"].dataType, T.StructType):
        raise DialectError("SINK_OPTION_TYPE", "a disposition is a record")
    write(df, path, "parquet", **options)


def write_one(df: DataFrame, path: str, **options) -> None:
    """A path of its own takes exactly one row."""
    if (n := len(df.limit(2).collect())) != 1:
        raise DialectError("ROW_COUNT_MISMATCH", f"{'no row' if n == 0 else 'several rows'} for one path")
    write(df, path, **options)


def fan_out(df: DataFrame, key: str, path: str, form: str = "parquet", one_row_each: bool = False, **options) -> None:
    """One directory a key under ``path``; keys are non-null text without path separators or ``..``."""
    if not isinstance(df.schema[key].dataType, T.StringType):
        raise DialectError("SINK_OPTION_TYPE", "a destination is text")
    bad = df.where(F.col(key).isNull() | F.col(key).contains("/") | F.col(key).contains("\\") | (F.col(key) == "..") | (F.col(key) == "")).limit(1)
    if not bad.isEmpty():
        raise DialectError("SINK_OPTION_TYPE", "a destination is null, empty or leaves its folder")
    if df.isEmpty():
        raise DialectError("ROW_COUNT_MISMATCH", "no row names a destination")
    if one_row_each and not df.groupBy(key).count().where("count > 1").limit(1).isEmpty():
        raise DialectError("ROW_COUNT_MISMATCH", "two rows name one destination")
    # the key stays in the files too, under its own name
    df.withColumn("dest", F.col(key)).write.format(form).options(**checked(options)).partitionBy("dest").save(path)
