"""User functions: declared parameters and defaults, value and row functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.errors import DialectError

REQUIRED = object()


@dataclass
class Function:
    """A column or table function whose arguments bind by place, then by name; NULL takes a default's place."""

    name: str
    parameters: dict[str, object]  # name -> default or REQUIRED, in order
    body: Callable

    def bind(self, args: tuple, kwargs: dict) -> dict:
        names = list(self.parameters)
        if len(args) > len(names):
            raise DialectError("UDF_ARG_TYPE", f"{self.name} takes {len(names)} arguments")
        given = dict(zip(names, args, strict=False))
        for k, v in kwargs.items():
            if k not in self.parameters:
                raise DialectError("UDF_ARG_TYPE", f"{self.name} has no parameter {k}")
            if k in given:
                raise DialectError("UDF_ARG_TYPE", f"{self.name} is given {k} twice")
            given[k] = v
        out = {}
        for k, default in self.parameters.items():
            v = given.get(k)
            if v is None:
                if default is REQUIRED:
                    raise DialectError("UDF_ARG_TYPE", f"{self.name} needs {k}")
                v = default
            out[k] = v
        return out

    def __call__(self, *args, **kwargs):
        return self.body(**self.bind(args, kwargs))


class Registry(dict):
    def declare(self, name: str, body: Callable, **parameters) -> Function:
        if name in self:
            raise DialectError("UNSUPPORTED_SQL", f"{name} is declared twice")
        self[name] = f = Function(name, parameters, body)
        return f

    def __missing__(self, name: str):
        from spanloom.sources.tables import nearest

        raise DialectError("UNKNOWN_FUNCTION", f"no function {name}", hint=nearest(name, self))


def letter_counts(text: Column) -> Column:
    """An 8-value unit vector of a text's letter counts by alphabet place modulo 8; JVM side only."""
    low = F.lower(text)
    sets = ["".join(chr(97 + k) for k in range(26) if k % 8 == b) for b in range(8)]
    counts = F.array(*((F.length(text) - F.length(F.regexp_replace(low, f"[{s}]", ""))).cast("double") for s in sets))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def rows_function(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """Rows to rows, batch by batch; the declared schema must be met by name."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches):
        for b in batches:
            out = f(b)
            missing = [n for n in kind.names if n not in out.columns]
            if missing:
                raise DialectError("UDF_ARG_TYPE", f"the rows lack {missing[0]}")
            yield out[kind.names]

    return df.mapInPandas(run, kind)


def readable(producer: T.StructType, reader: T.StructType) -> bool:
    """Whether a reader's fields are all there with a type that fits (an integer is a number; extras pass)."""
    have = {f.name: f.dataType for f in producer}

    def fits(a: T.DataType, b: T.DataType) -> bool:
        return a == b or isinstance(b, T.FractionalType) and isinstance(a, T.NumericType) or isinstance(b, T.IntegralType) and isinstance(a, T.IntegralType)

    return all(f.name in have and fits(have[f.name], f.dataType) for f in reader)
