"""Run-time row predicates over JSON rows.

A predicate is true, false or undecided (NULL). A field that is absent, null or of another type than the literal
leaves its comparison undecided, and AND / OR look at their operands from the left and stop at the first that
decides or is undecided, unlike SQL. A row is kept where the whole is true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.errors import DialectError


class Rows:
    """Predicates over the JSON objects of a text column."""

    def __init__(self, text: Column | str, kinds: dict[str, str] | None = None):
        """``kinds``: declared types (number, string, boolean) of fields, which literals must have."""
        self.value = F.try_parse_json(text)
        self.kinds = kinds or {}

    def field(self, name: str, kind: str) -> Column:
        """The object's own field of that name as a type, NULL where it isn't there or doesn't fit."""
        quote = "'" if "'" not in name else '"'
        if quote in name:
            raise DialectError("UNSUPPORTED_SQL", f"a field name with both quotes: {name}")
        return F.try_variant_get(self.value, f"$[{quote}{name}{quote}]", kind)

    def kind(self, field: str) -> Column:
        """number, string, boolean, null or other; NULL if absent."""
        t = F.schema_of_variant(self.field(field, "variant"))
        return F.when(t == "STRING", F.lit("string")).when(t == "BOOLEAN", F.lit("boolean")).when(t == "VOID", F.lit("null")).when(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), F.lit("number")).when(t.isNotNull(), F.lit("other"))

    def declared(self, field: str, kind: str) -> None:
        if self.kinds.get(field, kind) != kind:
            raise DialectError("UDF_ARG_TYPE", f"{field} is a {self.kinds[field]}, the literal a {kind}")

    def compare(self, field: str, op: str, literal) -> Column:
        if op not in ("eq", "ne", "lt", "le", "gt", "ge"):
            raise DialectError("UNSUPPORTED_SQL", f"no comparison {op}")
        kind = "boolean" if isinstance(literal, bool) else "number" if isinstance(literal, int | float) else "string"
        self.declared(field, kind)
        left = self.field(field, "boolean").cast("int") if kind == "boolean" else self.field(field, "double" if kind == "number" else "string")
        right = F.lit(int(literal)) if kind == "boolean" else F.lit(float(literal)) if kind == "number" else F.lit(literal)
        test = {"eq": left == right, "ne": left != right, "lt": left < right, "le": left <= right, "gt": left > right, "ge": left >= right}[op]
        return F.when(self.kind(field) == kind, test)

    def like(self, field: str, pattern: str, fold: bool = False) -> Column:
        """Whole text, ``%`` and ``_``, no escape character."""
        rx = "(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else "\\Q" + c + "\\E" for c in (pattern.lower() if fold else pattern)) + "$"
        self.declared(field, "string")
        value = self.field(field, "string")
        return F.when(self.kind(field) == "string", (F.lower(value) if fold else value).rlike(rx))

    def among(self, field: str, literals: list) -> Column:
        if not literals:
            raise DialectError("UNSUPPORTED_SQL", "an empty list")
        return any_of(*(self.compare(field, "eq", x) for x in literals))

    def not_among(self, field: str, literals: list) -> Column:
        if not literals:
            raise DialectError("UNSUPPORTED_SQL", "an empty list")
        return all_of(*(self.compare(field, "ne", x) for x in literals))


def all_of(*tests: Column) -> Column:
    """True without operands."""
    return reduce(lambda rest, t: F.when(t.isNull(), None).when(~t, F.lit(False)).otherwise(rest), reversed(tests), F.lit(True))


def any_of(*tests: Column) -> Column:
    """False without operands."""
    return reduce(lambda rest, t: F.when(t.isNull(), None).when(t, F.lit(True)).otherwise(rest), reversed(tests), F.lit(False))


def negate(test: Column) -> Column:
    return ~test
