"""Scripts of views and writes, and variables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from spanloom.errors import DialectError

_PART = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|::|:'(\w+)'|:\"(\w+)\"|:(\w+)(?:\[(\d+)\])?", re.S)


def substitute(text: str, values: dict[str, str]) -> str:
    """``:'v'`` a quoted text, ``:"v"`` a quoted name, ``:v`` as it is, ``:v[k]`` the k-th of a comma list; unset is NULL.

    Strings, names and comments are left alone; a value that no variable asks for is refused.
    """
    used = set()

    def one(m: re.Match) -> str:
        name = m[1] or m[2] or m[3]
        if not name:
            return m[0]
        used.add(name)
        value = values.get(name)
        if value is None:
            return "NULL"
        if m[1]:
            return "'" + value.replace("'", "''") + "'"
        if m[2]:
            return '"' + value.replace('"', '""') + '"'
        if m[4]:
            parts = [p.strip() for p in value.split(",")]
            k = int(m[4])
            if not 1 <= k <= len(parts):
                raise DialectError("UDF_ARG_TYPE", f"{name} has {len(parts)} values, not {k}")
            return parts[k - 1]
        return value

    out = _PART.sub(one, text)
    if unknown := sorted(set(values) - used):
        raise DialectError("UNKNOWN_ALIAS", f"no variable {unknown[0]} in the script")
    return out


def header(text: str) -> dict[str, str | None]:
    """Variables that the leading comments declare (``-- variables: a, b = 3``), with their defaults."""
    out: dict[str, str | None] = {}
    for line in text.splitlines():
        if line.strip() and not line.lstrip().startswith("--"):
            break
        if m := re.match(r"\s*--\s*variables:\s*(.*)", line):
            for part in filter(None, (p.strip() for p in m[1].split(","))):
                name, _, default = (x.strip() for x in part.partition("="))
                out[name] = default or None
    return out


@dataclass
class Script:
    """Named views, then writes that share them; a view that nothing reads is refused."""

    views: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)
    writes: list[tuple[tuple[str, ...], Callable[..., None]]] = field(default_factory=list)

    def view(self, name: str, build: Callable[[dict[str, DataFrame]], DataFrame]) -> None:
        if name in self.views:
            raise DialectError("UNSUPPORTED_SQL", f"{name} is defined twice")
        self.views[name] = build

    def copy(self, reads: tuple[str, ...], write: Callable[..., None]) -> None:
        self.writes.append((reads, write))

    def run(self) -> None:
        read: set[str] = {n for names, _ in self.writes for n in names}

        class Seen(dict):
            def __getitem__(self, name):
                read.add(name)
                if name not in self:
                    raise DialectError("UNKNOWN_ALIAS", f"no view {name}")
                return super().__getitem__(name)

        frames = Seen()
        for name, build in self.views.items():
            frames[name] = build(frames)
        if unused := [n for n in self.views if n not in read]:
            raise DialectError("UNSUPPORTED_SQL", f"nothing reads the view {unused[0]}")
        shared = [n for n in self.views if sum(n in names for names, _ in self.writes) > 1]
        for n in shared:
            frames[n].persist()
        try:
            for names, write in self.writes:
                write(*(frames[n] for n in names))
        finally:
            for n in shared:
                frames[n].unpersist()
