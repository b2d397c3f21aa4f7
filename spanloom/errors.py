"""Typed rejections."""

from __future__ import annotations

from dataclasses import dataclass

#: The codes that callers of the dialect match on.
CODES = frozenset(
    """PARSE_ERROR SYNTAX_ERROR UNKNOWN_FUNCTION UNKNOWN_ALIAS UDF_ARG_TYPE NO_STREAMING_EQUIVALENT UNSUPPORTED_SQL
    STREAM_NOT_FOUND INPUT_NOT_FOUND BROADCAST_MISMATCH ROW_COUNT_MISMATCH UNKNOWN_SINK_OPTION SINK_OPTION_TYPE
    UNKNOWN_INPUT_OPTION INPUT_OPTION_TYPE OUTPUT_EXISTS LIVE_LEAD INTERNAL""".split()
)


@dataclass
class DialectError(Exception):
    code: str
    message: str
    line: int | None = None
    col: int | None = None
    hint: str | None = None

    def __post_init__(self) -> None:
        if self.code not in CODES:
            raise ValueError(f"no such code: {self.code}")
        super().__init__(self.message)

    def __str__(self) -> str:
        where = f" at {self.line}:{self.col}" if self.line is not None else ""
        return f"{self.code}{where}: {self.message}" + (f" ({self.hint})" if self.hint else "")
