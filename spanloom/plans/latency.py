"""Plan-time latency analysis of a graph of stream operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from spanloom.errors import DialectError

#: Bytes waiting at an input from which a warning is given.
HELD_BYTES = 512 << 20


@dataclass
class Input:
    source: str
    pairing: str = "lockstep"  # lockstep, interval, hold, arrival
    ahead: float = 0.0
    bound: float | None = None  # an interval input's: later rows go to the next tick
    bytes_per_second: float = 0.0


@dataclass
class Stage:
    name: str
    inputs: list[Input] = field(default_factory=list)
    window: float = 0.0
    latency: float = 0.0  # its output after its tick
    live: bool = False


def delays(stages: list[Stage]) -> dict[str, float]:
    """Seconds that each stage's output lags its source: the slowest input it waits for, its window and its own latency."""
    out: dict[str, float] = {}
    by = {s.name: s for s in stages}

    def of(name: str, path: tuple[str, ...]) -> float:
        if name in path:
            raise DialectError("UNSUPPORTED_SQL", f"{name} waits for itself")
        if name not in out:
            s = by[name]
            ready = [0.0]
            for i in s.inputs:
                lag = of(i.source, (*path, name))
                if i.pairing == "lockstep":
                    ready.append(lag)
                elif i.pairing == "interval":
                    ready.append(lag + i.ahead if i.bound is None else min(lag + i.ahead, i.bound))
            out[name] = max(ready) + s.window + s.latency
        return out[name]

    for s in stages:
        of(s.name, ())
    return out


def check(stages: list[Stage]) -> list[str]:
    """Refuse live interval inputs that come later than their bound; warn of inputs that hold much back."""
    lag = delays(stages)
    warnings = []
    for s in stages:
        if not s.inputs:
            continue
        wait = lag[s.name] - s.latency
        for i in s.inputs:
            if s.live and i.pairing == "interval" and i.bound is not None and lag[i.source] + i.ahead > i.bound:
                raise DialectError("LIVE_LEAD", f"{i.source} reaches {s.name} {lag[i.source] + i.ahead:g} s late, its bound is {i.bound:g} s")
            held = max(0.0, wait - lag[i.source]) * i.bytes_per_second
            if held > HELD_BYTES:
                warnings.append(f"HELD_STREAM: {i.source} waits with {held / 2**20:.0f} MiB at {s.name}")
    return warnings
