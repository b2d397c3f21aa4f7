"""Adaptive dropping of rows that fall behind: a floor, a learned bound and a learned burst width.

A row's lateness is its arrival less its time. Three readings of a stream decide what passes, each a small object here:

- :class:`Floor`: the least lateness of the last ``FLOOR`` seconds, of rows that were waited for.
- :class:`Excess`: how far above the floor rows come as a rule; its bound is three deviations above the mean of the
  logarithm of the excess, over about ``MEMORY`` seconds, at most ``max_lateness`` and that until ``ENOUGH`` rows are in.
- :class:`Bursts`: rows that arrive in quick succession are one run. A run counts if its freshest row is near the floor;
  the spread is the widest of the last ``RUNS`` counted runs, each at most ``max_spread``. The first run, and one as wide
  as ``max_spread``, only stand until a narrower one has counted.

A row later than floor, spread and bound together is dropped, and so is one older than the last that passed. Until the
bursts have been learned, ``max_spread`` stands for the spread.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from spanloom.errors import DialectError

# Seconds of the floor and of the estimate, rows that make it one, runs that the spread looks back on,
# counted runs that end the learning.
FLOOR, MEMORY, ENOUGH, RUNS, LEARNED = 4.0, 10.0, 300, 8, 3
#: Excess under which a row counts as on the floor, in seconds.
_TINY = 1e-4


@dataclass
class Floor:
    """A sliding least value: readings that a later, lower one has made useless are gone."""

    readings: list = field(default_factory=list)  # [arrival, lateness], both rising

    def read(self, arrival: float, late: float) -> None:
        while self.readings and self.readings[-1][1] >= late:
            self.readings.pop()
        self.readings.append([arrival, late])
        while arrival - self.readings[0][0] > FLOOR:
            self.readings.pop(0)

    def at(self, late: float) -> float:
        """The floor, or without readings a row's own lateness."""
        return self.readings[0][1] if self.readings else late


@dataclass
class Excess:
    """Mean and mean square of the logarithm of the excess, each row weighing by the time it stands for."""

    rows: int = 0
    mean: float = 0.0
    square: float = 0.0

    def read(self, excess: float, seconds: float) -> None:
        x = math.log(max(_TINY, excess))
        self.rows += 1
        weight = min(1.0, max(1.0 / self.rows, seconds / MEMORY))
        self.mean = (1 - weight) * self.mean + weight * x
        self.square = (1 - weight) * self.square + weight * x * x

    def bound(self, most: float) -> float:
        if self.rows < ENOUGH:
            return most
        return min(most, math.exp(self.mean + 3 * math.sqrt(max(0.0, self.square - self.mean**2))))


@dataclass
class Bursts:
    """The run that goes on, and what counted ones have shown."""

    low: float | None = None  # of the run that goes on: least and greatest lateness, rows, whether it began while learning
    high: float = 0.0
    rows: int = 0
    early: bool = True
    ended: int = 0
    counted: int = 0
    steady: bool = False  # a run of one row after the first run
    shown: list = field(default_factory=list)  # [width, stands only for now] of counted runs

    def goes_on(self, gap: float, step: float) -> bool:
        return self.low is not None and gap < abs(step) / 2

    def extend(self, late: float) -> None:
        self.low, self.high, self.rows = min(self.low, late), max(self.high, late), self.rows + 1

    def begin(self, late: float, learning: bool) -> None:
        self.low = self.high = late
        self.rows, self.early = 1, learning

    def end(self, floor: float, max_lateness: float, max_spread: float) -> bool:
        """Close the run; whether it was a first delivery of several rows, which says nothing of the floor."""
        first, self.ended = self.ended == 0, self.ended + 1
        reach = max_lateness * (1.0 if self.early else 0.5)
        if self.low - floor <= reach:
            width = min(max_spread, self.high - self.low)
            self.shown = [*self.shown, [width, first or width >= max_spread]][-RUNS:]
            self.counted += 1
            self.steady |= self.rows == 1 and not first
        return first and self.rows > 1

    @property
    def spread(self) -> float:
        """The widest that stands: a provisional width goes once a later run was narrower."""
        widest, narrowest_after = 0.0, math.inf
        for width, provisional in reversed(self.shown):
            if not (provisional and narrowest_after < width):
                widest = max(widest, width)
            narrowest_after = min(narrowest_after, width)
        return widest

    @property
    def learned(self) -> bool:
        return self.steady or self.counted >= LEARNED


class Judge:
    """Decides row by row, in order of arrival; :meth:`save` and :meth:`load` carry it between batches."""

    def __init__(self, max_lateness: float = 0.5, max_spread: float = 2.0):
        if max_lateness <= 0 or max_spread < 0:
            raise DialectError("UDF_ARG_TYPE", "max_lateness is above zero and max_spread not below")
        self.max_lateness, self.max_spread = max_lateness, max_spread
        self.floors, self.excess, self.bursts = Floor(), Excess(), Bursts()
        self.first: float | None = None  # arrival of the first row
        self.last: list | None = None  # arrival and time of the last one
        self.passed: float | None = None  # time of the last one that passed

    def save(self) -> str:
        return json.dumps([asdict(self.floors), asdict(self.excess), asdict(self.bursts), self.first, self.last, self.passed])

    def load(self, text: str) -> Judge:
        floors, excess, bursts, self.first, self.last, self.passed = json.loads(text)
        self.floors, self.excess, self.bursts = Floor(**floors), Excess(**excess), Bursts(**bursts)
        return self

    @property
    def bound(self) -> float:
        return self.excess.bound(self.max_lateness)

    @property
    def spread(self) -> float:
        return self.bursts.spread

    def learning(self, arrival: float) -> bool:
        return not self.bursts.learned and (self.first is None or arrival - self.first <= self.max_spread + self.max_lateness)

    def row(self, arrival: float, time: float, waited: bool = True) -> bool:
        """Whether the row passes. One that was not ``waited`` for (it lay in a queue) leaves the floor where it is."""
        late, (before, time_before) = arrival - time, self.last or (arrival - MEMORY, time)
        self.first = arrival if self.first is None else self.first
        if self.bursts.goes_on(arrival - before, time - time_before):
            self.bursts.extend(late)
        else:
            if self.bursts.low is not None and self.bursts.end(self.floors.at(late), self.max_lateness, self.max_spread):
                self.floors = Floor()
            self.bursts.begin(late, self.learning(arrival))
        if waited or not self.floors.readings:
            self.floors.read(arrival, late)
        above = late - self.floors.at(late)
        self.excess.read(above, abs(arrival - before))
        self.last = [arrival, time]
        room = (self.max_spread if self.learning(arrival) else self.spread) + self.bound
        ok = above <= room and (self.passed is None or time >= self.passed)
        if ok:
            self.passed = time
        return ok


def drop_late(rows: DataFrame, keys: list[str], arrival: str, time: str, max_lateness: float = 0.5, max_spread: float = 2.0, waited: str | None = None) -> DataFrame:
    """A stream's rows (seconds in ``arrival`` and ``time``) without those its key's judge drops; one small state a key.

    ``waited`` names a boolean column that is false for rows that lay in a queue before they were read.
    """
    Judge(max_lateness, max_spread)

    def run(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        judge = Judge(max_lateness, max_spread)
        if state.exists:
            judge.load(state.get[0])
        got = pd.concat(list(batches)).sort_values(arrival, kind="stable")
        fresh = got[waited].astype(bool) if waited else [True] * len(got)
        keep = [judge.row(float(a), float(t), bool(w)) for a, t, w in zip(got[arrival], got[time], fresh, strict=True)]
        state.update((judge.save(),))
        yield got[keep]

    return rows.groupBy(*keys).applyInPandasWithState(run, rows.schema, "judge string", "append", "NoTimeout")
