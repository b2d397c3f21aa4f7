"""Pairing of a clock's ticks with another input: lockstep, hold (as-of), interval, at or before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.errors import DialectError
from spanloom.operators.windows import tick_intervals

INF = float("inf")


def lockstep(left: DataFrame, right: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Equal time only."""
    return left.join(right, [*keys, at])


def hold(ticks: DataFrame, held: DataFrame, keys: list[str], at: str, fields: list[str], linger: float | None = None, unbounded: bool = True, tie: str | None = None, lead: float = 0.0, timeout: float | None = None) -> DataFrame:
    """Each tick with the newest held row at or before it: one shuffle on the keys and a running last value.

    Rows at a tick's very time count; of held rows at one time the last by ``tie``. Unless ``unbounded``, the held
    side's last row stays for ``linger`` seconds (0: its own time alone) after its time. Held rows are shown ``lead``
    seconds ahead of their time; a feed that is silent for longer than ``timeout`` ends until its next row.
    """
    if lead:
        held = held.withColumn(at, F.col(at) - lead)
    last = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *([F.col(tie).desc()] if tie else []))
    value = F.struct(F.col(at).alias("held_t"), *fields)
    own = held.select(*keys, at, *([F.col(tie).alias("__tie")] if tie else [F.lit(0).alias("__tie")]), value.alias("__held"), F.lit(0).alias("__side"), *([(F.row_number().over(last) == 1).alias("__last")] if not unbounded else [F.lit(False).alias("__last")]))
    rows = ticks.select("*", F.lit(1).alias("__side"))
    both = rows.unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(at), "__side", F.col("__tie")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__now", F.last(F.when(F.col("__side") == 0, F.struct("__held", "__last")), ignorenulls=True).over(w)).where("__side = 1")
    ok = F.lit(True) if unbounded else ~F.col("__now.__last") | (F.col(at) <= F.col("__now.__held.held_t") + (linger or 0.0))
    if timeout is not None:
        ok = ok & (F.col(at) <= F.col("__now.__held.held_t") + timeout)
    picked = [F.when(ok, F.col(f"__now.__held.{f}")).alias(f) for f in ("held_t", *fields)]
    return out.select(*ticks.columns, *picked)


def hold_group(ticks: DataFrame, held: dict[str, DataFrame], keys: list[str], at: str, linger: float = 0.0) -> DataFrame:
    """Several inputs held as one group: each tick with the newest row of each (the field of that name), until ``linger``
    seconds after the last row of any of them."""
    ends, out = None, ticks
    for field, rows in held.items():
        one = rows.select(*keys, at)
        ends = one if ends is None else ends.unionByName(one)
        out = hold(out, rows, keys, at, [field], tie=field).drop("held_t")
    ends = ends.groupBy(*keys).agg((F.max(at) + linger).alias("__end"))
    out = out.join(ends, keys, "left")
    return out.withColumns({f: F.when(F.col(at) <= F.col("__end"), F.col(f)) for f in held}).drop("__end")


def interval(ticks: DataFrame, messages: DataFrame, keys: list[str], at: str, message_at: str, fields: list[str], order: list[str], ahead: float = 0.0) -> DataFrame:
    """Each message with the first tick whose [time, next time + ahead) holds it, once.

    Ticks are intervals without gaps, so that is the newest tick at or before the message, or with ``ahead`` the
    oldest whose end is past the message less ``ahead``: found by a running value, not by a range join. Messages
    before the first tick are unpaired and left out.
    """
    spans = tick_intervals(ticks, at, keys, order)
    # the oldest tick with until > m - ahead, that has begun by m: walk down from later times
    tick = spans.select(*keys, F.col("until").alias("__x"), F.lit(0).alias("__side"), F.struct(F.col(at).alias("tick_t"), *order).alias("__tick"))
    message = messages.select("*", (F.col(message_at) - ahead).alias("__x"), F.lit(1).alias("__side"))
    both = message.unionByName(tick, allowMissingColumns=True)
    # descending x; a tick that ends at x does not hold a message of that x, so messages go first there
    w = Window.partitionBy(*keys).orderBy(F.col("__x").desc(), F.col("__side").desc(), F.col("__tick.tick_t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__now", F.last("__tick", ignorenulls=True).over(w)).where("__side = 1")
    out = out.where(F.col("__now").isNotNull() & (F.col("__now.tick_t") <= F.col(message_at)))
    return out.select(*keys, F.col("__now.tick_t").alias("tick_t"), *(F.col(f"__now.{o}").alias(f"tick_{o}") for o in order), message_at, *fields)


def late(paired: DataFrame, seen_at: Column, bound: float, message_at: str) -> DataFrame:
    """``late``: whether a message came more than its bound after its time; such ones go to the tick at which they come."""
    return paired.withColumn("late", seen_at - F.col(message_at) > bound)


def interval_or_late(ticks: DataFrame, messages: DataFrame, keys: list[str], at: str, message_at: str, seen_at: str, bound: float, fields: list[str], order: list[str]) -> DataFrame:
    """As :func:`interval`, but a message seen more than ``bound`` seconds after its time goes to the next tick from then on,
    with ``late`` set. Late messages after the last tick are left out."""
    late_by = F.col(seen_at) - F.col(message_at) > bound
    ready = interval(ticks, messages.where(~late_by), keys, at, message_at, fields, order)
    # the next tick is the newest one on a clock that runs backwards
    back = ticks.select(*keys, (-F.col(at)).alias("__x"), F.col(at).alias("tick_t"), *(F.col(o).alias(f"tick_{o}") for o in order))
    rows = messages.where(late_by).select(*keys, message_at, *fields, (-F.col(seen_at)).alias("__x"))
    after = hold(rows, back, keys, "__x", ["tick_t", *(f"tick_{o}" for o in order)], tie=f"tick_{order[0]}" if order else None)
    after = after.where(F.col("tick_t").isNotNull()).drop("__x", "held_t")
    return ready.withColumn("late", F.lit(False)).unionByName(after.withColumn("late", F.lit(True)))


def arrival(inputs: dict[str, DataFrame]) -> DataFrame:
    """Unpaired: the rows of every input, with its name as ``input``."""
    out = None
    for name, df in inputs.items():
        one = df.withColumn("input", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def anchored(df: DataFrame, at: str, keys: list[str], how: str, tag: str | None = None, anchor: float = 0.0) -> DataFrame:
    """A source's time on the clock: as it is, from its first frame on, or moved by what a column says."""
    if how == "shared-clock":
        return df
    if how == "first-frame":
        return shifted(df, at, keys, anchor)
    if how == "tagged" and tag:
        return df.withColumn(at, F.col(at) + F.coalesce(F.col(tag), F.lit(0.0)))
    raise DialectError("UDF_ARG_TYPE", f"no anchor {how}")


def at_or_before(rows: DataFrame, frames: DataFrame, keys: list[str], at: str, fields: list[str], tie: str | None = None) -> DataFrame:
    """Each row with the newest frame at or before it."""
    return hold(rows, frames, keys, at, fields, tie=tie)


def rows_in_windows(rows: DataFrame, windows: DataFrame, keys: list[str], at: str, start: str, end: str, fields: list[str]) -> DataFrame:
    """Rows ride the window whose [start, end) holds their time; windows of one key don't overlap."""
    held = windows.withColumn(at, F.col(start))
    out = hold(rows, held, keys, at, [*fields, end])
    return out.where(F.col(at) < F.col(end)).drop("held_t")


def shifted(df: DataFrame, at: str, keys: list[str], anchor: float = 0.0) -> DataFrame:
    """First-frame anchor: each key's clock starts at ``anchor``."""
    return df.withColumn(at, F.col(at) - F.min(at).over(Window.partitionBy(*keys)) + anchor)
